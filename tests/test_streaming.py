from pyspark.sql import functions as F

from conftest import SF01
from postlens.operators.disclosures import extract_disclosures
from postlens.plans import views as V
from postlens.sources.files import scratch_path
from postlens.streaming.disclosures import run_to_parquet


def test_stream_equals_batch(spark):
    posts = V.v_disclosure_posts(spark, SF01).select("user_id", "post_id", "text", "created_utc")
    src = scratch_path(spark, "stream-in")
    posts.write.mode("overwrite").json(src)
    out, ck = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-ck")
    q = run_to_parquet(spark, src, out, ck)
    q.awaitTermination(300)
    got = spark.read.parquet(out).select("post_id", "pattern_ord", "match_idx", "MatchedPhrase").collect()
    want = extract_disclosures(posts, keep=["post_id"]).select("post_id", "pattern_ord", "match_idx",
                                                              "MatchedPhrase").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 0

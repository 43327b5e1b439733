"""Terms are counted once, whatever reads the counts."""

from pyspark.sql import functions as F

from postlens.operators.lexical import tf_idf


def test_tf_idf_cuts_texts_once(spark):
    read = spark.sparkContext.accumulator(0)
    cut = F.udf(lambda i: read.add(1) or (None if i == 3 else [] if i == 4 else ["the", "the", None, f"w{i % 5}"]), "array<string>")
    docs = spark.range(40, numPartitions=2).select((F.col("id") % 38).alias("d"), cut("id").alias("tokens"))  # ids 0 and 1 come twice
    got = {(r.d, r.term): (r.tf, r.df) for r in tf_idf(docs, "d", heavy_terms=3).collect()}
    assert read.value == 40
    assert len(got) == 36 * 2 + 2 and got[0, "the"] == (4, 36) and got[5, "the"] == (2, 36) and got[0, "w0"] == (1, 8) and got[0, "w3"][0] == 1

"""The trigger automaton never misses a pattern that matches."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlens.functions.demographics import PATTERNS, spark_pattern, triggers
from postlens.functions.triggers import Triggers, required
from postlens.operators.disclosures import extract_disclosures
from postlens.plans import views as V

WORDS = """I i'm im I'm i m am was 25 12M 3 f turned just today when about around in 8th grade started high school at age : ：still only
now that already a an teenager preteen minor under young adult twentysomething too to drive guy boy woman trans cis my pronouns are
she/her transgender non-binary non binary as 've always been attracted men both boyfriend she said beautiful studying majoring college
university major student undergrad got accepted law enrolled nursing program senior at graduated with BA bachelor's taking gap year dorm
campus library alumni graduate ٣ ２5 İ ı ſ K x page""".split()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(WORDS), st.sampled_from([" ", " ", " ", "", "  ", " ", "-", "\n"])), max_size=14))
def test_mask_covers_every_match(parts):
    text = "".join(a + b for a, b in parts)
    mask = triggers().mask(text)
    for k, (_, _, p, ic) in enumerate(PATTERNS):
        if re.search(p, text, re.IGNORECASE if ic else 0):
            assert mask >> k & 1, (text, p)


def test_required_strings():
    assert required(r"\bI[' ]?m (\d{1,2})\b") == {"im 0", "i'm 0", "i m 0"}
    assert required(r"a+b") == {"a"} and required(r"(?:xx|y.*zzz)") == {"xx", "zzz"} and required(r"q{2}") == {"qq"}
    assert required(r".*") == {""} and required(r"[^a]") == {""} and required(r"(?:ab)?") == {""}
    t = Triggers([r"\d", r".", r"cat|dog"])
    assert [t.mask(x) for x in (None, "", "７", "hot DOG")] == [0, 2, 3, 6]


def test_same_matches_as_running_every_pattern(spark):
    posts = V.v_disclosure_posts(spark, "/root/testdata/sf0.001").select("TID", "text").unionByName(
        spark.createDataFrame([("n", None), ("e", ""), ("u", "İ'm 25 or ı'm ２5, ſtill 30, MY BOYFRIEND on CAMPUS, taKing a gap year")], "TID string, text string"))
    got = sorted((r.TID, r.pattern_ord, r.match_idx, r.MatchedPhrase) for r in extract_disclosures(posts, keep=["TID"]).collect())
    every = posts.select("TID", F.posexplode(F.array(*[F.regexp_extract_all("text", F.lit(spark_pattern(p, ic)), F.lit(0)) for _, _, p, ic in PATTERNS])))
    want = sorted((r.TID, r.pos, r.k, r.m) for r in every.select("TID", "pos", F.posexplode("col").alias("k", "m")).collect())
    assert got == want and len(got) > 80
    plain = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    idle = plain.select(triggers().column(F.col("text")).alias("m")).agg(F.count_if(F.col("m") == 0), F.count("*")).first()
    assert idle[0] > 0.9 * idle[1]  # texts without disclosures pass without running a pattern

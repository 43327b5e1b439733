from pyspark.sql import functions as F

from postlens.functions import demographics as D
from postlens.functions.text import strip_quotes, word_count
from postlens.operators import prep, segments


def col1(spark, values, fn, t="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {t}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_word_count_edges(spark):
    assert col1(spark, [None, "   ", "a\tb\nc", "one two  three "], word_count) == [1, 0, 3, 3]


def test_segments_sizes(spark):
    texts = [("a", " ".join(["w"] * 100)), ("b", " ".join(["w"] * 101)), ("c", ""), ("d", None)]
    df = spark.createDataFrame(texts, "TID string, text string")
    out = segments.segment_posts(df, 100).orderBy("TID").select("TID", "word_count").collect()
    assert [(r.TID, r.word_count) for r in out] == [("a_1", 100), ("b_1", 100), ("b_2", 1)]


def test_sliding_windows_60_words(spark):
    df = spark.createDataFrame([("a", " ".join(str(i) for i in range(60)))], "TID string, text string")
    out = segments.sliding_chunks(df, 50, 25).orderBy("ChunkID").collect()
    assert [r.text.split()[0] for r in out] == ["0", "25", "50"]
    assert [len(r.text.split()) for r in out] == [50, 35, 10]


def test_user_chunks_equal_brute_force(spark):
    rows = []
    for u in range(3):
        for p in range(7):
            n = (u * 13 + p * 7) % 40
            rows.append((str(u), p, " ".join(f"u{u}p{p}w{i}" for i in range(n))))
    df = spark.createDataFrame(rows, "user_id string, ord long, text string")
    got = {(r.user_id, r.ChunkID): r.text for r in segments.user_sliding_chunks(df, ["ord"], 50, 25).collect()}
    want = {}
    for u in range(3):
        ws = " ".join(t for uu, _, t in sorted(rows, key=lambda r: (r[0], r[1])) if uu == str(u)).split()
        for i, s in enumerate(range(0, len(ws), 25), 1):
            want[(str(u), i)] = " ".join(ws[s:s + 50])
    assert got == want


def test_clean_generated(spark):
    df = spark.createDataFrame([("[No valid comment]",), ("AIm here",), (None,), ("Here it is",),
                                ("x [No valid comment generated] y",), ("fine",)], "`Generated Text` string")
    kept = [r[0] for r in prep.clean_generated(df).collect()]
    assert kept == ["[No valid comment]", None, "fine"]


def test_bin_age(spark):
    vals = ["I'm 25", "preteen", "turned 18 today", "Young adult", "I'm under 25", "no clue", "age: 7", "I am 51"]
    assert col1(spark, vals, D.bin_age) == ["18-25", "<18", "18-25", "18-25", "18-25", "unknown", "<18", "50+"]


def test_gender_quirks(spark):
    vals = ["my boyfriend", "as a guy", "my pronouns are she/her", "they/them", "I'm a woman", None, "prefer not to say"]
    assert col1(spark, vals, D.normalize_gender) == ["Female", "Male", "Unknown", "Non-binary/other", "Female",
                                                     "Unknown", "Unknown"]


def test_education_quirks(spark):
    vals = ["graduated with a MS in", "bachelor's", "associate's", "studying at the university", "a high school kid",
            "as a student"]
    assert col1(spark, vals, D.normalize_education) == ["Master’s Degree", "Unknown", "Community College",
                                                        "Unknown", "High School", "Community College"]


def test_extraction_order_and_negative(spark):
    df = spark.createDataFrame([("I'm attracted to men. i m attracted to women and I'm 25",)], "text string")
    from postlens.operators.disclosures import extract_disclosures
    rows = extract_disclosures(df).orderBy("pattern_ord", "match_idx").collect()
    phrases = [(r.Trait, r.MatchedPhrase) for r in rows]
    assert ("gender", "i m attracted to women") in phrases
    assert all("men." not in p for _, p in phrases)
    assert ("age", "I'm 25") in phrases


def test_strip_quotes_variants(spark):
    vals = ['  "hello"  ', "'hi'", '"', "\"'x'\"", "plain"]
    assert col1(spark, vals, lambda c: strip_quotes(c, "a")) == ["hello", "hi", '"', "'x'", "plain"]
    assert col1(spark, vals, lambda c: strip_quotes(c, "b")) == ["hello", "hi", "", "x", "plain"]
    assert col1(spark, vals, lambda c: strip_quotes(c, "c")) == ["hello", "hi", "", "x", "plain"]
    assert col1(spark, vals, lambda c: strip_quotes(c, "d")) == ["hello", "'hi'", "", "'x'", "plain"]

import re

import numpy as np
from pyspark.sql import functions as F

from odd_rows import SF001, docs, labels, none  # noqa: F401
from postlens.llm import decontam as D
from postlens.llm import pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(A_Z))


def slow_contamination(texts, items, size=13):
    win = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)):
            if w:
                win.setdefault(tuple(w[k:k + size]), set()).add(str(i))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in win}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in win:
                    hit.update(range(k, k + n))
                    found |= win[tuple(w[k:k + n])]
        out.append((t, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(map(repr, out))


def test_contamination_against_brute_force(spark, docs):
    items = [(1, "Lorem ipsum"), (2, None), (3, ""), (4, "same same same"), (5, "a b c a b"), (5, "über ñandú"), (6, "..."),
             (7, " ".join(["lorem ipsum"] * 8)), (8, "word"), (8, "word")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(docs.withColumn("t", F.col("text")), bench, extra=["t"]).select("t", "n_words", "n_hit", "items", "contaminated")
    texts = [r.text for r in docs.collect()]
    assert sorted(repr(tuple(r)) for r in got.collect()) == slow_contamination(texts, items)
    kept = D.without_contaminated(docs, bench)
    assert kept.columns == docs.columns
    left = [r.text for r in kept.collect()]
    assert "word" not in left and None in left and "no id here" in left
    assert D.contamination(docs, bench.where("false")).where("n_hit > 0 or contaminated").count() == 0
    assert D.contamination(docs.where("false"), bench).count() == 0


def test_contamination_on_the_tables(spark):
    docs, bench = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "benchmark"))
    got = D.contamination(docs.withColumn("t", F.col("text")), bench, extra=["t"]).select("t", "n_words", "n_hit", "items", "contaminated")
    want = slow_contamination([r.text for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_proximity_finds_reordered_passages(spark):
    docs = spark.createDataFrame([(1, "alpha filler beta gamma"), (2, "gamma and beta but alpha"), (3, "alpha " + "x " * 60 + "beta gamma")],
                                 "doc_id long, text string")
    windows, _ = D.test_windows(spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string"))
    index = D.build_index(docs)  # all words
    exact = D.exact_matches(index, windows).count()
    near = D.proximity_matches(index, windows, slop=4).join(index.documents, "row").select("id").distinct().collect()
    assert exact == 0 and sorted(r.id for r in near) == [1, 2]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0


def slow_base(t):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if fine:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for _, _, x in sorted(out))


ODD = ["a@b.c_x@d.e y@z.co.uk", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 300.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 " + "1 2 " * 3000,
       "+1 (555) 123-4567 +44 20 7946 0958. +1 2", "x" * 50000 + "@", "😀é a@b.co 😀 1.2.3.4", "", None, "a@b" + ".c" * 20000, "1" * 50000,
       "+" * 5000 + "1 2", "1." * 30000, "a@b.c@d.e", "@@@.a@b-.c..d", "4539 1488 0343 6467 4539148803436467", "same", "same"]


def test_base_spans_against_the_patterns(spark):
    df = spark.createDataFrame([(k % 5, t, "x", 1) for k, t in enumerate(ODD)], "doc_id long, text string, spans string, _found int")
    found, _ = pii.detect(df.select("doc_id", "text"))
    got = found.select("text", pii.listed(F.filter("spans", lambda s: s["base"])).alias("b")).collect()
    assert sorted((str(r.text), r.b) for r in got) == sorted((str(t), slow_base(t)) for t in ODD)
    masked = pii.redact(df)
    assert masked.columns == df.columns and masked.where("spans = 'x' and _found = 1").count() == len(ODD)
    assert "😀é <EMAIL> 😀 <IP>" in [r.text for r in masked.collect()]
    assert pii.redact(df.where("false")).count() == 0


def test_method_adds_spans(spark):
    extra = "Write to jo [at] ex [dot] org. My name is Anna Miller. Call 212-555-1234."
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("text").unionByName(spark.createDataFrame([(extra,)], "text string"))
    found, model = pii.detect(docs)
    row = found.where(F.col("text") == extra).select(pii.listed(F.col("spans"))).first()[0]
    assert "email_masked" in row and "phone_local" in row and "name" in row
    good = model.reliability["edges"]
    assert good[1, True] > good[1, False]


def test_proximity_of_long_windows_looks_as_far_as_it_reaches(spark):
    many = [f"w{k}" for k in range(30)]
    rows = [(1, " ".join(many)), (2, " ".join(many[1:])), (3, " ".join([many[0], *["x"] * 31, *many[1:]]))]  # w0 is the rarest
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    windows, _ = D.test_windows(spark.createDataFrame([("t", " ".join(many))], "item_id string, text string"), size=30)
    index = D.build_index(docs, windows.select(F.explode("words").alias("word")))
    # w29 is 29 words from w0 in the first text and 60 in the third; reach 30, then 60
    for slop, want in ((0, [1]), (29, [1]), (31, [1, 3])):
        got = D.proximity_matches(index, windows, slop=slop).join(index.documents, "row").select("id", "pos").collect()
        assert sorted(tuple(r) for r in got) == [(k, 0) for k in want]


def test_span_classifier_depends_on_shares_not_on_size():
    rng = np.random.default_rng(3)
    rows = [(kind, tuple(int(v) for v in rng.integers(-1, 2, 5)), int(n)) for kind in pii.KINDS for n in rng.integers(1, 900, 20)]
    post = [1 / (1 + np.exp(-float(sum(vote)))) for _, vote, _ in rows]
    rows += [("name", (0, 0, 0, 0, 1), 900_000), ("name", (0, 0, 0, 0, -1), 9_000)]  # far beyond a thousand, and apart
    post += [0.2, 0.9]
    one, bias = pii.logistic(rows, post, 400)
    many, bias_many = pii.logistic([(k, v, n * 1000) for k, v, n in rows], post, 400)
    assert abs(bias - bias_many) < 1e-6 and all(abs(one[k] - many[k]) < 1e-6 for k in one)
    z = lambda vote: bias + one["name"] + sum(one.get((x, y), 0.0) for x, y in zip(pii.LABELERS, vote, strict=True))
    grad = {k: 1e-3 * w for k, w in one.items()}  # the gradient vanishes: it is the end, not a step on the way
    for (kind, vote, n), p in zip(rows, post, strict=True):
        e = 1 / (1 + np.exp(-(z(vote) - one["name"] + one[kind]))) - p
        for k in [(x, y) for x, y in zip(pii.LABELERS, vote, strict=True) if y] + [kind]:
            grad[k] += e * n / sum(n for _, _, n in rows)
    assert max(abs(g) for g in grad.values()) < 1e-6

"""Operators 11 to 13 against brute force, on odd rows and on the smallest tables."""

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from odd_rows import SF001, docs, none  # noqa: F401
from postlens.llm import divergence as D
from postlens.llm import quality_rules as Q
from postlens.llm import queries
from postlens.llm import whitening as W
from postlens.llm.common import text_pieces

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- 11: source divergence

def slow_report(rows, min_docs=10, top=10):
    rows = [(t or "", lang or "", s or "") for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        bags = [(s, Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(A_Z)))) for t, x, s in rows if x == lang]
        seen = Counter(t for _, b in bags for t in b)
        kept = sorted(t for t in seen if seen[t] >= min_docs)
        sources = sorted({s for s, _ in bags})
        count = {s: Counter() for s in sources}
        for s, b in bags:
            count[s].update({t: n for t, n in b.items() if seen[t] >= min_docs})
        every = sum(count.values(), Counter())

        def share(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: share(c) for s, c in count.items()}, share(every)
        for s in sources:
            pair = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(apart(p[s][t], q[t]), t) for t in kept if count[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", over, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:most])]
    return sorted(out)


def report_rows(df, **kw):
    return sorted(tuple(r) for r in D.report(df, **kw).collect())


def test_divergence_of_odd_rows(docs, none):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    more = [("alpha Beta beta É", "en", None), (None, None, "lonely"), ("é beta\x00gamma\x7fdelta", "en", "t"), ("beta", "en", "u"), ("", "xx", "a"), ("1 2", "xx", "b")]
    every = docs.select("text", "lang", "source", F.col("id").alias("term"), F.col("score").alias("p")).unionByName(
        docs.sparkSession.createDataFrame([(*r, "q", 1) for r in more], "text string, lang string, source string, term string, p int"))
    for least in (1, 2, 10):
        assert report_rows(every, min_docs=least) == slow_report(rows + more, least)
    assert D.report(none).count() == 0


def test_divergence_of_the_smallest_table(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = slow_report([(r.text, r.lang, r.source) for r in docs.collect()])
    assert report_rows(docs) == want
    # several tiles of sources, blocks of terms, slices and flushes give the same sums
    for name, small in (("TILE", 4), ("BLOCK_ROWS", 300), ("CELLS", 64), ("HELD", 50)):
        monkeypatch.setattr(D, name, small)
    assert report_rows(docs) == want


def test_proportion_is_exact_for_large_counts(spark):
    pairs = [(2, 2), (9 * 10**14, 9 * 10**15 - 1), (7, 13), (123456789012, 987654321098765), (0, 5)]
    df = spark.createDataFrame(pairs, "c long, t long").select("c", "t", D.proportion(F.col("c"), F.col("t")).alias("p"))
    assert all(r.p == 1 + 10**9 * r.c // r.t for r in df.collect())


# ---- 12: whitening

def table(spark, x, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], None if r is None else [None if v is None else float(v) for v in r], "w")
                                  for i, r in enumerate(x)], "vec_id long, embedding array<double>, w string").repartition(3)


def check_whitened(df, x, k):
    """Every property of the contract against a direct eigendecomposition."""
    got = W.whiten(df).toPandas()
    x = np.floor(1024 * np.asarray(x, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), [sum(int(v) for v in c) for c in x.T]
    a = x - np.array([v / n for v in s])
    cov = a.T @ a / n
    values = np.linalg.eigvalsh(cov)[::-1]
    assert set(got.n) == {n} and sorted(set(got.component)) == list(range(1, k + 1)) and len(got) == n * k
    assert np.allclose(got.drop_duplicates("component").sort_values("component").explained, values[:k] / values.sum(), rtol=1e-9)
    assert got.identity_error.max() < 1e-8
    w = got.pivot(index="id", columns="component", values="whitened").to_numpy()
    # w = a u / sqrt(e), so the covariance of a with w is u sqrt(e): an eigenvector of cov
    u = a.T @ w / n / np.sqrt(values[:k])
    assert np.allclose(cov @ u, u * values[:k], atol=1e-6 * values[0]) and np.allclose(u.T @ u, np.eye(k), atol=1e-8)
    want = [sum((n * int(v) - t) ** 2 for v, t in zip(r, s, strict=True)) for r in x]
    assert got.drop_duplicates("id").sort_values("id").deviation.tolist() == want


def test_whitening_against_eigenvectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) * np.linspace(0.02, 3, 12)
    check_whitened(table(spark, x), x, 8)
    check_whitened(table(spark, x[:, :3]), x[:, :3], 3)
    # dependent and constant dimensions: fewer components, the rest exact
    y = np.round(rng.normal(size=(200, 2)) * 100)
    y = np.column_stack([y, y[:, 0], np.full(200, 7.0), 2 * y[:, 1]])
    check_whitened(table(spark, y), y, 2)


def test_whitening_of_odd_rows(spark):
    rows = [None, [], [1.0, None], [1.0, float("nan")], [1.0, float("inf")], [1.0, 2.0], [1.0, 2.0], [2.0, 4.5], [0.0, -3.0], [5.0]]
    df = table(spark, rows, [1, 2, 3, 4, 5, 6, 6, None, 8, 9]).withColumn("component", F.lit("x"))
    got = W.whiten(df).toPandas()
    assert sorted(got[got.component == 1].id.fillna(-1).tolist()) == [-1, 6, 6, 8] and set(got.n) == {4}  # [5.0] alone has no variance
    assert W.whiten(df.where("false")).count() == 0 and W.whiten(df.where("vec_id = 6")).count() == 0
    huge = table(spark, [[1e300, 1.0], [-1e300, 2.0], [0.0, 3.0]])
    assert W.whiten(huge).where("deviation is null").count() > 0 and np.isfinite(W.whiten(huge).toPandas().whitened).all()


def test_whitening_query(spark):
    got = queries.op12(spark, SF001)
    x = spark.read.parquet(f"{SF001}/embeddings.parquet").orderBy("vec_id").toPandas()
    assert got.count() == 8 * len(x) and got.columns[:2] == ["vec_id", "component"]
    check_whitened(spark.read.parquet(f"{SF001}/embeddings.parquet"), np.array(x.embedding.tolist()), 8)


# ---- 13: quality rules

def slow_counts(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é.日\x0b|😀", max_size=80))
def test_counts_of_random_texts(text):
    got = dict(zip(Q.COUNTS, Q.count(text.encode()), strict=True))
    words = text.replace("\x0b", " ").replace("\t", " ").replace("\n", " ").split(" ")
    assert tuple(got.values())[:5] == slow_counts(text)
    if any(words):
        assert got["n_top"] == max(Counter(w for w in words if w).values())


def test_counts_of_a_text_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(400_000)).encode()
    whole = Q.count(text[:900_000])
    monkeypatch.setattr(Q, "text_pieces", lambda t: text_pieces(t, 5000))
    assert Q.count(text[:900_000]) == whole


def test_rules_of_odd_rows(docs, none):
    got, model = Q.judged(docs)
    assert sorted(map(str, ((r.row.doc_id, *(r[c] for c in Q.COUNTS[:5])) for r in got.collect()))) == sorted(
        map(str, ((r.doc_id, *slow_counts(r.text)) for r in docs.collect())))
    assert all(0 <= r.quality <= 1 for r in got.collect()) and got.where("n_words < 50 and kept").count() == 0
    assert Q.keep_good(docs).columns == docs.columns
    empty, prior = Q.judged(none)
    assert empty.count() == 0 and prior == Q.LabelModel()


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(60_000) < 0.8
    right_good, right_bad = np.linspace(0.85, 0.97, len(Q.RULES)), np.linspace(0.35, 0.8, len(Q.RULES))
    votes = np.where(rng.random((len(good), len(Q.RULES))) < np.where(good[:, None], right_good, right_bad), 1, -1) * np.where(good, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = Q.expectation_maximisation(patterns, n)
    assert abs(m.share - 0.8) < 0.03
    got = np.array([m.right[r] for r in Q.RULES])
    assert np.abs(got[:, 0] - right_good).max() < 0.03 and np.abs(got[:, 1] - right_bad).max() < 0.06
    # shares decide, not sizes
    again = Q.expectation_maximisation(patterns, n * 1000)
    assert np.allclose([again.right[r] for r in Q.RULES], got)


def test_probability_is_the_posterior(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got, m = Q.judged(docs, keep=["doc_id"])
    for r in got.collect():
        odds = Fraction(m.share) / Fraction(1 - m.share)
        for rule, v in r.votes.asDict().items():
            g, b = map(Fraction, m.right[rule])
            odds *= g / (1 - b) if v == 1 else (1 - g) / b if v == -1 else 1
        assert r.quality == pytest.approx(float(odds / (1 + odds)), abs=1e-9)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_rules_agree_with_labels_they_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op13(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").toPandas()
    judged = got[~got.base_failed]
    assert (judged.kept == (judged.label == 1)).mean() > 0.97

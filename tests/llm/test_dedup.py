import numpy as np
import xxhash
from pyspark.sql import functions as F

from odd_rows import docs, labels, none  # noqa: F401
from postlens.llm import embed_dedup as E
from postlens.llm import simhash as S
from postlens.llm.common import connected_components

A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_fingerprint(text, width=3):
    words = (text or "").translate(A_Z).replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for x in words for w in x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + width]).encode(), 42) for i in range(len(words) - width + 1)]
    hs = hs or [xxhash.xxh64_intdigest(" ".join(words).encode(), 42)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints(docs, none):
    got = sorted((str(r.text)[:50], r.n, r.fp & (1 << 64) - 1) for r in S.fingerprints(
        docs.withColumn("t", F.col("text")), extra=[F.col("t").alias("text2")]).select(
        F.col("text2").alias("text"), F.length("text2").alias("n"), "fp").collect())
    want = sorted((str(r.text)[:50], len(r.text) if r.text is not None else None, slow_fingerprint(r.text)) for r in docs.collect()
                  if True)
    assert [(a, c) for a, _, c in got] == [(a, c) for a, _, c in want]
    assert S.near_duplicates(none).count() == 0


def test_links_in_small_and_hot_buckets(spark):
    rng = np.random.default_rng(3)
    base = [int(x) for x in rng.integers(-2**62, 2**62, 6)]
    fps = set(base)
    for b in base[:3]:  # crowds that share most parts: far over the bucket limit given below
        for _ in range(60):
            x = b
            for bit in rng.choice(63, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    close = [(i, j) for i in range(len(fps)) for j in range(i) if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 2]
    want = groups(len(fps), close)
    nodes = spark.createDataFrame([(x,) for x in fps], "fp long")
    for bucket in (4, 10_000):
        comp = {r.node: r.component for r in connected_components(S.near_links(nodes, 2, 4, bucket)).collect()}
        assert [comp.get(x, x) for x in fps] == [fps[w] for w in want]


def test_one_of_each_group_stays(docs):
    kept = S.keep_one(docs)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns
    assert sorted(x[0] for x in rows if (x[1] or "").strip() == "") == [0]  # null, empty and blank are one group
    assert [x for x in rows if x[1] == "A b C a B c"] == [(5, "A b C a B c")]
    assert sum(x == (3, "word") for x in rows) == 1 and (4, "other text of the same id") in rows
    assert (None, "no id here") in rows


def test_long_chain_is_one_component(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(501)}, 1000: 1000, 1001: 1000}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12))
    x[40:90] = x[0] + rng.normal(scale=0.08, size=(50, 12))
    x[100:103] = x[99]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 12, 1), (903, [float("nan")] + [1.0] * 11, 1), (904, [None] + [1.0] * 11, 1),
             (905, [float("inf")] * 12, 1), (906, [1.0, 2.0], 1), (907, [2.0, 4.0], 1), (None, [5.0, -1.0], 1), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4)
    got = E.near_duplicates(df, tile=64).collect()
    ids = [r[0] for r in rows]
    ok = [r[1] and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) for r in rows]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) if o else None for r, o in zip(rows, ok, strict=True)]
    near = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and ok[i] and ok[j]
            and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    links = np.bincount([i for i, _ in near], minlength=len(rows))
    root = groups(len(rows), [p for p in near if p[0] > p[1]])
    low = {r: min((ids[i] for i in range(len(rows)) if root[i] == r and ids[i] is not None), default=None) for r in set(root)}
    key = lambda t: (t[0] is None, t[0] or 0, *t[1:])
    assert sorted(((r.id, r.n_links, r.component_id, r.kept) for r in got), key=key) == sorted(
        ((ids[i], int(links[i]), low[root[i]], ids[i] == low[root[i]]) for i in range(len(rows))), key=key)
    assert E.near_duplicates(df.where("false")).count() == 0
    assert E.near_duplicates(df.where("vec_id = 900")).collect()[0][1:] == (0, 900, True)


def test_embeddings_of_extreme_size(spark):
    rows = [(i, [s * v for v in (3.0, 4.0, 0.5)]) for i, s in enumerate((1.0, 1e-200, 1e200, 5e-324, 1e307))] + [(10, [1.0, 0.0, 0.0]), (11, [1e300, 1e-300, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    assert got == {**dict.fromkeys(range(5), (4, 0)), 10: (1, 10), 11: (1, 10)}

"""Findings of the fourth review: rows of this file's own making."""

import numpy as np
from pyspark.sql import functions as F

from postlens.llm import embed_dedup as E
from postlens.operators import grown as G


def shuffled(spark):
    """Bytes of the session's shuffle files."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = manager.getAllFiles().iterator()
    total = 0
    while files.hasNext():
        f = files.next()
        total += f.length() if f.getName().endswith(".data") else 0
    return total


def test_vectors_are_not_shuffled_for_tile_pairs(spark):
    """evenly spread vectors, so all tiles meet; each was shuffled for every pair it was in."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 32))
    x[100:400] = x[0] + 0.25 * rng.normal(size=(300, 32))
    x[700:720] = x[699]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(3).cache()
    df.count()
    before = shuffled(spark)
    got = sorted(map(tuple, E.near_duplicates(df, tile=32).collect()))
    assert shuffled(spark) - before < 6 * x.nbytes  # over 60 times as much before
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    low = np.arange(len(x))
    while (new := np.array([low[n].min() for n in near])).tolist() != low.tolist():
        low = new
    assert got == [(i, int(near[i].sum()) - 1, int(low[i]), bool(low[i] == i)) for i in range(len(x))]
    for block in (1, 40_000):  # blocks of one tile, and of a few
        assert sorted(map(tuple, E.near_duplicates(df, tile=150, block_bytes=block).collect())) == got


def forest_rows(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(900, 3)), 1)
    y = (x[:, 0] * x[:, 1] + 0.4 * rng.normal(size=900) > 0).astype(int)
    return spark.createDataFrame([(i, int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, y long, a double, b double, c double").repartition(3).cache()


def test_forests_of_all_leaf_sizes_share_the_dealt_rows(spark, monkeypatch):
    """one pass over the rows for all leaf sizes of the grid; each forest was dealt and grown alone before."""
    df = forest_rows(spark)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    variants = [(6, None, 2), (4, 5, 2), (6, 3, 30)]
    for rows in (1_000_000, 100):  # whole trees, and trees whose large nodes are split by all tasks
        monkeypatch.setattr(G, "ROWS", rows)
        f = G.GrownForest(train, ["a", "b", "c"], "y", 42)
        alone = [{r.id: tuple(r._p) for r in f.scores(test, variants, 30, leaf).collect()} for leaf in (1, 3, 60)]
        assert alone[0] != alone[1] != alone[2]
        # 60: a large node's split may leave fewer, so the forests are then grown one after the other
        for leaves in ([1, 3], [1, 60]):
            got = {r.id: tuple(r._p) for r in f.scores(test, variants, 30, leaves).collect()}
            want = {i: alone[0][i] + alone[1 if leaves[1] == 3 else 2][i] for i in alone[0]}
            assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-9) for i in got)


def test_small_and_large_nodes_find_the_same_split():
    """nodes of a few rows try each row's bin, others add up a histogram."""
    rng = np.random.default_rng(2)
    for features in (3, 14):  # one word of bins, and two
        for _ in range(30):
            sizes = rng.integers(2, 9, 40)
            n = int(sizes.sum())
            code = G.coded(rng.integers(0, 6, (n, features)).astype(np.uint8))
            rows, ones = rng.integers(1, 4, n), rng.integers(0, 2, n)
            w = rows + rows * ones * G.ONE
            starts = np.cumsum(sizes) - sizes
            use = G.drawn(np.arange(1, 41, dtype=np.uint64), 0, 42, features)
            total = np.add.reduceat(w, starts)
            a, b = (f(code, w, starts, sizes, use, total, 2) for f in (G._small_splits, G._large_splits))
            at = np.flatnonzero(a[0] >= 0)
            assert len(at) and (a[0] == b[0]).all() and all((p[at] == q[at]).all() for p, q in zip(a, b, strict=True))


def test_rows_of_equal_bins_are_one_cell(spark):
    """forests cost and give the same for repeated rows, whatever their order; counts are Poisson sums."""
    code, n = np.arange(3000)[None], np.array([0, 1, 3, 700]).repeat(750)
    draws = G.Draws(code, (n, n[::-1].copy()), 42)
    got = np.array([draws.of(t) for t in range(20)])
    for k, m in enumerate((0, 1, 3, 700)):
        x = got[:, 0, 750 * k:750 * k + 750].ravel()
        assert abs(x.mean() - m) <= 4 * np.sqrt(m / len(x)) and abs(x.var() - m) <= 0.1 * m  # mean and variance of a Poisson count
    assert abs(np.corrcoef(got[0, 0, 2250:], got[1, 0, 2250:])[0, 1]) < 0.15
    df = forest_rows(spark)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    three = train.unionByName(train).unionByName(train).orderBy("b").repartition(5)
    forests = [G.GrownForest(t, ["a", "b", "c"], "y", 42) for t in (train, train.orderBy("c").repartition(2), three)]
    assert [f.count for f in forests] == [train.count()] * 2 + [3 * train.count()]
    assert forests[0].rows.agg(F.sum(F.col("n0") + F.col("n1"))).first()[0] == train.count() and forests[2].rows.count() <= train.count()
    got = [sorted((r.id, *r._p) for r in f.scores(test, [(20, None, 2)], 30, 1).collect()) for f in forests]
    assert np.allclose(got[0], got[1], atol=1e-9)
    y = {r.id: r.y for r in test.collect()}
    hit = [np.mean([(p > 0.5) == y[i] for i, p in rows]) for rows in got]
    assert abs(hit[0] - hit[2]) < 0.1 and min(hit) > 0.7

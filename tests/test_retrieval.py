"""Retrieval by bounded blocks against the full comparison."""

import numpy as np
from pyspark.sql import functions as F

from postlens.operators import vectors as V


def frame(spark, x, labels, names=("vec_id", "embedding", "cluster")):
    return spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, labels, strict=True))],
                                 f"{names[0]} long, {names[1]} array<double>, {names[2]} long").repartition(3)


def clustered(rng, groups, per, dim, spread):
    centres = rng.normal(size=(groups, dim))
    return np.concatenate([c + rng.normal(scale=spread, size=(per, dim)) for c in centres])


def full(p, pc, x, xc, n):
    """(id, cluster) -> (member ids by similarity and id, least similar member), by the full comparison."""
    u, v = p / np.linalg.norm(p, axis=1, keepdims=True), x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, c in enumerate(pc):
        at = np.flatnonzero(xc == c)
        s = np.round(v[at] @ u[i], 12)
        out[i, int(c)] = ([int(at[k]) for k in np.lexsort((at, -s))[:n]], int(at[np.lexsort((at, s))[0]]))
    return out


def compare(spark, x, xc, p, pc, block, n=4):
    members = frame(spark, x, xc)
    req = frame(spark, p, pc, ("persona_id", "_p", "cluster"))
    want = full(p, pc, x, xc, n)
    ext = V.cluster_extremes(req, members, block_size=block).collect()
    assert {(r.persona_id, r.cluster): (r.most_id, r.least_id) for r in ext} == {k: (a[0], b) for k, (a, b) in want.items()}
    got: dict = {}
    for r in V.cluster_top_n(req, members, n, block_size=block).orderBy("rank").collect():
        got.setdefault((r.persona_id, r.cluster), []).append(r.member_id)
    assert got == {k: a for k, (a, _) in want.items()}
    return V.search_work(req, members, block_size=block).collect()


def test_search_equals_the_full_comparison_and_skips_blocks(spark):
    rng = np.random.default_rng(11)
    x = clustered(rng, 24, 60, 16, 0.08)
    xc = np.where(np.arange(len(x)) % 3 > 0, 0, 1)  # a hot cluster with two thirds of the members
    x[5:25] = x[4]  # ties
    p = np.concatenate([x[::40], rng.normal(size=(20, 16))])
    work = compare(spark, x, xc, p, rng.integers(0, 2, len(p)), 20)
    assert all(r.blocks > 10 and r.share < 0.6 for r in work)


def test_search_without_structure_is_still_exact(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 24))
    work = compare(spark, x, np.zeros(500, int), rng.normal(size=(30, 24)), np.zeros(30, int), 16)
    assert work[0].visited <= work[0].requests * work[0].blocks


def test_work_grows_slower_than_a_cluster(spark):
    share = []
    for groups in (12, 96):
        rng = np.random.default_rng(4)
        x = clustered(rng, groups, 40, 8, 0.02)
        p = x[:: len(x) // 60]
        work = V.search_work(frame(spark, p, np.zeros(len(p)), ("persona_id", "_p", "cluster")), frame(spark, x, np.zeros(len(x))),
                             block_size=20, lowest=False).first()
        share.append(work.share)
    assert share[1] < share[0] / 2  # eight times the members, a smaller share of their blocks


def test_search_of_odd_rows(spark):
    members = spark.createDataFrame([("b", [1.0, 0.0], 1), ("a", [1.0, 0.0], 1), ("z", [0.0, 0.0], 1), ("n", None, 1), ("o", [1.0, 1.0], None)],
                                    "vec_id string, embedding array<double>, cluster long")
    req = spark.createDataFrame([(1, [2.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [1.0, 0.0], 9)],
                                "persona_id long, _p array<double>, cluster long")
    got = V.cluster_extremes(req, members).collect()
    assert [(r.persona_id, r.most_id, r.least_id) for r in got] == [(1, "a", "a")]
    assert V.cluster_top_n(req, members, 5).count() == 2
    assert V.cluster_extremes(req, members.where("false")).count() == 0
    assert V.cluster_extremes(req.where("false"), members.withColumn("cluster", F.lit(1))).count() == 0

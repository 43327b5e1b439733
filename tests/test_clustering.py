"""Mini-batch k-means: a numpy replay of the same batches, cost against full batches, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import clustering as C
from postlens.operators import vectors as V

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def slow_nearest(x, c):
    d = ((x[:, None, :] - c[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@pytest.mark.parametrize("batch,batches", [(64, 30), (1000, 7)])
def test_batches_replayed_row_by_row(spark, batch, batches):
    rows = C.usable(spark.read.parquet(f"{SF001}/embeddings.parquet"), "vec_id", "embedding")
    n, seed, starts = rows.count(), 5, 2
    first = C.parallel_seeding(rows, 12, starts, seed, 3, 2.0)
    got = C.run_batches(rows, n, first, seed, batch, batches)
    drawn = C.batch_rows(rows, n, starts, seed, batch, batches).toPandas()
    assert set(drawn.start) == {0, 1} and drawn.turn.max() == batches - 1
    if n <= batch:
        assert (drawn.groupby(["start", "turn"]).size() == n).all()  # every batch is the table
    for s in range(starts):
        c, v = first[s].copy(), np.zeros(len(first[s]))
        for _, g in drawn[drawn.start == s].groupby("turn"):
            x = np.stack(g.v.to_numpy())
            at, _ = slow_nearest(x, c)
            for i, k in enumerate(at):  # one row after the other, with the rate 1 / (rows seen)
                v[k] += 1
                c[k] += (x[i] - c[k]) / v[k]
        assert np.allclose(c, got[s], atol=1e-9)


def test_seeding_draws_by_distance_and_repeats_itself(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([m + rng.normal(scale=0.01, size=(100, 3)) for m in np.eye(3) * 10])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    rows = C.usable(df, "vec_id", "embedding")
    one, two = (C.parallel_seeding(r, 3, 3, 42, 2, 2.0) for r in (rows, rows.repartition(7)))
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))
    for c in one:
        assert sorted(slow_nearest(c, np.eye(3) * 10)[0]) == [0, 1, 2]  # one centre in every group


def test_cost_is_near_that_of_full_batches(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    c = C.mini_batch_kmeans(e, k=20)
    full, _ = V.cluster_vectors(e, k=20)
    assert c.cost == min(c.costs) and len(c.costs) == 3 and c.cost < 1.02 * full.summary.trainingCost
    x = np.stack(e.orderBy("vec_id").toPandas().embedding.to_numpy()).astype(float)
    at, d = slow_nearest(x, c.centres)
    assert c.cost == pytest.approx(d.sum())
    assert [r.cluster for r in c.assign(e).orderBy("vec_id").collect()] == at.tolist()


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (8, [None, 1.0]), (9, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("old")).withColumn("row.v", F.lit(1))
    c = C.mini_batch_kmeans(df.where("vec_id is null or vec_id <> 6"), k=5)
    got = {r.vec_id: r.cluster for r in c.assign(df).collect()}
    assert len(c.centres) == 2 and got[1] == got[2] != got[3] == got[None] and all(got[i] is None for i in (4, 5, 6, 8, 9))
    assert C.mini_batch_kmeans(df.where("false")).costs == []

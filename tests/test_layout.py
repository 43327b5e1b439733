"""The landmark layout against scaling in numpy, and against the linear projection on a bent surface."""

import numpy as np

from postlens.operators import layout as L
from postlens.operators import model as M


def roll(n=500):
    rng = np.random.default_rng(3)
    t, h = 1.5 * np.pi * (1 + 2 * rng.random(n)), 6 * rng.random(n)
    return np.column_stack([t * np.cos(t), h, t * np.sin(t)]), np.column_stack([t, h])


def kept(true, got, k=10):
    """Share of each row's nearest rows that stay its nearest rows."""
    a, b = (np.argsort(L.distances(x, x), axis=1)[:, 1:k + 1] for x in (true, got))
    return np.mean([len(set(p) & set(q)) / k for p, q in zip(a, b, strict=True)])


def test_layout_of_a_bent_surface(spark):
    x, flat = roll()
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "user_id long, a double, b double, c double").repartition(3)
    got = L.landmark_layout(df, ["a", "b", "c"], landmarks=500, neighbours=5).orderBy("user_id")
    assert got.columns == ["user_id", "x", "y"]
    place = np.array([(r.x, r.y) for r in got.collect()])
    linear = np.array([(r.pc1, r.pc2) for r in M.project_2d(df, ["a", "b", "c"]).orderBy("user_id").collect()])
    z = (x - x.mean(0)) / x.std(0)
    assert kept(z, place) > kept(z, linear) + 0.1
    # all rows are landmarks here: the same as scaling them directly
    marks, back = np.unique(z, axis=0, return_inverse=True)
    g = L.ways(L.distances(marks, marks), 5)
    n = len(g)
    j = np.eye(n) - 1 / n
    values, axes = np.linalg.eigh(-0.5 * j @ (g ** 2) @ j)
    want = (axes[:, ::-1][:, :2] * np.sqrt(values[::-1][:2]))[back.ravel()]
    assert np.allclose(np.abs(place), np.abs(want), atol=1e-6)


def test_ways_join_what_hangs_apart():
    x = np.array([[0.0], [1.0], [2.0], [10.0], [11.0]])
    g = L.ways(L.distances(x, x), 1)
    assert np.allclose(g, np.abs(x - x.T))


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, 1.0, None), (1, 1.0, None), (2, float("nan"), 2.0), (None, 3.0, 4.0), (4, 5.0, 1.0)], "user_id long, a double, b double")
    got = L.landmark_layout(df, ["a", "b"]).collect()
    assert len(got) == 5 and all(np.isfinite([r.x, r.y]).all() for r in got)
    assert len({(round(r.x, 9), round(r.y, 9)) for r in got if r.user_id == 1}) == 1
    assert all((r.x, r.y) == (0, 0) for r in L.landmark_layout(df.where("user_id = 1"), ["a", "b"]).collect())
    assert L.landmark_layout(df.where("false"), ["a", "b"]).count() == 0

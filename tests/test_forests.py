"""Forests cut out of a larger one: a hand-made tree, Spark's own predictions, the grid."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from postlens.operators import model as M
from postlens.operators.forests import Forest, class1_counts, predicted

#                 feature, threshold, left, right, rows, share of class 1
TREE = [(0, 5.0, 1, 4, 10, 0.4), (1, 1.0, 2, 3, 4, 0.75), (-1, 0, -1, -1, 1, 0.0), (-1, 0, -1, -1, 3, 1.0), (0, 8.0, 5, 6, 6, 1 / 6),
        (-1, 0, -1, -1, 5, 0.0), (-1, 0, -1, -1, 1, 1.0)]
LEAF = [(-1, 0, -1, -1, 10, 0.9)]
FEATS = ["a", "b", "c"]


def merged(forest, limit):
    """The forest with every node a leaf whose subtree down to the limit predicts one class."""
    feature = forest.feature.copy()

    def one_class(node, depth):
        if feature[node] < 0 or depth == limit:
            return forest.share[node] > 0.5
        a, b = one_class(forest.left[node], depth + 1), one_class(forest.right[node], depth + 1)
        if a is not None and a == b:
            feature[node] = -1
            return a
        return None

    for root in forest.roots:
        one_class(root, 0)
    return replace(forest, feature=feature)


def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 3))
    y = (x[:, 0] * x[:, 1] + 0.4 * rng.normal(size=700) > 0).astype(int)
    return spark.createDataFrame([(i, int(t), *map(float, r)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, y long, a double, b double, c double")


def test_hand_made_tree():
    f = Forest.of([TREE, LEAF])
    x = np.array([[5.0, 1.0], [5.0, 2.0], [6.0, 0.0], [9.0, 0.0], [np.nan, 0.0]])
    variants = [(1, None, 2), (1, None, 5), (1, 1, 2), (1, 0, 2), (1, None, 7), (2, None, 2)]
    got = f.shares(x, variants)
    assert got[0].tolist() == [0.0, 1.0, 0.0, 1.0, 1.0]                     # down to the leaves, equal goes left, NaN right
    assert got[1].tolist() == [0.75, 0.75, 0.0, 1.0, 1.0]                   # the node of 4 rows is not split
    assert got[2].tolist() == pytest.approx([0.75, 0.75, 1 / 6, 1 / 6, 1 / 6])
    assert got[3].tolist() == [0.4] * 5
    assert got[4].tolist() == pytest.approx([0.75, 0.75, 1 / 6, 1 / 6, 1 / 6])  # neither has 7 rows
    assert got[5].tolist() == pytest.approx([0.45, 0.95, 0.45, 0.95, 0.95])  # the mean with the second tree


def test_whole_forest_and_depth_limit_equal_spark(spark):
    df = table(spark)
    train = M.assemble(df, FEATS)

    def fit(depth):
        return RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=7, maxDepth=depth, seed=3, featureSubsetStrategy="all").fit(train)

    deep, shallow = fit(12), fit(3)
    forest = Forest.read(deep, spark)
    want = {r.id: (r.prediction, r.score) for r in M.predict(deep, df, FEATS).collect()}
    got = {r.id: (r.prediction, r.score) for r in predicted(df, forest, FEATS, (7, None, 2)).collect()}
    assert all(got[i][1] == pytest.approx(s) and (got[i][0] == p or abs(s - 0.5) < 1e-12) for i, (p, s) in want.items())
    # with all features in every split nothing is drawn below the limit; what is left is that Spark merges leaves that predict alike
    cut = merged(forest, 3)
    want = {r.id: r.score for r in M.predict(shallow, df, FEATS).collect()}
    got = {r.id: r.score for r in predicted(df, cut, FEATS, (7, 3, 2)).collect()}
    assert all(got[i] == pytest.approx(s) for i, s in want.items())
    tp, fp, fn = class1_counts(df, forest, FEATS, "y", [(7, None, 2)])[0]
    p = predicted(df, forest, FEATS, (7, None, 2)).agg(*[F.count_if(F.expr(c)) for c in ("y = 1 and prediction = 1", "y = 0 and prediction = 1", "y = 1 and prediction = 0")]).first()
    assert (tp, fp, fn) == tuple(p)


def test_grid_takes_one_fit_per_leaf_size(spark, monkeypatch):
    df = table(spark).cache()
    fits, fit = [], RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, d: fits.append(self.getMinInstancesPerNode()) or fit(self, d))
    grid = {"numTrees": [5, 10], "maxDepth": [None, 4], "min_samples_split": [2, 40], "minInstancesPerNode": [1, 3]}
    results, best = M.rf_grid_search(df.where("id % 4 > 0"), df.where("id % 4 = 0"), FEATS, "y", 42, grid)
    assert sorted(fits) == [1, 3] and len(results) == 16 and best["dev_f1"] == max(r["dev_f1"] for r in results)
    assert [r["n_estimators"] for r in results] == [5] * 8 + [10] * 8
    assert len({r["dev_f1"] for r in results}) > 3  # the limits matter
    # near what a fit of its own gives
    monkeypatch.undo()
    for r in results[::5]:
        own = M.random_forest(df.where("id % 4 > 0"), FEATS, "y", 42, **M.rf_params(r["max_depth"], max(r["min_samples_leaf"], 1), r["n_estimators"]))
        if r["min_samples_split"] == 2:
            assert abs(M.f1_of_class1(M.predict(own, df.where("id % 4 = 0"), FEATS)).first()["f1"] - r["dev_f1"]) < 0.08


def test_mmd_against_numpy_and_shifted_sets(spark):
    from postlens.operators import vectors as V

    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4)) * 0.5
    far = spark.createDataFrame([(i, [float(v) for v in r + (i % 2) * 0.5], i % 2) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    same = far.withColumn("label", (F.xxhash64("vec_id") % 2 == 0).cast("int")).where("vec_id % 2 = 0")
    a = V.mmd2(far, F.col("label")).first()
    u, v = x[::2], x[1::2] + 0.5
    k = lambda p, q: np.exp(-((p[:, None] - q[None]) ** 2).sum(2))
    full = (k(u, u).sum() - 200) / (200 * 199) + (k(v, v).sum() - 200) / (200 * 199) - 2 * k(u, v).mean()
    assert abs(a.mmd2 - full) < 0.05 and a.p_value == 0.01 and a.blocks == 12
    assert V.mmd2(same, F.col("label")).first().p_value > 0.05
    f = V.mmd2_features(far, F.col("label"), 4, gamma=1.0).first()
    assert abs(f.mmd2 - full) < 4 * f.error + 0.02
    assert V.mmd2(far.where("label = 0"), F.col("label")).first().mmd2 is None

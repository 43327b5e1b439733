"""Forests grown by tasks: hand-made splits, independence of how nodes are dealt, closeness to Spark's forest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlens.operators import grown as G
from postlens.operators import model as M
from test_forests import FEATS, table

VARIANTS = [(8, None, 2), (5, None, 2), (8, 4, 2), (8, None, 40)]


def test_one_tree_splits_where_the_label_changes():
    x = np.array([[0, 3], [1, 3], [2, 3], [3, 3]], np.uint8).repeat(3, axis=0)
    y = (x[:, 0] > 1).astype(np.uint8)
    f = G.grow(x, y, np.ones(12, np.uint8), 0, 1, 0, 30, 1, 42)  # two features, both drawn
    assert f.feature.tolist() == [0, -1, -1] and f.threshold[0] == 1 and f.share.tolist() == [0.5, 0.0, 1.0] and f.rows.tolist() == [12, 6, 6]
    assert G.grow(x, y, np.ones(12, np.uint8), 0, 1, 0, 30, 7, 42).feature.tolist() == [-1]  # no leaf of fewer than 7
    assert G.grow(x[:, 1:], y, np.ones(12, np.uint8), 0, 1, 0, 30, 1, 42).feature.tolist() == [-1]  # nothing to split by
    assert abs(G.bootstrap(np.arange(100_000), 3, 42).mean() - 1) < 0.02


def test_large_nodes_split_by_all_tasks_give_the_same_forest(spark, monkeypatch):
    df = table(spark).withColumn("a", F.when(F.col("id") % 20 != 0, F.col("a")))  # missing only where it is scored
    df = df.repartition(3)
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    rows = []
    for size, opened in ((100_000, 20_000), (60, 20_000), (60, 5)):
        monkeypatch.setattr(G, "ROWS", size)
        monkeypatch.setattr(G, "OPEN", opened)
        f = G.GrownForest(train, FEATS, "y", 42)
        tops = f._split_large(8, 30, 2)
        assert (max(len(t.nodes) for t in tops) > 20) == (size == 60)
        rows.append(sorted((r.id, *r._p) for r in f.scores(test, VARIANTS, 30, 2).select("id", "_p").collect()))
    assert len(rows[0]) == test.count()
    for other in rows[1:]:
        assert [r[0] for r in other] == [r[0] for r in rows[0]] and np.allclose(other, rows[0], atol=1e-9)
    p = np.array(rows[0])[:, 1:]
    assert len({tuple(c) for c in p.T}) == 4


def test_queries_above_the_limit_never_fit_sparks_forest(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier

    df = table(spark).cache()
    train, dev = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    grid = {"numTrees": [10, 30], "maxDepth": [None, 4], "min_samples_split": [2, 40], "minInstancesPerNode": [1, 3]}
    small, _ = M.rf_grid_search(train, dev, FEATS, "y", 42, grid)
    monkeypatch.setattr(M, "SPARK_ROWS", 10)
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *a: pytest.fail("Spark's forest"))
    large, best = M.rf_grid_search(train, dev, FEATS, "y", 42, grid)
    drop = lambda rs: [{k: v for k, v in r.items() if k != "dev_f1"} for r in rs]
    assert drop(small) == drop(large) and best["dev_f1"] == max(r["dev_f1"] for r in large)
    assert max(abs(a["dev_f1"] - b["dev_f1"]) for a, b in zip(small, large, strict=True)) < 0.12
    pred = M.final_fit(train, dev.where("id < 0"), dev, FEATS, best, "y", 42)
    assert pred.columns == [*dev.columns, "prediction", "score"] and pred.count() == dev.count()
    assert abs(M.f1_of_class1(pred).first()["f1"] - best["dev_f1"]) < 0.1
    for odd in ("cast('nan' as double)", "cast('inf' as double)", "cast(null as double)"):  # refused, as by Spark's forest
        with pytest.raises(ValueError, match="175 training rows"):
            M.forest_predictions(train.withColumn("b", F.expr(f"if(id % 4 = 1, {odd}, b)")), dev, FEATS, num_trees=3)
    alone = train.where("y = 1")  # one class, and no rows to score
    assert {r.score for r in M.forest_predictions(alone, dev, FEATS, num_trees=3).collect()} == {1.0}
    assert M.forest_predictions(train, dev.where("id < 0"), FEATS, num_trees=3).count() == 0

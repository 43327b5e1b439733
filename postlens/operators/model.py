"""User-level classifiers: split, augment, random forest, grid search, metrics, projection.

Splits and samples use the seeded md5 rank per class through the skew-safe
running count, so they are reproducible and independent of partitioning.
Metrics are conditional counts and rank sums, i.e. plain aggregations.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.forests import Forest, class1_counts, predicted
from postlens.operators.grown import GrownForest
from postlens.operators.ordered import md5_rank_key, running_sum, running_sums
from postlens.session import cut_lineage

# Published grid: n_estimators x max_depth x min_samples_split x min_samples_leaf.
RF_GRID = {
    "numTrees": [50, 100],
    "maxDepth": [None, 10, 20],
    "min_samples_split": [2, 5],
    "minInstancesPerNode": [1, 2],
}
UNLIMITED_DEPTH = 30  # Spark's maximum tree depth stands in for "no limit"
SPARK_ROWS = 10_000   # training rows up to which Spark's own forest is fitted; its time grows faster than the rows


def stratified_split(df: DataFrame, label_col: str = "y", key_cols: Sequence[str] = ("user_id",), seed: int = 42,
                     held_out: float = 0.2, test_share: float = 0.5) -> DataFrame:
    """train / dev / test per class: held-out = ceil(held_out * n_c), test = ceil(test_share * held-out).

    Rows are ranked per class by the seeded md5 key; ranks come from the
    distributed running count (a class may hold half of the data).
    """
    ranked = running_sum(df.withColumn("_h", md5_rank_key(seed, *key_cols)), [label_col], ["_h", *key_cols],
                         F.lit(1), "_rank", key_total="_n")
    tmp = F.ceil(F.col("_n") * F.lit(held_out))
    test = F.ceil(tmp * F.lit(test_share))
    train_n = F.col("_n") - tmp
    split = (F.when(F.col("_rank") <= train_n, F.lit("train"))
             .when(F.col("_rank") <= train_n + (tmp - test), F.lit("dev")).otherwise(F.lit("test")))
    return ranked.withColumn("split", split).drop("_h", "_rank", "_n")


def holdout_split(users: DataFrame, listed: DataFrame, user_col: str = "user_id") -> DataFrame:
    """test = users in the manual lists, pool = all others (semi / anti join)."""
    test = users.join(listed, user_col, "left_semi").withColumn("part", F.lit("test"))
    pool = users.join(listed, user_col, "left_anti").withColumn("part", F.lit("pool"))
    return test.unionByName(pool)


def fraction_sample(df: DataFrame, frac: float, label_col: str = "y", key_cols: Sequence[str] = ("user_id",),
                    seed: int = 42, rounding: str = "floor") -> DataFrame:
    from postlens.operators.sampling import class_sample

    return class_sample(df, frac, seed, label_col, key_cols, rounding)


def augmented_train(train: DataFrame, syn_pos: DataFrame, syn_ctrl: DataFrame, auth_frac: float = 1.0,
                    syn_pos_frac: float = 1.0, syn_ctrl_frac: float = 1.0, seed: int = 42,
                    label_col: str = "y", key_cols: Sequence[str] = ("user_id",), dev: DataFrame | None = None) -> DataFrame:
    """Sampled authentic train + kept synthetic positives (y=1) + synthetic controls (y=0).

    ``dev`` is added whole: the set of the final fit, after the grid is searched.
    """
    a = fraction_sample(train, auth_frac, label_col, key_cols, seed).withColumn("origin", F.lit("authentic"))
    p = fraction_sample(syn_pos.withColumn(label_col, F.lit(1).cast("long")), syn_pos_frac, label_col, key_cols, seed)
    c = fraction_sample(syn_ctrl.withColumn(label_col, F.lit(0).cast("long")), syn_ctrl_frac, label_col, key_cols, seed)
    syn = p.unionByName(c).withColumn("origin", F.lit("synthetic"))
    if dev is not None:
        a = a.unionByName(dev.withColumn("origin", F.lit("authentic")), allowMissingColumns=True)
    return a.unionByName(syn, allowMissingColumns=True)


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def rf_params(max_depth, min_leaf: int, num_trees: int) -> dict:
    """sklearn-style forest parameters -> Spark's; ``min_samples_split`` is applied to the fitted nodes (``forests``)."""
    return {"numTrees": num_trees, "maxDepth": UNLIMITED_DEPTH if max_depth is None else max_depth, "minInstancesPerNode": min_leaf}


def random_forest(train: DataFrame, features: Sequence[str], label_col: str = "y", seed: int = 42, **params):
    model = RandomForestClassifier(featuresCol="features", labelCol=label_col, seed=seed, maxMemoryInMB=1024,
                                   cacheNodeIds=True, **params)
    return model.fit(assemble(train, features))


def forest_predictions(train: DataFrame, test: DataFrame, features: Sequence[str], label_col: str = "y", seed: int = 42, max_depth=None,
                       min_split: int = 2, min_leaf: int = 1, num_trees: int = 100) -> DataFrame:
    """``test`` with ``prediction`` and ``score`` of a forest grown by tasks (``grown``), for training sets of any size."""
    limit = UNLIMITED_DEPTH if max_depth is None else max_depth
    out = GrownForest(train, features, label_col, seed).scores(test, [(num_trees, max_depth, min_split)], limit, min_leaf)
    p = F.col("_p")[0]
    return out.select(*[F.col(f"`{c}`") for c in test.columns if c not in ("prediction", "score")], (p > 0.5).cast("double").alias("prediction"),
                      p.alias("score"))


def predict(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    out = model.transform(assemble(df, features))
    return out.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability")


def f1_of_class1(pred: DataFrame, label_col: str = "y", pred_col: str = "prediction") -> DataFrame:
    y, p = F.col(label_col) == 1, F.col(pred_col) == 1
    a = pred.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return a.select(F.when(d > 0, 2 * F.col("tp") / d).otherwise(F.lit(0.0)).alias("f1"))


def rf_grid_search(train: DataFrame, dev: DataFrame, features: Sequence[str], label_col: str = "y", seed: int = 42,
                   grid: dict | None = None, parallelism: int = 4) -> tuple[list[dict], dict]:
    """F1 of class 1 on ``dev`` for every grid point; first strictly better wins.

    Grid points that differ only in number of trees, depth and ``min_samples_split`` are cut out of one forest (the most
    trees, the deepest), so there are as many fits as leaf sizes (2 for the published 24 points), and all points of a
    fit are scored together. Up to ``SPARK_ROWS`` training rows Spark's forests are fitted from a small driver thread pool;
    larger ones are grown by tasks, one after the other.
    """
    g = grid or RF_GRID
    combos = list(itertools.product(g["numTrees"], g["maxDepth"], g["min_samples_split"], g["minInstancesPerNode"]))
    rows, dv = (cut_lineage(df.select(*[F.col(f).cast("double").alias(f) for f in features], label_col)) for df in (train, dev))
    deepest = None if None in g["maxDepth"] else max(g["maxDepth"])
    variants, leaves = list(itertools.product(g["numTrees"], g["maxDepth"], g["min_samples_split"])), list(g["minInstancesPerNode"])
    tr = assemble(rows, features).select("features", label_col)

    def fit(leaf):
        params = rf_params(deepest, leaf, max(g["numTrees"]))
        forest = Forest.read(RandomForestClassifier(featuresCol="features", labelCol=label_col, seed=seed, maxMemoryInMB=1024,
                                                    cacheNodeIds=True, **params).fit(tr), train.sparkSession)
        return class1_counts(dv, forest, features, label_col, variants)

    if rows.count() > SPARK_ROWS:
        scored = GrownForest(rows, features, label_col, seed).scores(dv, variants, UNLIMITED_DEPTH if deepest is None else deepest, leaves)
        y = F.coalesce(F.col(label_col) == 1, F.lit(False))
        p = [F.col("_p")[k] > 0.5 for k in range(len(leaves) * len(variants))]
        got = scored.agg(*[F.count_if(c) for x in p for c in (x & y, x & ~y, ~x & y)]).first()
        found = [tuple(got[3 * k:3 * k + 3]) for k in range(len(p))]
    else:
        with ThreadPoolExecutor(max_workers=parallelism) as ex:
            found = [c for counts in ex.map(fit, leaves) for c in counts]
    counts = dict(zip(itertools.product(leaves, variants), found, strict=True))
    results, best = [], None
    for nt, md, ms, ml in combos:
        tp, fp, fn = counts[ml, (nt, md, ms)]
        f1 = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        results.append({"n_estimators": nt, "max_depth": md, "min_samples_split": ms, "min_samples_leaf": ml, "dev_f1": f1})
        if best is None or f1 > best["dev_f1"]:  # grid order, first strictly better wins
            best = results[-1]
    return results, best


def final_fit(train: DataFrame, dev: DataFrame, test: DataFrame, features: Sequence[str], best: dict, label_col: str = "y",
              seed: int = 42) -> DataFrame:
    """Predictions on ``test`` of a forest with the best grid point's parameters, fitted again on train and dev."""
    params = rf_params(best["max_depth"], best["min_samples_leaf"], best["n_estimators"])
    both = train.select(label_col, *features).unionByName(dev.select(label_col, *features))
    if both.count() > SPARK_ROWS:
        return forest_predictions(both, test, features, label_col, seed, best["max_depth"], best["min_samples_split"], best["min_samples_leaf"],
                                  best["n_estimators"])
    forest = Forest.read(random_forest(both, features, label_col, seed, **params), train.sparkSession)
    return predicted(test, forest, features, (best["n_estimators"], best["max_depth"], best["min_samples_split"]))


def classification_report(pred: DataFrame, label_col: str = "y", pred_col: str = "pred") -> DataFrame:
    """precision / recall / f1 / support per class, accuracy, macro and weighted averages."""
    y, p = F.col(label_col).cast("long"), F.col(pred_col).cast("long")
    c = pred.agg(*[F.count_if((y == a) & (p == b)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)])

    def cls(k):
        tp = F.col(f"n{k}{k}")
        fp = F.col(f"n{1 - k}{k}")
        fn = F.col(f"n{k}{1 - k}")
        prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
        rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
        f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        return prec, rec, f1, (tp + fn)

    p0, r0, f0, s0 = cls(0)
    p1, r1, f1, s1 = cls(1)
    n = s0 + s1
    acc = (F.col("n00") + F.col("n11")) / n
    rows = F.array(
        F.struct(F.lit("0").alias("label"), p0.alias("precision"), r0.alias("recall"), f0.alias("f1"), s0.alias("support")),
        F.struct(F.lit("1").alias("label"), p1.alias("precision"), r1.alias("recall"), f1.alias("f1"), s1.alias("support")),
        F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1"), n.alias("support")),
        F.struct(F.lit("macro avg").alias("label"), ((p0 + p1) / 2).alias("precision"), ((r0 + r1) / 2).alias("recall"),
                 ((f0 + f1) / 2).alias("f1"), n.alias("support")),
        F.struct(F.lit("weighted avg").alias("label"), ((p0 * s0 + p1 * s1) / n).alias("precision"),
                 ((r0 * s0 + r1 * s1) / n).alias("recall"), ((f0 * s0 + f1 * s1) / n).alias("f1"), n.alias("support")),
    )
    return c.select(F.explode(rows).alias("r")).select("r.*").withColumn("support", F.col("support").cast("long"))


def roc_auc(pred: DataFrame, label_col: str = "y", score_col: str = "score", group_cols: Sequence[str] = ()) -> DataFrame:
    """ROC AUC with tied scores sharing rank (Mann-Whitney), per group.

    Per distinct score: positives times (negatives below + half the tied
    negatives). "Negatives below" is a running sum over scores, computed by the
    skew-safe bucketed running sum.
    """
    g = list(group_cols)
    pts = pred.groupBy(*g, score_col).agg(F.count_if(F.col(label_col) == 1).alias("pos"),
                                          F.count_if(F.col(label_col) != 1).alias("neg"))
    rs = running_sums(pts, g, [score_col], {"neg_le": "neg"}, key_totals=True)
    rs = rs.withColumn("u", F.col("pos") * (F.col("neg_le") - F.col("neg") + F.col("neg") / 2.0))
    out = rs.groupBy(*g).agg(F.sum("u").alias("u"), F.sum("pos").alias("P"), F.min("neg_le_total").alias("N"))
    return out.select(*g, F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("u") / (F.col("P") * F.col("N")))
                      .alias("auc"))


def metrics_by_group(pred: DataFrame, group_col: str, label_col: str = "y", pred_col: str = "pred",
                     score_col: str = "score") -> DataFrame:
    """Accuracy, F1 of class 1 and AUC per group (e.g. per generation setting)."""
    y, p = F.col(label_col) == 1, F.col(pred_col) == 1
    c = pred.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"), F.count_if(y == p).alias("correct"),
                                    F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                                    F.count_if(y & ~p).alias("fn"))
    d = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    c = c.select(group_col, (F.col("correct") / F.col("n")).alias("accuracy"),
                 F.when(d > 0, 2 * F.col("tp") / d).otherwise(F.lit(0.0)).alias("f1"))
    return c.join(roc_auc(pred, label_col, score_col, [group_col]), group_col, "left")


def project_2d(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("user_id",)) -> DataFrame:
    """Standardise and project to two principal components (stands in for UMAP)."""
    a = assemble(df.na.fill(0.0, subset=list(features)), features, "_pl_x")
    sc = StandardScaler(inputCol="_pl_x", outputCol="_pl_z", withMean=True, withStd=True).fit(a)
    z = sc.transform(a)
    pca = PCA(k=2, inputCol="_pl_z", outputCol="_pl_pc").fit(z)
    out = pca.transform(z).withColumn("_pl_a", vector_to_array("_pl_pc"))
    return out.select(*keep, F.col("_pl_a")[0].alias("pc1"), F.col("_pl_a")[1].alias("pc2"))


def linear_model(kind: str, train: DataFrame, test: DataFrame, features: Sequence[str], label_col: str = "y") -> DataFrame:
    """``logistic_regression`` or ``linear_svm`` fitted on ``train``; predictions on ``test``."""
    maker = {"logistic_regression": LogisticRegression, "linear_svm": LinearSVC}[kind]
    model = maker(featuresCol="features", labelCol=label_col, maxIter=50).fit(assemble(train, features))
    return model.transform(assemble(test, features)).select(*test.columns, F.lit(kind).alias("model"), "prediction")

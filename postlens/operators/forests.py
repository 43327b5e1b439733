"""Random forests read back node by node: pruned by node counts and by depth, scored as prefixes.

A fitted Spark forest is saved to the shared folder and its nodes are read as arrays. From
one deep forest every smaller one follows: its first trees are a smaller forest, a node at the depth
limit becomes a leaf, and so does a node with fewer rows than ``min_samples_split`` (Spark has no
such parameter; a node's rows are its bootstrap rows). A row walks down each tree once and notes where every
variant stops. What differs from fitting each variant anew is the draw of features below a
variant's depth limit: Spark draws them in the order in which nodes are split, which the limit changes;
splits above it are made by the same rule from other draws. Spark also merges sibling leaves that
predict the same class when it fits a shallow tree; a tree that is cut keeps them apart.

A forest must be small enough for a task (its nodes are at most twice its training rows for each tree); large training sets go to ``grown``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.session import scratch

Variant = tuple  # (trees, depth limit or None, fewest rows of a node that is split)


@dataclass
class Forest:
    roots: np.ndarray      # of each tree, into the arrays below
    feature: np.ndarray    # -1: a leaf
    threshold: np.ndarray  # left where the value is at most this
    left: np.ndarray
    right: np.ndarray
    rows: np.ndarray
    share: np.ndarray      # of class 1 among a node's rows

    @classmethod
    def of(cls, trees: Sequence[Sequence[tuple]]) -> Forest:
        """From (feature, threshold, left, right, rows, share) of each tree's nodes, the root first."""
        sizes = [len(t) for t in trees]
        roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        cols = [np.array(c) for c in zip(*(n for t in trees for n in t), strict=True)]
        shift = np.repeat(roots, sizes)
        return cls(roots, cols[0].astype(np.int32), cols[1].astype(float), cols[2].astype(np.int64) + shift, cols[3].astype(np.int64) + shift,
                   cols[4].astype(np.int64), cols[5].astype(float))

    @classmethod
    def read(cls, model, spark: SparkSession) -> Forest:
        """The nodes of a fitted two-class RandomForestClassificationModel over continuous features."""
        path = scratch(spark, "forest")
        model.write().save(path)
        n, s = F.col("nodeData"), F.col("nodeData.split")
        nodes = spark.read.parquet(f"{path}/data").select(
            F.col("treeID").alias("tree"), n["id"].alias("id"), s["featureIndex"].alias("feature"),
            F.coalesce(F.get(s["leftCategoriesOrThreshold"], F.lit(0)), F.lit(0.0)).alias("threshold"), s["numCategories"].alias("categories"),
            n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["rawCount"].alias("rows"),
            (n["impurityStats"][1] / (n["impurityStats"][0] + n["impurityStats"][1])).alias("share")).toPandas().sort_values(["tree", "id"])
        if (nodes.categories > 0).any():
            raise ValueError("only continuous features")
        return cls.of([list(t[["feature", "threshold", "left", "right", "rows", "share"]].itertuples(index=False, name=None))
                       for _, t in nodes.groupby("tree")])

    def shares(self, x: np.ndarray, variants: Sequence[Variant]) -> np.ndarray:
        """(variants, rows of x): mean share of class 1 over the trees of each variant."""
        out = np.zeros((len(variants), len(x)))
        limits = sorted({v[1:] for v in variants}, key=str)
        for number, root in enumerate(self.roots):
            if all(number >= v[0] for v in variants):
                break
            stop = self._stops(x, root, limits)
            for k, (trees, *limit) in enumerate(variants):
                if number < trees:
                    out[k] += self.share[stop[limits.index(tuple(limit))]]
        return out / np.array([min(v[0], len(self.roots)) for v in variants])[:, None]

    def _stops(self, x: np.ndarray, root: int, limits: Sequence[tuple]) -> np.ndarray:
        """(limits, rows): the node where each row stops under each (depth, fewest rows) limit."""
        at = np.full(len(x), root, np.int64)
        stop = np.full((len(limits), len(x)), -1, np.int64)
        row, depth = np.arange(len(x)), 0
        while (stop < 0).any():
            leaf = self.feature[at] < 0
            for k, (deepest, fewest) in enumerate(limits):
                end = leaf | (self.rows[at] < fewest) | (deepest is not None and depth >= deepest)
                new = end & (stop[k] < 0)
                stop[k][new] = at[new]
            go = ~leaf
            value = x[row, np.maximum(self.feature[at], 0)]
            at = np.where(go, np.where(value <= self.threshold[at], self.left[at], self.right[at]), at)
            depth += 1
        return stop


def _features(batch, columns: int) -> np.ndarray:
    return np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(columns)]).astype(float)


def class1_counts(df: DataFrame, forest: Forest, features: Sequence[str], label_col: str, variants: Sequence[Variant]) -> list[tuple]:
    """(true positives, false positives, false negatives) of class 1 for every variant, in one pass over ``df``."""

    def run(batches):
        import pyarrow as pa

        total = np.zeros((len(variants), 3), np.int64)
        for b in batches:
            if b.num_rows:
                y = b.column(len(features)).to_numpy(zero_copy_only=False) == 1
                p = forest.shares(_features(b, len(features)), variants) > 0.5
                total += np.stack([(p & y).sum(1), (p & ~y).sum(1), (~p & y).sum(1)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(variants)), pa.int32()), *(pa.array(total[:, k]) for k in range(3))], ["k", "tp", "fp", "fn"])

    rows = df.select(*[F.col(f).cast("double") for f in features], F.col(label_col).cast("long")).mapInArrow(run, "k int, tp long, fp long, fn long")
    got = {r["k"]: (r["tp"], r["fp"], r["fn"]) for r in rows.groupBy("k").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).collect()}
    return [got.get(k, (0, 0, 0)) for k in range(len(variants))]


def predicted(df: DataFrame, forest: Forest, features: Sequence[str], variant: Variant) -> DataFrame:
    """``df`` with ``score`` (share of class 1) and ``prediction`` of one variant; no shuffle."""
    names = [c for c in df.columns if c not in ("score", "prediction")]
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *[F.col(f"`{f}`").cast("double").alias(f"f{k}") for k, f in enumerate(features)])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.column_stack([b.column(1 + k).to_numpy(zero_copy_only=False) for k in range(len(features))]).astype(float)
            s = forest.shares(x, [variant])[0] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((s > 0.5).astype(float)), pa.array(s)], ["row", "prediction", "score"])

    schema = T.StructType([src.schema["row"], T.StructField("prediction", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in names], "prediction", "score")

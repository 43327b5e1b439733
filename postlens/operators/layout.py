"""A non-linear two-column layout of wide rows by landmarks (stands in for UMAP, beside the linear projection).

A bounded number of rows are landmarks (smallest hash of the key). Distances between them run along the graph
of their nearest neighbours, so a bent surface is measured along itself; classical scaling of these
distances places the landmarks. Every row, landmarks included, is then triangulated: its distance to a
landmark is the shortest way over its own nearest landmarks, and its place follows from its squared
distances by one matrix product. Work is rows times landmarks, without a shuffle of the rows;
only the landmarks and the columns' means and deviations reach the driver.

Null and NaN features count as 0, as in the linear projection; constant columns are left as they are (all 0). Rows with equal
features share a place. Fewer than three different landmarks leave all coordinates 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1), 0))


def ways(d: np.ndarray, neighbours: int) -> np.ndarray:
    """Shortest ways along the graph of each landmark's nearest neighbours; parts that hang apart are joined at their closest points."""
    n = len(d)
    g = np.full((n, n), np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :neighbours + 1]
    rows = np.repeat(np.arange(n), near.shape[1])
    g[rows, near.ravel()] = d[rows, near.ravel()]
    g = np.minimum(g, g.T)
    np.fill_diagonal(g, 0)
    while True:
        for k in range(n):
            np.minimum(g, g[:, k:k + 1] + g[k], out=g)
        apart = np.isinf(g[0])
        if not apart.any():
            return g
        inside, outside = np.flatnonzero(~apart), np.flatnonzero(apart)
        i, j = np.unravel_index(np.argmin(d[np.ix_(inside, outside)]), (len(inside), len(outside)))
        g[inside[i], outside[j]] = g[outside[j], inside[i]] = d[inside[i], outside[j]]


def scaling(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classical scaling to two columns: (matrix that turns centred squared distances into a place, mean squared distances)."""
    squared = g ** 2
    mean = squared.mean(0)
    b = -0.5 * (squared - mean - mean[:, None] + mean.mean())
    values, axes = np.linalg.eigh(b)
    values, axes = values[::-1][:2], axes[:, ::-1][:, :2]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), [0, 1]] < 0, -1, 1)  # either sign would do: the largest entry is positive
    return -0.5 * (axes / np.sqrt(np.maximum(values, 1e-12))).T * (values > 1e-9)[:, None], mean


def landmark_layout(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ("user_id",), landmarks: int = 400,
                    neighbours: int = 10, seed: int = 42) -> DataFrame:
    """(*keep, x, y) for every row of ``df``; ``keep`` names its key."""
    cols = [F.coalesce(F.nanvl(F.col(f"`{f}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"f{k}") for k, f in enumerate(features)]
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *cols)
    names = [f"f{k}" for k in range(len(features))]
    stats = src.agg(*[F.avg(c).alias(f"m{c}") for c in names], *[F.stddev_pop(c).alias(f"s{c}") for c in names]).first()
    mean = np.array([stats[f"m{c}"] or 0.0 for c in names])
    scale = np.array([stats[f"s{c}"] or 1.0 for c in names])
    order = F.xxhash64(F.lit(seed), *[F.col("row").getField(c) for c in keep])
    chosen = src.orderBy(order, "row").limit(landmarks).select(*names).toPandas().to_numpy(float)
    marks = np.unique((chosen - mean) / scale, axis=0) if len(chosen) else np.zeros((0, len(names)))
    turn, centre, g = np.zeros((2, max(len(marks), 1))), np.zeros(max(len(marks), 1)), None
    if len(marks) > 2:
        g = ways(distances(marks, marks), neighbours)
        turn, centre = scaling(g)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            place = np.zeros((b.num_rows, 2))
            if g is not None:
                x = (np.column_stack([b.column(1 + k).to_numpy() for k in range(len(names))]) - mean) / scale
                for at in range(0, len(x), 512):
                    d = distances(x[at:at + 512], marks)
                    near = np.argpartition(d, min(neighbours, len(marks) - 1), axis=1)[:, :neighbours]
                    away = np.full(d.shape, np.inf)
                    for k in range(near.shape[1]):
                        np.minimum(away, d[np.arange(len(d)), near[:, k]][:, None] + g[near[:, k]], out=away)
                    place[at:at + 512] = (away ** 2 - centre) @ turn.T
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place[:, 0].copy()), pa.array(place[:, 1].copy())], ["row", "x", "y"])

    schema = T.StructType([src.schema["row"], T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    return src.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in keep], "x", "y")

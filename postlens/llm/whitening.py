"""Embedding whitening by shifted CholeskyQR.

Entries become integers ``x = floor(1024 c) + 100000``; sums are exact. The centred
rows A = x - S/n are orthogonalised without ever being gathered: a pass over all rows
adds up the Gram matrix of Q = A R^-1 (each task solves the triangular system for its
own rows), the driver factors it, G = R'^T R', and R becomes R' R. The first Gram
matrix is shifted by 11 (n d + d (d + 1)) u ||G|| so that Cholesky cannot break down;
later ones only where it does (dependent dimensions). Two passes after the last shift
that counts, Q is orthonormal and A^T A = R^T R to rounding. The singular values and
right singular vectors of the d x d matrix R give eigenvalues (sigma^2 / n) and
components. Only d x d sums leave the tasks: added up in each task, again in about
sqrt(tasks) groups, then in the driver.

Rows whose vector is null or holds null or non-finite entries are dropped. Vectors of
different lengths cannot share a covariance: each length is whitened by itself, empty
vectors give no rows. Components without variance (sigma below rounding: constant or
dependent dimensions, a single row, equal rows) cannot be scaled and give no rows.
Entries beyond +-2^43 count as +-2^43. ``deviation`` is null where it is beyond 64 bits. Rows may repeat and
ids may be null: every row gives its rows. An empty table gives none. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import stored

SCALE, OFFSET, LARGEST = 1024, 100_000, float(1 << 53)
COMPONENTS = 8
PANEL = 64
PASSES = 5


def integers(flat) -> np.ndarray:
    """x of the entries c."""
    return np.clip(np.floor(flat.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def rows_of(batch, column: int, dim: int) -> np.ndarray:
    return integers(batch.column(column).flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, dim)


def solve_right(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Q with Q r = a for upper triangular r, by substitution over panels of columns."""
    q = np.empty_like(a)
    for k in range(0, a.shape[1], PANEL):
        e = min(k + PANEL, a.shape[1])
        rest = a[:, k:e] - q[:, :k] @ r[:k, k:e]
        for j in range(k, e):
            q[:, j] = (rest[:, j - k] - q[:, k:j] @ r[k:j, j]) / r[j, j]
    return q


def summed(df: DataFrame, make, shape: tuple[int, ...], dtype=np.float64) -> np.ndarray:
    """Sum over all tasks of what ``make(batch)`` gives: in the task, in sqrt(tasks) groups, then here."""
    size = int(np.prod(shape))

    def partial(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            got = make(b)
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, dtype).tobytes()], pa.binary())], ["s"])

    def again(batches):
        import pyarrow as pa

        total = np.zeros(size, dtype)
        for b in batches:
            for s in b.column(0):
                total += np.frombuffer(s.as_py(), dtype)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    parts = df.mapInArrow(partial, "s binary")
    groups = max(1, math.isqrt(df.rdd.getNumPartitions()))
    parts = parts.repartition(groups).mapInArrow(again, "s binary")
    return sum((np.frombuffer(r["s"], dtype) for r in parts.collect()), np.zeros(size, dtype)).reshape(shape)


def exact_sums(vectors: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, S): number of rows and exact sums of x by dimension."""

    def run(batches):
        import pyarrow as pa

        n, total = 0, [0] * dim
        for b in batches:
            if not b.num_rows:
                continue
            x = rows_of(b, 0, dim)
            # halves of 32 bits, so that a batch's sums cannot overflow
            low, high = (x & 0xFFFFFFFF).sum(0).tolist(), (x >> 32).sum(0).tolist()
            n, total = n + len(x), [t + a + (h << 32) for t, a, h in zip(total, low, high, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(list(range(-1, dim)), pa.int32()), pa.array([str(v) for v in (n, *total)])], ["k", "s"])

    rows = vectors.mapInArrow(run, "k int, s string").groupBy("k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    by = {r["k"]: int(r["s"]) for r in rows}
    return by.get(-1, 0), [by.get(k, 0) for k in range(dim)]


def triangular_factor(vectors: DataFrame, dim: int, n: int, mean: np.ndarray) -> np.ndarray:
    """R with R^T R = A^T A, by shifted CholeskyQR passes over the centred rows A."""
    r = np.eye(dim)
    plain = 0  # passes without a shift so far
    for k in range(PASSES):
        have = r

        def gram(b, have=have, k=k):
            a = rows_of(b, 0, dim) - mean
            q = solve_right(a, have) if k else a
            return q.T @ q

        g = summed(vectors, gram, (dim, dim))
        top = np.linalg.norm(g, 2)
        if top == 0:
            return np.zeros((dim, dim))
        shift = 11 * (float(n) * dim + dim * (dim + 1)) * 2.0 ** -53 * top
        try:
            if k == 0:
                raise np.linalg.LinAlgError
            own, plain = np.linalg.cholesky(g).T, plain + 1
        except np.linalg.LinAlgError:
            own, plain = np.linalg.cholesky(g + shift * np.eye(dim)).T, 0
        r = own @ r
        if plain == 2:
            break
    return r


def fit(vectors: DataFrame, dim: int, components: int = COMPONENTS) -> dict | None:
    """n, S, mean, axes (dim x k, one column a component), eigenvalues, trace; None where there is nothing to whiten."""
    n, s = exact_sums(vectors, dim)
    if not n:
        return None
    mean = np.array([v / n for v in s])
    r = triangular_factor(vectors, dim, n, mean)
    _, sigma, axes = np.linalg.svd(r)
    real = sigma > max(sigma[0], 1e-300) * 1e-7 if len(sigma) else np.zeros(0, bool)
    k = min(components, int(real.sum()))
    return {"n": n, "s": s, "mean": mean, "axes": axes[:k].T, "values": sigma[:k] ** 2 / n, "trace": float((r * r).sum() / n)}


def deviations(x: np.ndarray, n: int, s: list[int]) -> list:
    """sum over dimensions of (n x - S)^2, exactly; None beyond 64 bits."""
    if not len(x):
        return []
    widest = max(abs(n * int(v) - t) for k, t in enumerate(s) for v in (x[:, k].min(), x[:, k].max()))
    if widest * widest * len(s) < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63:
        z = x * n - np.array(s, np.int64)
        return (z * z).sum(1).tolist()
    sums = [sum((n * v - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in sums]


def whitened_rows(vectors: DataFrame, dim: int, model: dict) -> DataFrame:
    """(id, deviation, w): each row's projections on the components, scaled to unit variance."""
    turn = model["axes"] / np.sqrt(model["values"])
    n, s, mean = model["n"], model["s"], model["mean"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = rows_of(b, 0, dim)
            w = (x - mean) @ turn
            at = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(deviations(x, n, s), pa.int64()), pa.ListArray.from_arrays(at, pa.array(w.ravel()))],
                                             ["id", "deviation", "w"])

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"id {kind}, deviation long, w array<double>")


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity (Spark's centred, mergeable covariances)."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = white.select(*[F.col("w")[i].alias(f"w{i}") for i in range(k)]).agg(
        *[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): one row per row and component."""
    kind = "float" if dict(rows.dtypes)[vec_col] == "array<float>" else "double"
    src = rows.select(F.col(f"`{vec_col}`").cast(f"array<{kind}>").alias("v"), F.col(f"`{id_col}`").alias("id"))
    fine = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    src = src.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)
    out = None
    for (dim,) in sorted(src.select(F.size("v")).distinct().collect()):
        own = src.where(F.size("v") == dim)
        model = fit(own, dim, components)
        k = 0 if model is None else len(model["values"])
        if not k:
            continue
        white = stored(whitened_rows(own, dim, model), "whitened")
        error = identity_error(white, k)
        shares = F.array(*[F.lit(float(v / model["trace"])) for v in model["values"]])
        one = white.select("id", "deviation", F.posexplode("w").alias("at", "whitened")).select(
            "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
            shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        schema = f"id {src.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return rows.sparkSession.createDataFrame([], schema)
    return out

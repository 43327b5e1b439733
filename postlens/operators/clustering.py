"""Mini-batch k-means with parallel seeding, every draw a function of row keys and the seed.

Seeding is k-means||: a start begins with the row of the smallest hash; every round draws
``oversample * k`` further rows, each with a chance in proportion to its squared distance to the
rows drawn so far (a race of exponential clocks, so one pass of top-n per task does it);
one more pass counts how many rows are nearest to each candidate, and weighted
k-means++ over these bounded candidates picks the k first centres. All starts share the passes.

Mini-batches: an epoch deals all rows out to about n / batch batches by hash; the first
``batches`` of them are used, over as many epochs as that takes. One pass sends them to
one task a start, sorted, which updates its centres batch by batch: a centre with v members so far
and m new ones moves to (v c + sum of the new) / (v + m), so its learning rate falls as 1 / v.
The sequence is serial by nature, but reads ``batches * batch`` rows, whatever the table's size.

A last pass over all rows sets each start's centres to the mean of the rows nearest to them and adds
up the cost before; a further one the cost after. The start of the lowest cost wins. The table is never cached; only
candidates, centres and sums, bounded by k, dimension and starts, reach the driver.

Rows without a vector, or with null or non-finite entries, or of another length than the
first centre's, are left out of the fit and assigned to no cluster (null).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = float(1 << 53)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of c."""
    d = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
    return np.maximum(d, 0, out=d)


def nearest(x: np.ndarray, c: np.ndarray, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest row of c, squared distance to it); of equals the first."""
    at, d = np.zeros(len(x), np.int64), np.zeros(len(x))
    for k in range(0, len(x), step):
        s = squared(x[k:k + step], c)
        at[k:k + step] = s.argmin(1)
        d[k:k + step] = s.min(1)
    return at, d


def usable(df: DataFrame, key_col: str, vec_col: str) -> DataFrame:
    """(key, v): rows with a finite vector."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0)
    return df.select(F.col(key_col).alias("key"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))


def draw(start, turn, seed: int):
    """A number in (0, 1] from (seed, start, turn, key)."""
    bits = F.xxhash64(F.lit(seed), F.lit(start) if isinstance(start, int) else start, F.lit(turn) if isinstance(turn, int) else turn, "key")
    return (F.shiftrightunsigned(bits, 11) + 1) / F.lit(UNIT)


def _matrix(batch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def parallel_seeding(rows: DataFrame, k: int, starts: int, seed: int, rounds: int, oversample: float) -> list[np.ndarray]:
    """The first centres of each start."""
    size = max(1, int(oversample * k))
    first = rows.select(*[F.min_by("v", F.struct(draw(s, -1, seed), "key")).alias(f"s{s}") for s in range(starts)]).first()
    if first is None or first["s0"] is None:
        return []
    found = [np.array([first[f"s{s}"]]) for s in range(starts)]
    dim = found[0].shape[1]
    rows = rows.where(F.size("v") == dim)
    for turn in range(rounds):
        have = [c.copy() for c in found]

        def race(batches, have=have):
            import pyarrow as pa

            best: list = [(np.zeros(0), np.zeros((0, dim)))] * starts
            for b in batches:
                if not b.num_rows:
                    continue
                x = _matrix(b, 0)
                for s in range(starts):
                    d = nearest(x, have[s])[1]
                    far = d > 1e-18
                    clock = -np.log(b.column(1 + s).to_numpy()[far]) / d[far]
                    clock, v = np.concatenate([best[s][0], clock]), np.concatenate([best[s][1], x[far]])
                    order = np.argsort(clock, kind="stable")[:size]
                    best[s] = clock[order], v[order]
            for s, (clock, v) in enumerate(best):
                if len(clock):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(clock), s), pa.int32()), pa.array(clock), pa.array(v.tolist(), pa.list_(pa.float64()))],
                                                     ["start", "clock", "v"])

        drawn = rows.select("v", *[draw(s, turn, seed).alias(f"u{s}") for s in range(starts)]).mapInArrow(race, "start int, clock double, v array<double>")
        place = F.row_number().over(Window.partitionBy("start").orderBy("clock", "v"))
        for r in drawn.withColumn("place", place).where(F.col("place") <= size).orderBy("start", "place").collect():
            found[r["start"]] = np.vstack([found[r["start"]], r["v"]])
    weights, _ = nearest_sums(rows, found)
    return [_weighted_plus_plus(c, w, k, np.random.default_rng([seed, s])) for s, (c, w) in enumerate(zip(found, weights, strict=True))]


def _weighted_plus_plus(x: np.ndarray, w: np.ndarray, k: int, rng) -> np.ndarray:
    """k rows of x, each drawn by weight times squared distance to those before it."""
    chosen = [int(np.argmax(w))]
    d = squared(x, x[chosen])[:, 0]
    while len(chosen) < min(k, len(x)):
        p = np.cumsum(w * d)
        if p[-1] <= 0:
            break
        chosen.append(min(int(np.searchsorted(p, rng.random() * p[-1], "right")), len(x) - 1))
        d = np.minimum(d, squared(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def nearest_sums(rows: DataFrame, centres: list[np.ndarray], means: bool = False) -> tuple[list, list]:
    """One pass for all starts: ([rows nearest to each centre], [cost]) or, with ``means``, ([means of those rows], [cost])."""
    dim = centres[0].shape[1]

    def run(batches):
        import pyarrow as pa

        n = [np.zeros(len(c)) for c in centres]
        sums = [np.zeros(c.shape) for c in centres]
        cost = [0.0] * len(centres)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, 0)
            for s, c in enumerate(centres):
                at, d = nearest(x, c)
                n[s] += np.bincount(at, minlength=len(c))
                cost[s] += float(d.sum())
                if means:
                    order = np.argsort(at, kind="stable")
                    cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
                    sums[s][at[order][cuts]] += np.add.reduceat(x[order], cuts, axis=0)
        for s in range(len(centres)):
            used = np.flatnonzero(n[s])
            if len(used):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), s), pa.int32()), pa.array(used.astype(np.int32)), pa.array(n[s][used]),
                     pa.array([cost[s]] + [0.0] * (len(used) - 1)), pa.array([x.tobytes() for x in sums[s][used]], pa.binary())],
                    ["start", "centre", "n", "cost", "sums"])

    def add(key, t):
        import pyarrow as pa

        total = sum((np.frombuffer(x.as_py()) for x in t["sums"]), np.zeros(dim))
        return pa.table({"start": pa.array([key[0].as_py()], pa.int32()), "centre": pa.array([key[1].as_py()], pa.int32()),
                         "n": [float(sum(t["n"].to_pylist()))], "cost": [float(sum(t["cost"].to_pylist()))], "sums": pa.array([total.tobytes()], pa.binary())})

    kind = "start int, centre int, n double, cost double, sums binary"
    parts = rows.select("v").mapInArrow(run, kind)
    if means:
        got = parts.groupBy("start", "centre").applyInArrow(add, kind).collect()
    else:
        got = parts.groupBy("start", "centre").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()
    out = [np.array(c, float) if means else np.zeros(len(c)) for c in centres]
    costs = [0.0] * len(centres)
    for r in got:
        costs[r["start"]] += r["cost"]
        out[r["start"]][r["centre"]] = np.frombuffer(r["sums"]) / r["n"] if means else r["n"]
    return out, costs


def batch_rows(rows: DataFrame, n: int, starts: int, seed: int, batch: int, batches: int) -> DataFrame:
    """(start, turn, v): the rows of every start's batches; an epoch deals all rows out once."""
    per_epoch = max(1, round(n / batch))
    epochs = -(-batches // per_epoch)
    each = rows.select("key", "v", F.explode(F.sequence(F.lit(0), F.lit(starts * epochs - 1))).alias("e"))
    start, epoch = (F.col("e") / epochs).cast("int"), F.col("e") % epochs
    slot = F.least(F.floor(draw(start, epoch + 1000, seed) * per_epoch), F.lit(per_epoch - 1))
    turn = (epoch * per_epoch + slot).cast("long")
    return each.select(start.alias("start"), turn.alias("turn"), "v").where(F.col("turn") < batches)


def move(centres: np.ndarray, seen: np.ndarray, x: np.ndarray) -> None:
    """One batch: every centre moves to the mean of all it has seen."""
    at, _ = nearest(x, centres)
    m = np.bincount(at, minlength=len(centres))
    sums = np.zeros_like(centres)
    np.add.at(sums, at, x)
    hit = m > 0
    seen[hit] += m[hit]
    centres[hit] += (sums[hit] - m[hit, None] * centres[hit]) / seen[hit, None]


def run_batches(rows: DataFrame, n: int, first: list[np.ndarray], seed: int, batch: int, batches: int) -> list[np.ndarray]:
    """Every start's centres after its batches, one task a start."""
    dim = first[0].shape[1]

    def run(batches_of_task):
        import pyarrow as pa

        state: dict = {}
        held: list = []
        now = None

        def learn():
            c, seen = state.setdefault(now[0], (first[now[0]].copy(), np.zeros(len(first[now[0]]))))
            move(c, seen, np.concatenate(held))

        for b in batches_of_task:
            starts, turns, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b, 2) if b.num_rows else np.zeros((0, dim))
            cuts = np.flatnonzero((np.diff(starts, prepend=-1) != 0) | (np.diff(turns, prepend=-1) != 0)) if len(x) else []
            for a, z in zip(cuts, [*cuts[1:], len(x)], strict=True):
                if now is not None and now != (starts[a], turns[a]):
                    learn()
                    held = []
                now = (int(starts[a]), int(turns[a]))
                held.append(x[a:z])
        if held:
            learn()
        for s, (c, _) in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([c.tobytes()], pa.binary())], ["start", "centres"])

    dealt = batch_rows(rows, n, len(first), seed, batch, batches).repartition(len(first), "start").sortWithinPartitions("start", "turn", "v")
    out = [c.copy() for c in first]
    for r in dealt.mapInArrow(run, "start int, centres binary").collect():
        out[r["start"]] = np.frombuffer(r["centres"]).reshape(-1, dim).copy()
    return out


@dataclass
class Clusters:
    centres: np.ndarray
    cost: float
    costs: list  # of all starts

    def assign(self, df: DataFrame, vec_col: str = "embedding", out: str = "cluster") -> DataFrame:
        """``df`` with the number of each row's nearest centre; no shuffle."""
        centres, names = self.centres, [c for c in df.columns if c != out]
        v = F.col(f"`{vec_col}`").cast("array<double>")
        fine = F.coalesce((F.size(v) == centres.shape[1]) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        src = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.when(fine, v).alias("v"))

        def run(batches):
            import pyarrow as pa

            for b in batches:
                has = b.column(1).is_valid().to_numpy(zero_copy_only=False)
                at = np.zeros(b.num_rows, np.int32)
                if has.any():
                    flat = b.column(1).drop_null().flatten().to_numpy(zero_copy_only=False)
                    at[has] = nearest(flat.reshape(int(has.sum()), -1), centres)[0]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, mask=~has)], ["row", "at"])

        got = src.mapInArrow(run, T.StructType([src.schema["row"], T.StructField("at", T.IntegerType())]))
        return got.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("at").alias(out))


def mini_batch_kmeans(df: DataFrame, key_col: str = "vec_id", vec_col: str = "embedding", k: int = 200, seed: int = 42, starts: int = 3,
                      batch: int = 1000, batches: int = 100, rounds: int = 4, oversample: float = 2.0) -> Clusters:
    """The best of ``starts`` runs; ``key_col`` must tell rows apart (rows that share a key share their draws)."""
    rows = usable(df, key_col, vec_col)
    first = parallel_seeding(rows, k, starts, seed, rounds, oversample)
    if not first:
        return Clusters(np.zeros((0, 0)), 0.0, [])
    rows = rows.where(F.size("v") == first[0].shape[1])
    centres = run_batches(rows, rows.count(), first, seed, batch, batches)
    centres, _ = nearest_sums(rows, centres, means=True)
    _, costs = nearest_sums(rows, centres)
    best = int(np.argmin(costs))
    return Clusters(centres[best], costs[best], costs)

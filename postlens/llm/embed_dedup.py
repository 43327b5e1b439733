"""Embedding near-duplicates by cosine, exactly, with PCA-ordered tiled comparison.

A vector is told by the SHA-256 of its bytes; equal vectors are one node, with their number. Unit vectors are turned into
the principal axes of a bounded sample (``PCA_SAMPLE``; the axes only steer the
pruning, a rotation changes no cosine), laid out by cells of the leading axes and
packed into tiles, which are written once. Tiles are compared block by block: a block (``BLOCK_BYTES`` of tiles, at least one)
is broadcast and the tiles from it on are read past it from where they are stored, so no vector is shuffled for a comparison
and what is on disk does not grow with the number of tile pairs. Two tiles meet only if their boxes in the leading axes come
closer than the distance that the threshold allows. A pair of tiles adds up leading dimensions
first; a pair of vectors is dropped as soon as what it has so far plus the product
of the two suffix norms stays below the threshold (Cauchy-Schwarz), and the rest
are finished in double precision. A tile returns the number of links of each
vector and a spanning forest, never the links themselves, so a dense group costs
rows in proportion to its members.

A tile holds up to ``TILE`` vectors (``TILE_BYTES`` at most). The driver holds a block and each tile's box. Where no box is apart
from another, products are quadratic in the vectors by nature, and the tiles are read once for each block.

Vectors that are null, zero, empty or hold null or non-finite components link with
nothing and come back alone. Components of any finite size are right: a vector is divided by
its largest one before its length is taken. An empty table gives no rows. Vectors of different lengths are never compared.
Repeated rows are links of one another. Rows without an id keep their row; a group's
id is the smallest there is. Other columns (labels) are not read.
"""

from __future__ import annotations

import functools
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.llm.common import connected_components, lean, scratch, stored

TILE = 8192             # vectors of a tile, and at most so many bytes of them in double precision
TILE_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20  # of the tiles that are broadcast at a time
ROUNDS = 3              # blocks under way at a time
LEAD = 16
BOX_AXES = 8
CELL_AXES = 3
PCA_SAMPLE = 20_000
HELD = 16 << 20         # bytes of vectors in which a task looks for equal ones before they are dealt out
SLACK = 1e-5  # float32 rounding in the first pass; what passes is decided in double precision


def principal_axes(vectors: DataFrame, dim: int, distinct: int, sample: int = PCA_SAMPLE) -> np.ndarray:
    """(dim, dim) orthonormal axes, leading first, of at most ``sample`` unit vectors of the ``distinct`` ones (those of smallest hash)."""
    h = F.xxhash64("v")
    few = vectors.select("v", h.alias("h"))
    if distinct > 2 * sample:  # hashes are even, so about twice the sample is left
        few = few.where(F.col("h") < int(-2**63 + 2**64 * (2 * sample / distinct)))
    rows = few.groupBy("h", "v").agg(F.lit(0)).orderBy("h").limit(sample).select("v").toArrow().column("v").combine_chunks()
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = unit_rows(x)
    return np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; each is divided by its largest entry first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(x: np.ndarray, axes: np.ndarray, radius: float) -> np.ndarray:
    """A number for each row by which near rows are near: cells of the leading axes, then the first axis.

    Summed in a fixed order, so equal rows have equal numbers whatever rows are beside them. The numbers steer the layout only.
    """
    x = x / np.abs(x).max(axis=1, keepdims=True)
    y, square = np.zeros((min(CELL_AXES, x.shape[1]), len(x))), np.zeros(len(x))
    for k in range(x.shape[1]):
        square += x[:, k] * x[:, k]
        for axis, a in enumerate(axes[k, :len(y)]):
            y[axis] += a * x[:, k]
    y /= np.sqrt(square)
    out = np.zeros(len(x), np.int64)
    for c in np.clip(np.floor(y / radius), -(1 << 15), (1 << 15) - 1).astype(np.int64):
        out = (out << 16) + c
    return (out << (16 * (CELL_AXES - len(y)))) * (1 << 14) + np.clip(np.floor((y[0] + 1) * (1 << 13)), 0, (1 << 14) - 1).astype(np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    # -0.0 becomes 0.0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + column.type.value_type.to_pandas_dtype()(0)


def _digests(x: np.ndarray) -> list[bytes]:
    import hashlib

    data, width = memoryview(np.ascontiguousarray(x)).cast("B"), x.shape[1] * x.itemsize
    return [hashlib.sha256(data[k:k + width]).digest() for k in range(0, len(data), width)]


def named(good: DataFrame) -> DataFrame:
    """(id, dig, dim) of rows (id, v)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            digs, dims = [None] * b.num_rows, b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for k, d in zip(at.tolist(), _digests(_matrix(b.column(1).take(pa.array(at)), dim)), strict=True):
                    digs[k] = d
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digs, pa.binary()), pa.array(dims.astype(np.int32))], ["id", "dig", "dim"])

    schema = T.StructType([good.schema["id"], T.StructField("dig", T.BinaryType()), T.StructField("dim", T.IntegerType())])
    return good.select("id", "v").mapInArrow(run, schema)


def pack_tiles(vectors: DataFrame, axes: np.ndarray, radius: float, tiles: int, size: int, number: int) -> DataFrame:
    """(tile, n, first, digs, copies, x, low, high): vectors as they are, each once, in tiles of at most ``size``, in cell order."""
    dim = len(axes)
    kind = np.float32 if vectors.schema["v"].dataType.elementType == T.FloatType() else np.float64

    def turn(batches):
        import pyarrow as pa

        held: dict = {}

        def out():
            rows = list(held.values())
            x = np.frombuffer(b"".join(r[0] for r in rows), kind).reshape(-1, dim).astype(np.float64)
            return pa.RecordBatch.from_arrays([pa.array(cells(x, axes, radius)), pa.array(list(held), pa.binary()), pa.array([r[1] for r in rows], pa.int64()),
                                               pa.array([r[0] for r in rows], pa.binary())], ["cell", "dig", "copies", "x"])

        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim)
                for d, r in zip(_digests(x), x, strict=True):
                    if d in held:
                        held[d][1] += 1
                    else:
                        held[d] = [r.tobytes(), 1]
                if len(held) * dim * x.itemsize >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, made, held = ((number << 20) + TaskContext.get().partitionId()) << 28, 0, []

        def emit():
            nonlocal made
            x = b"".join(h[2] for h in held)
            lead = unit_rows(np.frombuffer(x, kind).reshape(-1, dim).astype(np.float64)) @ axes[:, :BOX_AXES]
            first, made = base + made, made + len(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([first]), pa.array([len(held)], pa.int32()), pa.array([b"".join(h[0] for h in held)], pa.binary()),
                 pa.array([np.array([h[1] for h in held], np.int64).tobytes()], pa.binary()), pa.array([x], pa.binary()),
                 pa.array([lead.min(0).tolist()]), pa.array([lead.max(0).tolist()])], ["tile", "n", "digs", "copies", "x", "low", "high"])

        for b in batches:
            for dig, copies, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if held and held[-1][0] == dig:
                    held[-1][1] += copies
                    continue
                if len(held) == size:
                    yield emit()
                    held = []
                held.append([dig, copies, x])
        if held:
            yield emit()

    laid = vectors.select("v").mapInArrow(turn, "cell long, dig binary, copies long, x binary").repartitionByRange(tiles, "cell", "dig")
    return laid.sortWithinPartitions("cell", "dig").select("dig", "copies", "x").mapInArrow(
        pack, "tile long, n int, digs binary, copies binary, x binary, low array<double>, high array<double>")


def nodes_of(tiles: DataFrame) -> DataFrame:
    """(key, dig, copies): a tile's number is its first vector's key."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for tile, digs, copies in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                n = len(digs) // 32
                yield pa.RecordBatch.from_arrays([pa.array(tile + np.arange(n)), pa.array([digs[32 * k:32 * k + 32] for k in range(n)], pa.binary()),
                                                  pa.array(np.frombuffer(copies, np.int64))], ["key", "dig", "copies"])

    return tiles.select("tile", "digs", "copies").mapInArrow(run, "key long, dig binary, copies long")


class Side:
    """Turned unit vectors made ready for ``close_pairs``."""

    def __init__(self, x: np.ndarray, lead: int = LEAD):
        dim = x.shape[1]
        self.x, self.lead = x, min(lead, dim)
        suffix = np.sqrt((x[:, ::-1] ** 2).cumsum(axis=1)[:, ::-1])
        self.rest = {k: suffix[:, k].copy() for k in range(self.lead, dim, self.lead)}
        # the suffix norm is one more coordinate of the leading product
        tail = self.rest.get(self.lead, np.zeros(len(x)))
        self.x32 = np.column_stack([x[:, :self.lead], tail]).astype(np.float32)


def close_pairs(x: Side, y: Side, threshold: float):
    """(i, j) index arrays, chunk by chunk, of the rows of x and y whose product is at least ``threshold``."""
    lead, dim = x.lead, x.x.shape[1]
    y32 = y.x32.T
    step = max(1, min(256, (1 << 21) // max(len(y.x), 1)))  # a slice that stays in cache
    for r in range(0, len(x.x), step):
        near = np.flatnonzero((x.x32[r:r + step] @ y32) >= np.float32(threshold - SLACK))
        for at in range(0, len(near), 50_000):
            ii, jj = np.divmod(near[at:at + 50_000], len(y.x))
            ii += r
            got = np.einsum("ij,ij->i", x.x[ii, :lead], y.x[jj, :lead])
            for k in range(lead, dim, lead):
                alive = got + x.rest[k][ii] * y.rest[k][jj] >= threshold - 1e-9
                ii, jj, got = ii[alive], jj[alive], got[alive]
                got = got + np.einsum("ij,ij->i", x.x[ii, k:k + lead], y.x[jj, k:k + lead])
            hit = got >= threshold
            if hit.any():
                yield ii[hit], jj[hit]


class Forest:
    """Union by smallest over local numbers; keeps each set's smallest member as its root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            if (a == b).all():
                return
            low = np.minimum(a, b)
            np.minimum.at(self.root, a, low)
            np.minimum.at(self.root, b, low)
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def apart(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared gap between a box and each of others."""
    return (np.maximum(np.maximum(low - highs, lows - high), 0.0) ** 2).sum(axis=1)


def block_links(tiles: DataFrame, block, axes: np.ndarray, threshold: float, radius: float) -> DataFrame:
    """(key, links, root): links between the tiles of a broadcast block and ``tiles``, each linked vector's number of links
    there and a member it hangs together with. Pairs inside the block are met once, in either tile's turn."""
    dim = len(axes)

    def run(batches):
        import pyarrow as pa

        held, made = block.value, {}
        if not held:
            return
        kind = np.float32 if len(held[0]["x"]) == held[0]["n"] * dim * 4 else np.float64
        ready = lambda x: Side(unit_rows(np.frombuffer(x, kind).reshape(-1, dim).astype(np.float64)) @ axes)
        lows, highs = (np.array([h[c] for h in held]) for c in ("low", "high"))
        place = {h["tile"]: k for k, h in enumerate(held)}
        starts = np.cumsum([0, *(h["n"] for h in held)])
        keys = np.concatenate([h["tile"] + np.arange(h["n"]) for h in held])
        copies = [np.frombuffer(h["copies"], np.int64) for h in held]
        total, forest = np.zeros(starts[-1], np.int64), Forest(int(starts[-1]))
        for b in batches:
            for row in b.to_pylist():
                near = np.flatnonzero(apart(np.array(row["low"]), np.array(row["high"]), lows, highs) <= radius * radius + SLACK)
                me = place.get(row["tile"])
                if me is not None:
                    near = [k for k in near if k == me or (k < me) == ((k + me) % 2 == 0)]
                if not len(near):
                    continue
                y, n, theirs = None, row["n"], np.frombuffer(row["copies"], np.int64)
                links, at = np.zeros(n, np.int64), starts[-1] if me is None else starts[me]
                if me is None:
                    forest.root = np.concatenate([forest.root[:at], np.arange(at, at + n)])
                for k in near:
                    if k not in made:
                        made[k] = ready(held[k]["x"])
                    y = y or (made[k] if k == me else ready(row["x"]))
                    for i, j in close_pairs(made[k], y, threshold):
                        if k == me:
                            i, j = i[i != j], j[i != j]
                        else:
                            total[starts[k]:starts[k + 1]] += np.bincount(i, weights=theirs[j], minlength=held[k]["n"]).astype(np.int64)
                        links += np.bincount(j, weights=copies[k][i], minlength=n).astype(np.int64)
                        forest.link(i + starts[k], j + at)
                if me is not None:
                    total[at:at + n] += links
                elif links.any():
                    # the smallest of a set with a member in the block is in the block
                    on = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays([pa.array(row["tile"] + on), pa.array(links[on]), pa.array(keys[forest.root[at + on]])],
                                                     ["key", "links", "root"])
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys[on]), pa.array(total[on]), pa.array(keys[forest.root[on]])], ["key", "links", "root"])

    return tiles.mapInArrow(lean(run, "embed_dedup"), "key long, links long, root long")


def all_links(tiles: DataFrame, axes: np.ndarray, threshold: float, radius: float, block_bytes: int) -> list[str]:
    """``block_links`` of every block of tiles with the tiles from it on, each written to a folder of its own as it is done; nothing else is kept on disk."""
    spark = tiles.sparkSession
    tiles = tiles.select("tile", "n", "copies", "x", "low", "high")
    meta = sorted((r.tile, r.size, r.low, r.high) for r in tiles.select("tile", F.octet_length("x").alias("size"), "low", "high").collect())
    numbers, sizes = [m[0] for m in meta], [m[1] for m in meta]
    lows, highs = np.array([m[2] for m in meta]), np.array([m[3] for m in meta])
    blocks, start = [], 0
    for k in range(1, len(meta) + 1):
        if k == len(meta) or sum(sizes[start:k + 1]) > block_bytes:
            blocks.append((start, k))
            start = k

    def one(block):
        lo, hi = block
        near = np.zeros(len(meta), bool)
        for k in range(lo, hi):
            near[lo:] |= apart(lows[k], highs[k], lows[lo:], highs[lo:]) <= radius * radius + SLACK
        rows = tiles.where(F.col("tile").between(numbers[lo], numbers[hi - 1])).collect()
        held = spark.sparkContext.broadcast([r.asDict() for r in sorted(rows, key=lambda r: r.tile)])
        met = tiles.where(F.col("tile") >= numbers[lo])
        if not near[lo:].all():
            met = met.where(F.col("tile").isin([numbers[k] for k in np.flatnonzero(near)]))
        path = scratch(spark, "links")
        try:
            block_links(met, held, axes, threshold, radius).write.parquet(path)
        finally:
            held.destroy()
        return path

    with ThreadPoolExecutor(max_workers=ROUNDS) as ex:
        return list(ex.map(one, blocks))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                    tile: int = TILE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of ``rows``."""
    v = F.col(vec_col).cast("array<float>") if dict(rows.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    src = rows.select(F.col(id_col).alias("id"), v.alias("v"))
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    fine = F.coalesce(fine & F.exists("v", lambda x: x != 0), F.lit(False))
    good = src.where(fine)
    ids = stored(named(good), "ids")
    lows = ids.groupBy("dig").agg(F.min("id").alias("low"))
    radius = float(np.sqrt(2 - 2 * threshold)) if threshold < 1 else 1e-3
    links, nodes = [], []
    for number, (dim, n) in enumerate(sorted(map(tuple, ids.groupBy("dim").agg(F.count_distinct("dig")).collect()))):
        own = good.where(F.size("v") == dim).select("v")
        axes = principal_axes(own, dim, n)
        size = max(1, min(tile, TILE_BYTES // (8 * dim)))
        tiles = stored(pack_tiles(own, axes, radius, max(1, -(-n // size)), size, number), "tiles")
        nodes.append(nodes_of(tiles))
        links += all_links(tiles, axes, threshold, radius, block_bytes)
    if not links:
        alone = src.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
        return alone.withColumn("kept", F.lit(True))
    links = rows.sparkSession.read.schema("key long, links long, root long").parquet(*links)
    per = links.groupBy("key").agg(F.sum("links").alias("links"))
    comp = connected_components(links.select(F.col("key").alias("u"), F.col("root").alias("v")))
    joined = functools.reduce(DataFrame.unionByName, nodes).join(lows, "dig").join(per, "key", "left").join(
        comp, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("component", "key"))
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    done = joined.join(least, "root").select(
        "dig", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    out = ids.join(done, "dig").select("id", "n_links", "component_id")
    rest = src.where(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))

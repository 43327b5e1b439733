"""Embeddings: encode, cluster, cosine similarity and cluster-based example retrieval.

Vectors are ``array<double>`` columns; MLlib vectors appear only at the ML edge.
Retrieval never forms persona x member rows: a cluster's requests and members are dealt into
tiles of bounded size, a task holds one tile and leaves only each request's winners, and inside
it a request meets only the blocks of near neighbours whose ball can hold a winner, by numpy
matrix products. A cluster holding a third of all members is spread over many tiles and tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.operators.ordered import md5_rank_key, row_position
from postlens.session import stored

MAX_CENTROID_VALUES = 4_000_000  # k * dim allowed as a plan literal (about 32 MB of doubles)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double_array(c) -> Column:
    return _c(c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """Cosine similarity of two equal-length numeric arrays (null if either norm is 0)."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a) -> Column:
    n = norm(a)
    return F.transform(_c(a), lambda x: F.try_divide(x, n))


def embed_text(df: DataFrame, text_col: str = "text", dim: int = 384, out: str = "embedding",
               encoder=None) -> DataFrame:
    """Text -> unit-length ``array<double>``.

    ``encoder`` may be a pandas UDF (Series[str] -> Series[list[float]]) loading a
    model once per executor. The shipped default is JVM-side: lower-cased word
    tokens hashed into ``dim`` buckets (HashingTF), L2-normalised.
    """
    if encoder is not None:
        return df.withColumn(out, encoder(F.col(text_col)))
    tok = RegexTokenizer(inputCol=text_col, outputCol="_pl_tok", pattern=r"\W+", toLowercase=True)
    tf = HashingTF(inputCol="_pl_tok", outputCol="_pl_tf", numFeatures=dim)
    nrm = Normalizer(inputCol="_pl_tf", outputCol="_pl_vec", p=2.0)
    base = df.withColumn(text_col + "_pl", F.coalesce(F.col(text_col), F.lit("")))
    tok.setInputCol(text_col + "_pl")
    v = nrm.transform(tf.transform(tok.transform(base)))
    return v.withColumn(out, vector_to_array("_pl_vec")).drop("_pl_tok", "_pl_tf", "_pl_vec", text_col + "_pl")


def centroids_by_label(df: DataFrame, vec_col: str = "embedding", label_col: str = "cluster") -> DataFrame:
    """Mean vector per label (MLlib Summarizer: partial aggregation, no per-dimension explode)."""
    v = df.select(label_col, array_to_vector(as_double_array(vec_col)).alias("_v"))
    return v.groupBy(label_col).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(
        label_col, vector_to_array("_m").alias("centroid"))


def cluster_vectors(df: DataFrame, vec_col: str = "embedding", k: int = 200, seed: int = 42, starts: int = 3,
                    max_iter: int = 20):
    """Full-batch k-means, best of ``starts`` seeds by training cost; returns (model, assigned frame).

    Every step reads all rows; ``clustering.mini_batch_kmeans`` is the published way and reads far fewer.
    """
    v = df.drop("cluster").withColumn("_pl_features", array_to_vector(as_double_array(vec_col)))
    models = [KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="_pl_features", predictionCol="cluster").fit(v) for i in range(starts)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best, best.transform(v).drop("_pl_features")


def centroid_literal(centroids: DataFrame, label_col: str = "cluster") -> Column:
    """A k-row centroid table as one constant ``array<struct<cluster, c>>``, after a size check.

    k is a parameter of the clustering (200 in the published runs); the check
    refuses anything that is not a small constant. The values travel as one JSON
    string literal that the optimizer folds once, not as k * dim literal nodes.
    """
    import json

    size = centroids.agg(F.count(F.lit(1)), F.sum(F.size("centroid"))).first()
    if (size[1] or 0) > MAX_CENTROID_VALUES:  # checked before anything is collected
        raise ValueError(f"{size[0]} centroids with {size[1]} values exceed the literal bound")
    rows = centroids.orderBy(label_col).select(label_col, "centroid").collect()
    payload = json.dumps([{"cluster": int(r[label_col]), "c": [float(x) for x in r["centroid"]]} for r in rows])
    return F.from_json(F.lit(payload), "array<struct<cluster:bigint,c:array<double>>>")


def persona_cluster_sim(personas: DataFrame, centroids: DataFrame, id_col: str = "persona_id",
                        vec_col: str = "embedding", label_col: str = "cluster") -> DataFrame:
    """Cosine similarity of every persona to every centroid: array<struct<cluster, sim>> per persona."""
    cents = centroid_literal(centroids.withColumn("centroid", unit("centroid")), label_col)
    p = personas.select(id_col, F.col(vec_col).alias("_p")).withColumn("_u", unit(as_double_array("_p")))  # norms once, not per centroid
    sims = F.transform(cents, lambda z: F.struct(z["cluster"].alias("cluster"), dot(F.col("_u"), z["c"]).alias("sim")))
    return p.select(id_col, "_p", sims.alias("sims"))


def diverse_clusters(sims: DataFrame, id_col: str = "persona_id") -> DataFrame:
    """Clusters at maximum, median (ascending index n // 2) and minimum similarity.

    Ties: the lowest cluster id (first occurrence, as argmax / argmin).
    """
    asc = F.array_sort(F.transform("sims", lambda s: F.struct(s["sim"].alias("sim"), s["cluster"].alias("cluster"))))
    top = F.array_max(F.transform("sims", lambda s: F.struct(s["sim"].alias("sim"), (-s["cluster"]).alias("neg"))))
    mid = F.element_at(asc, (F.floor(F.size(asc) / 2) + 1).cast("int"))
    return sims.select(id_col, "_p", (-top["neg"]).alias("top_cluster"), mid["cluster"].alias("mid_cluster"),
                       F.element_at(asc, 1)["cluster"].alias("bottom_cluster"))


def _farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` rows of x, each the one least similar to all before it."""
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < k and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def _directed(c: str) -> Column:
    """Whether the vector has a direction: not null, not all zero."""
    return F.coalesce(F.exists(F.col(c), lambda x: x.isNotNull() & (F.abs(x) > 0)), F.lit(False))


def member_index(members: DataFrame, block_size: int = 256, member_id: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "cluster") -> DataFrame:
    """(cluster, block, id, u): members, told into blocks of near neighbours; u as given.

    A cluster of n members gets about min(n / block_size, 4 sqrt(n)) pivots, each the farthest from those before it in a
    sample of four times as many members (by id hash; fewer where the samples of all clusters
    would pass ``MAX_CENTROID_VALUES``); every member goes to the cell of its nearest pivot. A cell over
    twice the block size is split by id hash, so a block is bounded whatever one cluster or one vector holds. Members
    without a direction (null, zero) are left out. Written to the shared folder.
    """
    src = members.select(F.col(label_col).cast("long").alias("cluster"), F.col(member_id).alias("id"),
                         F.col(vec_col).alias("u")).where(_directed("u") & F.col("cluster").isNotNull())
    counts = src.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("u")).alias("dim"),
                                        F.min(F.xxhash64("id")).alias("least"))
    sizes = counts.collect()  # one row a cluster
    if len(sizes) > MAX_CENTROID_VALUES // 4:
        raise ValueError(f"{len(sizes)} clusters: too many to name their pivots in one table")
    wanted = {r["cluster"]: min(r["n"] / block_size, 4 * math.sqrt(r["n"])) for r in sizes}
    dim = max((r["dim"] for r in sizes), default=1)
    share = min(1.0, MAX_CENTROID_VALUES / max(4 * sum(wanted.values()) * dim, 1))
    several = [(r["cluster"], 4 * max(2, round(wanted[r["cluster"]] * share)) / r["n"], r["least"]) for r in sizes if r["n"] > block_size]
    pivots: dict = {}
    if several:
        plan = members.sparkSession.createDataFrame(several, "cluster long, share double, least long")
        h = F.xxhash64("id")
        chosen = src.join(F.broadcast(plan), "cluster").where(
            (F.pmod(h, F.lit(1 << 32)) < F.col("share") * float(1 << 32)) | (h == F.col("least"))).select("cluster", "id", unit(as_double_array("u")).alias("u"))
        found = chosen.orderBy("cluster", "id").toPandas()
        pivots = {int(c): _farthest_first(np.stack(g["u"].to_numpy()), -(-len(g) // 4)) for c, g in found.groupby("cluster")}

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            cluster, u = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            cell = np.zeros(b.num_rows, np.int64)
            for c in np.intersect1d(np.unique(cluster), list(pivots)):
                at = np.flatnonzero(cluster == c)
                x = u.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)  # lengths do not matter here
                for k in range(0, len(at), 1024):
                    cell[at[k:k + 1024]] = np.argmax(x[k:k + 1024] @ pivots[c].T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["cluster", "id", "u", "cell"])

    held = stored(src.mapInArrow(assign, T.StructType([*src.schema.fields, T.StructField("cell", T.LongType())])), "cells")
    cells = held.groupBy("cluster", "cell").agg(F.count(F.lit(1)).alias("cn"))
    part = F.pmod(F.xxhash64(F.lit(1), "id"), F.greatest(F.ceil(F.col("cn") / (2.0 * block_size)), F.lit(1)))
    return stored(held.join(cells, ["cluster", "cell"]).select("cluster", F.xxhash64("cell", part).alias("block"), "id", "u"), "member-index")


SLACK = 1e-7        # angles near 0 are known to about the square root of rounding
TILE = 131_072      # most requests, and most members, that one task holds at a time
LEAST_TILE = 2048   # requests of a tile, where there are few in all
TILES = 48          # as many at least, where there are requests enough
CHUNK, SPAN = 1024, 2048  # requests and members of one matrix product


def _units(u) -> np.ndarray:
    """The rows of an Arrow list array, of length one in double precision."""
    flat = u.flatten().to_numpy(zero_copy_only=False).astype(float)
    x = flat.reshape(len(u), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(1))[:, None]


class _Tile:
    """The members of a tile: told into blocks, each in a ball of angles; of copies only as many as can win."""

    def __init__(self, block: np.ndarray, ids, y: np.ndarray, top: int):
        import pyarrow.compute as pc

        rank = np.empty(len(y), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(y))
        _, copy = np.unique(np.ascontiguousarray(y).view(np.dtype((np.void, y.itemsize * y.shape[1]))).ravel(), return_inverse=True)
        order = np.lexsort((rank, copy))
        first = np.concatenate([[True], np.diff(copy[order]) != 0])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        kept = order[place < top]
        self.at = kept[np.lexsort((rank[kept], block[kept]))]  # rows of the tile's members
        self.rank = np.append(rank[self.at], np.iinfo(np.int64).max)
        self.y, block = y[self.at], block[self.at]
        self.y32 = self.y.astype(np.float32)
        self.starts = np.flatnonzero(np.concatenate([[True], np.diff(block) != 0]))
        self.n = np.diff(np.append(self.starts, len(block)))
        c = np.add.reduceat(self.y, self.starts, axis=0)
        size = np.linalg.norm(c, axis=1)
        c = np.where((size > 1e-9 * self.n)[:, None], c / np.maximum(size, 1e-300)[:, None], self.y[self.starts])
        near = np.einsum("ij,ij->i", self.y, np.repeat(c, self.n, axis=0))
        self.centres, self.radius = c, np.arccos(np.clip(np.minimum.reduceat(near, self.starts), -1, 1))
        self.blocks = len(np.unique(block))


class _Search:
    """Winners of a chunk of requests among a tile's members.

    A block's members lie within ``radius`` of its centre, so their similarity lies between cos(angle + radius) and
    cos(angle - radius): a block that cannot reach what other blocks are sure to hold, or what was found, is not visited.
    Products in single precision find what may win; its similarity in double precision decides, of equals the lowest id.
    """

    def __init__(self, tile: _Tile, x: np.ndarray, top: int, lowest: bool):
        self.t, self.x, self.x32, self.top, self.lowest = tile, x, x.astype(np.float32), top, lowest
        self.eps = (x.shape[1] + 4) * 2.0 ** -23  # of a product in single precision
        self.sims, self.who = np.full((len(x), top), -np.inf), np.full((len(x), top), -1)
        self.low, self.worst = np.full((len(x), 1), -np.inf), np.full((len(x), 1), -1)  # similarity with its sign turned
        self.visited = np.zeros(len(x), np.int64)
        self.run()

    def run(self) -> None:
        t = self.t
        angle = np.arccos(np.clip(self.x @ t.centres.T, -1, 1))
        upper, lower = np.cos(np.maximum(angle - t.radius, 0)), np.cos(np.minimum(angle + t.radius, np.pi))
        sure = np.where(t.n >= self.top, lower, -2.0).max(1)
        least = upper.min(1)
        go = upper >= sure[:, None] - SLACK
        if self.lowest:
            go |= lower <= least[:, None] + SLACK
        everyone = np.arange(len(self.x))
        if go.mean() > 0.5:  # few blocks are ruled out: wide products over all
            self.visited += t.blocks
            for a in range(0, len(t.y), SPAN):
                self.look(everyone, a, min(a + SPAN, len(t.y)))
            return
        for b, (a, n) in enumerate(zip(t.starts, t.n, strict=True)):
            can = upper[:, b] >= np.maximum(sure, self.sims[:, -1]) - SLACK
            if self.lowest:
                can |= lower[:, b] <= np.minimum(least, -self.low[:, 0]) + SLACK
            rows = np.flatnonzero(can)
            if len(rows):
                self.visited[rows] += 1
                self.look(rows, a, a + n)

    def look(self, rows: np.ndarray, a: int, z: int) -> None:
        s = (self.x32 if len(rows) == len(self.x) else self.x32[rows]) @ self.t.y32[a:z].T
        self.offer(rows, s, s.max(1), a, self.sims, self.who, 1)
        if self.lowest:
            least = s.min(1)
            self.offer(rows, s, -least, a, self.low, self.worst, -1)

    def offer(self, rows, s, best, a, sims, who, sign) -> None:
        """Takes those of the products ``s`` that may be among the best (``sign`` -1: the least)."""
        hit = np.flatnonzero(best >= sims[rows, -1] - self.eps)
        if not len(hit):
            return
        rows, s, k = rows[hit], s[hit] * np.float32(sign), min(sims.shape[1], s.shape[1])
        kth = best[hit] if k == 1 else np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        i, j = np.nonzero(s >= np.maximum(kth - 2 * self.eps, sims[rows, -1] - self.eps)[:, None])
        r, m = rows[i], j + a
        exact = np.concatenate([np.einsum("ij,ij->i", self.x[r[k:k + 65_536]], self.t.y[m[k:k + 65_536]]) for k in range(0, len(r), 65_536)]) * sign
        width = sims.shape[1]
        old = np.unique(r)
        r, m = np.concatenate([np.repeat(old, width), r]), np.concatenate([who[old].ravel(), m])
        exact = np.concatenate([sims[old].ravel(), exact])
        order = np.lexsort((self.t.rank[m], -exact, r))
        r, m, exact = r[order], m[order], exact[order]
        first = np.concatenate([[True], np.diff(r) != 0])
        place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        keep = place < width
        sims[r[keep], place[keep]], who[r[keep], place[keep]] = exact[keep], m[keep]


def _winners(top: int, lowest: bool):
    """mapInArrow body over sorted (cluster, rg, mg, kind, block, pid, member, u): a tile's requests, then its members."""

    def tile(t):
        import pyarrow as pa
        import pyarrow.compute as pc

        asks, has = t.filter(pc.equal(t["kind"], 0)), t.filter(pc.equal(t["kind"], 1))
        if not len(asks) or not len(has):
            return
        asks, has = asks.combine_chunks(), has.combine_chunks()
        column = lambda x, c: x[c].combine_chunks() if isinstance(x[c], pa.ChunkedArray) else x[c]
        pid = column(asks, "pid")
        code = pid.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        x, y = _units(column(asks, "u")), _units(column(has, "u"))
        some = np.lexsort((*x.T[::-1], code)) if code.max() + 1 < len(code) else np.arange(len(code))
        some = some[np.isfinite(x[some]).all(1)]
        once = some[np.unique(code[some], return_index=True)[1]]  # of rows that repeat a request the same one in every tile
        whole = np.flatnonzero(np.isfinite(y).all(1))
        if not len(once) or not len(whole):
            return
        pid, x, y = pid.take(pa.array(once)), x[once], y[whole]
        ids, block, cluster = column(has, "member").take(pa.array(whole)), column(has, "block").to_numpy()[whole], asks["cluster"][0].as_py()
        held = _Tile(block, ids, y, top)
        for k in range(0, len(x), CHUNK):
            f = _Search(held, x[k:k + CHUNK], top, lowest)
            i, j = np.nonzero(f.who >= 0)
            m, sims = f.who[i, j], f.sims[i, j]
            seen = np.where(j == 0, f.visited[i], 0)
            high = np.ones(len(i), bool)
            if lowest:
                w = np.flatnonzero(f.worst[:, 0] >= 0)
                i, m, sims = np.concatenate([i, w]), np.concatenate([m, f.worst[w, 0]]), np.concatenate([sims, -f.low[w, 0]])
                seen, high = np.concatenate([seen, np.zeros(len(w), np.int64)]), np.concatenate([high, np.zeros(len(w), bool)])
            yield pa.RecordBatch.from_arrays(
                [pid.take(pa.array(i + k)), pa.array(np.full(len(i), cluster, np.int64)), ids.take(pa.array(held.at[m])), pa.array(sims), pa.array(high), pa.array(seen)],
                ["pid", "cluster", "member", "sim", "high", "visited"])

    def run(batches):
        import pyarrow as pa

        parts, now = [], None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.column_stack([b.column(k).to_numpy() for k in range(3)])
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1), b.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                if now is not None and now != tuple(keys[a]):
                    yield from tile(pa.Table.from_batches(parts))
                    parts = []
                now = tuple(keys[a])
                parts.append(b.slice(a, z - a))
        if parts:
            yield from tile(pa.Table.from_batches(parts))

    return run


def _search(requests: DataFrame, index: DataFrame, id_col: str, label_col: str, top: int, lowest: bool, tile: int = TILE) -> DataFrame:
    """(pid, cluster, member, sim, high, visited): every tile's winners for each of its requests; every winner is among them.

    A cluster's requests and members are dealt by hash into groups of at most about ``tile`` rows, every group of
    requests meets every group of members in one task, and vectors travel once for each such meeting, so what is
    shuffled grows with requests times members over ``tile``, and a task's memory not at all.
    """
    kinds = {x.schema[c].dataType.elementType.typeName() for x, c in ((requests, "_p"), (index, "u"))}
    u = (lambda c: F.col(c)) if kinds == {"float"} else as_double_array
    req = requests.select(F.col(id_col).alias("pid"), F.col(label_col).cast("long").alias("cluster"), u("_p").alias("u")).where(_directed("u"))
    asked = {r["cluster"]: r["count"] for r in req.groupBy("cluster").count().collect()}  # a row for each cluster
    held = {r["cluster"]: r["count"] for r in index.groupBy("cluster").count().collect()}
    size = min(tile, max(LEAST_TILE, -(-sum(asked.values()) // TILES)))
    plan = [(c, -(-asked[c] // size), -(-n // tile)) for c, n in held.items() if c in asked]
    tiles = max(1, min(sum(a * b for _, a, b in plan), 5000))
    deal = F.broadcast(req.sparkSession.createDataFrame(plan, "cluster long, rgs long, mgs long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    pid, member = req.schema["pid"].dataType, index.schema["id"].dataType
    asks = req.join(deal, "cluster").select("cluster", F.pmod(F.xxhash64("pid"), "rgs").alias("rg"), every("mgs").alias("mg"), F.lit(0).alias("kind"),
                                            F.lit(0).cast("long").alias("block"), "pid", F.lit(None).cast(member).alias("member"), "u")
    has = index.join(deal, "cluster").select("cluster", every("rgs").alias("rg"), F.pmod("block", "mgs").alias("mg"), F.lit(1).alias("kind"),
                                             "block", F.lit(None).cast(pid).alias("pid"), F.col("id").alias("member"), u("u").alias("u"))
    dealt = asks.unionByName(has).repartition(tiles, "cluster", "rg", "mg").sortWithinPartitions("cluster", "rg", "mg", "kind", "block")
    out = T.StructType([T.StructField("pid", pid), T.StructField("cluster", T.LongType()), T.StructField("member", member),
                        T.StructField("sim", T.DoubleType()), T.StructField("high", T.BooleanType()), T.StructField("visited", T.LongType())])
    return dealt.mapInArrow(_winners(top, lowest), out)


def search_work(requests: DataFrame, members: DataFrame, id_col: str = "persona_id", block_size: int = 256, member_id: str = "vec_id",
                vec_col: str = "embedding", label_col: str = "cluster", top: int = 1, lowest: bool = True) -> DataFrame:
    """(cluster, requests, blocks, visited, share): how many (request, block) pairs the bounds leave of all of a cluster."""
    index = member_index(members, block_size, member_id, vec_col, label_col)
    done = _search(requests, index, id_col, label_col, top, lowest).groupBy("cluster").agg(
        F.count_distinct("pid").alias("requests"), F.sum("visited").alias("visited"))
    blocks = index.select("cluster", "block").distinct().groupBy("cluster").agg(F.count(F.lit(1)).alias("blocks"))
    return done.join(blocks, "cluster").select(F.col("cluster").alias(label_col), "requests", "blocks", "visited",
                                               (F.col("visited") / (F.col("requests") * F.col("blocks"))).alias("share"))


def cluster_extremes(requests: DataFrame, members: DataFrame, id_col: str = "persona_id", block_size: int = 256,
                     member_id: str = "vec_id", vec_col: str = "embedding", label_col: str = "cluster") -> DataFrame:
    """Most and least similar member of the requested cluster for each (persona, cluster) request.

    ``requests``: (id_col, cluster, _p) with ``_p`` the persona vector. Exact: a request visits every block of its
    cluster that can still win (``member_index``, ``_Search``); requests and members meet in tiles of bounded size,
    so a hot cluster is spread over many tasks. On clustered data a request meets about sqrt(n) centres and
    a few blocks; where vectors point evenly in all directions no bound holds and it meets all blocks: products are then
    requests times members, shuffled rows that number over ``TILE``. Requests
    and members without a direction (null, zero, not finite) give no rows. Ids of any type. Ties: lowest id.
    """
    scored = _search(requests, member_index(members, block_size, member_id, vec_col, label_col), id_col, label_col, 1, True)
    agg = scored.groupBy("pid", "cluster").agg(
        F.min(F.when(F.col("high"), F.struct((-F.col("sim")).alias("neg"), "member"))).alias("b"),
        F.min(F.when(~F.col("high"), F.struct("sim", "member"))).alias("w"))
    return agg.select(F.col("pid").alias(id_col), F.col("cluster").alias(label_col),
                      F.col("b.member").alias("most_id"), (-F.col("b.neg")).alias("most_sim"),
                      F.col("w.member").alias("least_id"), F.col("w.sim").alias("least_sim"))


def cluster_top_n(requests: DataFrame, members: DataFrame, n: int = 3, id_col: str = "persona_id", block_size: int = 256,
                  member_id: str = "vec_id", vec_col: str = "embedding", label_col: str = "cluster") -> DataFrame:
    """The n most similar members of the requested cluster: (id, cluster, rank, member_id, sim); ties: lowest id.

    Exact, by the same search: each tile offers n members, so a request ranks n rows per tile.
    """
    scored = _search(requests, member_index(members, block_size, member_id, vec_col, label_col), id_col, label_col, n, False)
    packed = scored.groupBy("pid", "cluster").agg(F.slice(F.array_sort(F.collect_list(
        F.struct((-F.col("sim")).alias("neg"), "member"))), 1, n).alias("_t"))
    return packed.select(F.col("pid").alias(id_col), F.col("cluster").alias(label_col), F.posexplode("_t").alias("_k", "_e")).select(
        id_col, label_col, (F.col("_k") + 1).cast("long").alias("rank"), F.col("_e.member").alias("member_id"),
        (-F.col("_e.neg")).alias("sim"))


def few_shot_examples(personas: DataFrame, members: DataFrame, centroids: DataFrame, id_col: str = "persona_id",
                      block_size: int = 256) -> DataFrame:
    """Six examples per persona: most / least similar member of the top, median and bottom cluster."""
    div = stored(diverse_clusters(persona_cluster_sim(personas, centroids, id_col), id_col), "diverse")  # read three times
    req = div.select(id_col, "_p", F.posexplode(F.array("top_cluster", "mid_cluster", "bottom_cluster"))
                     .alias("_slot", "cluster"))
    ext = cluster_extremes(req.select(id_col, "cluster", "_p"), members, id_col, block_size)
    j = req.select(id_col, "cluster", "_slot").join(ext, [id_col, "cluster"])
    ex = j.select(id_col, "cluster", "_slot", F.posexplode(F.array(
        F.struct(F.col("most_id").alias("member_id"), F.col("most_sim").alias("sim")),
        F.struct(F.col("least_id").alias("member_id"), F.col("least_sim").alias("sim")))).alias("_k", "_e"))
    return ex.select(id_col, (F.col("_slot") * 2 + F.col("_k") + 1).cast("long").alias("example_no"),
                     "cluster", F.col("_e.member_id").alias("member_id"), F.col("_e.sim").alias("sim"))


def embedding_to_text(df: DataFrame, col: str = "embedding", out: str = "embedding_text") -> DataFrame:
    """JSON list text; floats are widened to double first so the text round-trips exactly."""
    return df.withColumn(out, F.to_json(as_double_array(col)))


def embedding_from_text(df: DataFrame, col: str = "embedding_text", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, F.from_json(F.col(col), "array<double>"))


def centroid_cosine(df: DataFrame, group: Column, vec_col: str = "embedding") -> DataFrame:
    """Cosine of the mean vectors of the two sets ``group`` = 0 / 1 (one row, one aggregation)."""
    m = df.select(group.alias("_g"), array_to_vector(as_double_array(vec_col)).alias("_v")).groupBy("_g").agg(
        Summarizer.mean(F.col("_v")).alias("_m")).select("_g", vector_to_array("_m").alias("_m"))
    two = m.agg(F.max(F.when(F.col("_g") == 0, F.col("_m"))).alias("ma"),
                F.max(F.when(F.col("_g") == 1, F.col("_m"))).alias("mb"))
    return two.select(cosine("ma", "mb").alias("centroid_cosine"))


def _rank_key(seed, *parts) -> int:
    """``ordered.md5_rank_key`` of the same parts."""
    return int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:8], 16)


def mmd2(df: DataFrame, group: Column, key_col: str = "vec_id", vec_col: str = "embedding", gamma: float = 1.0, block: int = 16,
         permutations: int = 99, seed: int = 42) -> DataFrame:
    """(mmd2, p_value, blocks): squared maximum mean discrepancy (kernel exp(-gamma d^2)) of the sets ``group`` = 0 / 1.

    The block estimator: both sets in order of the md5 rank of their keys are cut into blocks of ``block``
    rows each, a block gives the unbiased estimate over its own pairs, and the mean over blocks is
    unbiased, too. Work is rows times ``block``; no more than 2 ``block`` rows ever meet. The p-value is
    that of ``permutations`` random relabelings inside the blocks (the share, counting the true one, that
    reach the observed value). Rows without a vector or of another group are left out, a last incomplete
    block as well; null where there is no full block. Positions come from the prefix scan of ``ordered``.
    """
    src = df.select(group.cast("int").alias("g"), F.col(key_col).alias("key"), as_double_array(vec_col).alias("v"))
    src = src.where(F.col("v").isNotNull() & F.col("g").isin(0, 1)).withColumn("h", md5_rank_key(seed, "key"))
    placed = row_position(src, ["h", "key"], out="pos", keys=["g"]).withColumn("block", F.floor((F.col("pos") - 1) / F.lit(block)))
    blocks = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("g", "key", "v"))).alias("rows")).where(F.size("rows") == 2 * block)
    blocks = blocks.where(F.size(F.filter("rows", lambda r: r["g"] == 0)) == block)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for rows in b.column(1):
                rows = rows.values
                x = rows.field("v").flatten().to_numpy(zero_copy_only=False).reshape(2 * block, -1)
                keys = rows.field("key").to_pylist()
                k = np.exp(-gamma * np.maximum(((x[:, None, :] - x[None]) ** 2).sum(2), 0))
                np.fill_diagonal(k, 0)
                first = [np.arange(2 * block) < block]  # rows come sorted by group
                for p in range(permutations):
                    order = sorted(range(2 * block), key=lambda i: (_rank_key(seed, p, keys[i]), keys[i]))
                    one = np.zeros(2 * block, bool)
                    one[order[:block]] = True
                    first.append(one)
                same = [(k[m][:, m].sum() + k[~m][:, ~m].sum()) / (block * (block - 1)) for m in first]
                out.append([s - 2 * k[m][:, ~m].sum() / block ** 2 for s, m in zip(same, first, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], ["h"])

    h = blocks.select("block", "rows").mapInArrow(run, "h array<double>")
    means = h.select(F.posexplode("h").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    # one row a permutation
    both = means.agg(F.max(F.when(F.col("p") == 0, F.col("x"))).alias("mmd2"), F.max("n").alias("blocks"),
                     F.collect_list(F.when(F.col("p") > 0, F.col("x"))).alias("others"))
    reach = F.size(F.filter("others", lambda x: x >= F.col("mmd2") - 1e-12))
    return both.select("mmd2", F.when(F.col("mmd2").isNotNull(), (1 + reach) / F.lit(permutations + 1.0)).alias("p_value"),
                       F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"))


def mmd2_features(df: DataFrame, group: Column, dim: int, vec_col: str = "embedding", gamma: float | None = None, features: int = 256,
         seed: int = 42) -> DataFrame:
    """(mmd2, error): squared maximum mean discrepancy (RBF kernel exp(-gamma d^2)) of the sets ``group`` = 0 / 1, one aggregation.

    ``error`` is the standard error that the random features leave, from the spread over features. Random Fourier features turn the kernel into a dot product, so each set enters as one mean of
    ``features`` numbers instead of pairs; the error falls with the square root of ``features``.
    """
    import json

    gamma = 1.0 / dim if gamma is None else gamma
    rng = np.random.default_rng(seed)
    rows = [{"w": w.tolist(), "b": float(b)} for w, b in zip(rng.normal(0, np.sqrt(2 * gamma), (features, dim)),
                                                              rng.uniform(0, 2 * np.pi, features), strict=True)]
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<w:array<double>,b:double>>")
    z = F.transform(table, lambda r: F.cos(dot(F.col("_x"), r["w"]) + r["b"]) * F.lit(float(np.sqrt(2.0 / features))))
    v = df.select(group.alias("_g"), as_double_array(vec_col).alias("_x")).where(F.col("_x").isNotNull())
    m = v.select("_g", array_to_vector(z).alias("_z")).groupBy("_g").agg(Summarizer.mean(F.col("_z")).alias("_m")).select(
        "_g", vector_to_array("_m").alias("_m"))
    two = m.agg(F.max(F.when(F.col("_g") == 0, F.col("_m"))).alias("a"), F.max(F.when(F.col("_g") == 1, F.col("_m"))).alias("b"))
    parts = F.zip_with("a", "b", lambda x, y: F.pow(x - y, F.lit(2.0)))
    total = lambda f: F.aggregate(parts, F.lit(0.0), lambda t, x: t + f(x))
    mean, square = total(lambda x: x), total(lambda x: x * x)
    return two.select(mean.alias("mmd2"), F.sqrt(F.greatest(square - mean * mean / features, F.lit(0.0))).alias("error"))

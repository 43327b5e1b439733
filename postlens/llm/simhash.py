"""SimHash near-duplicates: 64-bit fingerprints over word shingles, pigeonhole blocks, exact Hamming check.

1. ``fingerprints``: XXH64 (seed 42) of every shingle of the whole text; bit i is 1 if it is set in over
   half the hashes. Vectorised per Arrow batch; a long text is walked in pieces.
2. ``near_links``: equal fingerprints are one node first, so copies cost one row. A fingerprint is split
   into ``blocks`` parts; two within d bits agree on at least ``blocks - d`` parts, so joining on each
   choice of that many parts finds every close pair, and the exact distance is then checked.
   A bucket over ``max_bucket`` fingerprints is not paired off: its members are linked exactly through
   their one-bit neighbours (two fingerprints are within 2 bits if and only if they share such a
   neighbour or themselves), 65 rows each and at most 65 members a neighbour.
3. components by ``common.connected_components``.

Nulls and empty texts have no words: fingerprint zero, linked like any other. Repeated ids and rows each
give a row; a null id never names a component unless all its members' ids are null. Only the id and text
columns are read, so extra columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import binary_texts, connected_components, lean, stored, word_pieces

MAX_BUCKET = 64


def shingle_hashes(text: bytes, width: int, seed: int = 42):
    """uint64 arrays of the XXH64 of the space-joined word shingles, repeats included."""
    import xxhash

    h, carry, total = xxhash.xxh64_intdigest, [], 0
    for words in word_pieces(text):
        words = carry + words
        n = len(words) - width + 1
        if n > 0:
            parts = zip(*(words[k:] for k in range(width)), strict=False)
            yield np.fromiter((h(s, seed) for s in map(b" ".join, parts)), np.uint64, n)
            total += n
            words = words[n:]
        carry = words
    if not total and carry:
        yield np.array([h(b" ".join(carry), seed)], np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits: bytes spread to lanes, summed 255 rows at a time."""
    spread = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)
    out = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 512):
        part = hashes[at:at + 255 * 512]
        lanes = spread[np.ascontiguousarray(part, "<u8").view(np.uint8)].reshape(-1, 8)
        sums = np.add.reduceat(lanes, np.arange(0, len(part), 255), axis=0)
        out += np.ascontiguousarray(sums, "<u8").view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return out


def fingerprint(text: bytes, width: int = 3) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        counts += bit_counts(h)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                 extra: tuple | list = ()) -> DataFrame:
    """(id, fp, *extra): fp is the fingerprint as a signed long, one row per document."""
    src = binary_texts(docs, id_col, text_col, extra)
    kinds = [(f.name, f.dataType.simpleString()) for f in src.schema if f.name != "text"]
    kinds.insert(1, ("fp", "long"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fp = np.array([fingerprint(t.as_py(), width) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), *b.columns[2:]], [k for k, _ in kinds])

    return src.mapInArrow(lean(run), ", ".join(f"`{k}` {t}" for k, t in kinds))


def block_keys(fp: Column, blocks: int, max_bits: int) -> Column:
    """array<struct<t, key>>: for every choice of ``blocks - max_bits`` parts, their bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    out = []
    for t, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        m = sum(masks[i] for i in chosen)
        m = m - (1 << 64) if m >= 1 << 63 else m
        out.append(F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(m).cast("long")).alias("key")))
    return F.array(*out)


def near_links(nodes: DataFrame, max_bits: int = 2, blocks: int = 4, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(u, v): links between distinct fingerprints ``nodes(fp)`` whose closure joins every pair within ``max_bits``.

    Small buckets give every close pair. Large buckets (``max_bits`` up to 2) give a star per one-bit
    neighbour, whose closure is the same; no group is ever paired off.
    """
    if max_bits > 2:  # the neighbour construction below holds for up to 2 bits
        raise ValueError("max_bits up to 2: a large bucket cannot be linked without pairing it off beyond that")
    keys = nodes.select("fp", F.explode(block_keys(F.col("fp"), blocks, max_bits)).alias("b")).select("fp", "b.*")
    sizes = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # sizes holds only shared buckets; most keys meet none of them
    keys = stored(keys.join(sizes, ["t", "key"]), "block-keys")
    small = keys.where(F.col("n") <= max_bucket)
    a, b = small.select("t", "key", F.col("fp").alias("u")), small.select("t", "key", F.col("fp").alias("v"))
    pairs = a.join(b, ["t", "key"]).where(
        (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)).select("u", "v")
    hot = keys.where(F.col("n") > max_bucket).select("fp").distinct()
    if max_bits < 2:
        near = hot.select("fp", F.col("fp").alias("near"))  # distinct fingerprints: 0 bits link nothing more
        if max_bits == 1:  # one bit apart: one of the two has the lower parity, so it is a neighbour of the other
            even = F.bit_count("fp") % 2 == 0
            near = hot.select("fp", F.explode(F.when(even, F.array("fp")).otherwise(_flips("fp"))).alias("near"))
            stars = near.where(even).select(F.col("fp").alias("u"), "near")
            odd = near.where(~even).select(F.col("fp").alias("v"), "near")
            return pairs.unionByName(stars.join(odd, "near").select("u", "v"))
    else:
        near = hot.select("fp", F.explode(F.concat(F.array("fp"), _flips("fp"))).alias("near"))
    members = near.groupBy("near").agg(F.min("fp").alias("u"), F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = members.select("u", F.explode("fps").alias("v")).where("u <> v")
    return pairs.unionByName(stars)


def _flips(col: str) -> Column:
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    return F.transform(F.lit(bits).cast("array<bigint>"), lambda m: F.col(col).bitwiseXOR(m))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    max_bits: int = 2, blocks: int = 4, extra: tuple | list = ()) -> DataFrame:
    """(id, fp, component_id, *extra): component_id is the smallest id reachable by links of at most ``max_bits`` bits."""
    fps = stored(fingerprints(docs, id_col, text_col, width, extra), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("id").alias("low"))
    comp = connected_components(near_links(nodes.select("fp"), max_bits, blocks))
    joined = nodes.join(comp, nodes.fp == comp.node, "left").select(
        "fp", "low", F.coalesce("component", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = joined.join(roots, "root").select(F.col("fp").alias("node_fp"), "component_id")
    return fps.join(by_fp, fps.fp == by_fp.node_fp).select("id", "fp", "component_id", *extra)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
             max_bits: int = 2) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id.

    Rows repeating both id and text are one document. Rows without an id go if any
    member of their group has one; a group of rows without ids stays whole.
    """
    mark = "_postlens_hash"
    while mark in docs.columns:
        mark += "_"
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    near = near_duplicates(marked, id_col, text_col, width, max_bits, extra=[mark])
    drop = near.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(
        F.col("id").alias("_drop_id"), F.col(mark).alias("_drop_hash")).distinct()
    same = marked[id_col].eqNullSafe(drop["_drop_id"]) & (marked[mark] == drop["_drop_hash"])
    kept = marked.join(drop, same, "left_anti")
    return kept.dropDuplicates([id_col, mark]).drop(mark)

"""Helpers shared by the training-data operators: shared-folder tables, word splitting, graph components."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; it is removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: lineage ends there."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(col: str | Column, m: int) -> Column:
    """crc32 of the id's decimal text, modulo ``m`` (null id: of the empty text)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` is the fast path where the text holds nothing else."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, low))


def text_pieces(text: bytes, size: int = 1 << 20):
    """A text cut at white space ``[\\x20\\x09-\\x0D]`` into pieces of about ``size`` bytes."""
    start = 0
    while start < len(text):
        end = min(start + size, len(text))
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[start:end] if end - start < len(text) else text
        start = end


def word_pieces(text: bytes, size: int = 1 << 20):
    """Lists of the lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a text, about ``size`` bytes at a time.

    ``bytes.lower`` changes A-Z only and ``bytes.split`` cuts at exactly these six
    white-space bytes, so a very long text is never held as one list of words.
    """
    for piece in text_pieces(text, size):
        yield piece.lower().split()


class Memo(dict):
    """``make(key)`` kept for keys used lately: two generations of at most ``cap`` entries and ``size`` bytes of keys each."""

    def __init__(self, make, cap: int = 100_000, size: int = 8 << 20):
        super().__init__()
        self.make, self.cap, self.size, self.old, self.held = make, cap, size, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.cap or self.held >= self.size:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = value
        self.held += len(key) if isinstance(key, (bytes, str)) else 8
        return value


def worker_store(key: str) -> dict:
    """What the tasks of one operator share in this Python worker process; asking for another key drops it."""
    mod = sys.modules.setdefault("_postlens_worker_store", types.ModuleType("_postlens_worker_store"))
    if getattr(mod, "live", (None,))[0] != key:
        mod.live = (key, {})
    return mod.live[1]


def lean(run, key: str = ""):
    """``run`` for mapInArrow; a worker drops what other operators cached before it and gives unused memory back after it."""

    def task(batches):
        import ctypes

        import pyarrow as pa

        worker_store(key)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps freed memory otherwise
            if trim:
                trim(0)

    return task


def binary_texts(docs: DataFrame, id_col: str, text_col: str, extra: tuple | list = ()) -> DataFrame:
    """(id, text as UTF-8 bytes, null as empty, *extra): what the Arrow operators read; other columns stay behind."""
    return docs.select(F.col(id_col).alias("id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"), *extra)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; component = smallest node reachable.

    Alternating large-star and small-star steps: each is one minimum per node
    (partially aggregated) and one equi-join, so a hub's edges may be split over
    tasks, and a path of n nodes needs O(log n) rounds. Each round is written to
    the shared folder; only its row count and one checksum reach the driver.
    """
    u, v = F.col("u"), F.col("v")
    e = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    e = stored(e, "edges")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        low = both.groupBy("u").agg(F.least(u, F.min("v")).alias("m"))
        large = both.where(v > u).join(low, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = stored(small.select(F.explode(F.array(
            F.struct(u.alias("u"), F.col("m").alias("v")),
            F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where(u != v).distinct(), "edges")
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == last:
            break
        last = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(v.alias("node"), v.alias("component")).distinct()
    return e.select(u.alias("node"), v.alias("component")).unionByName(roots)

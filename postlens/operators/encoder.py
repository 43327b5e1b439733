"""A trained text encoder: latent semantic directions of the corpus by randomised SVD, all products distributed.

Texts are counted once (distinct words hashed into ``buckets``, log-scaled counts) and become sparse rows (times inverse
document frequency, length one), both written to the shared folder. With X these rows, a pass adds up X^T (X Q) for the
current directions Q: each task multiplies its own rows and leaves one ``buckets`` x ``width`` sum, summed again in
about sqrt(tasks) groups before it reaches the driver, which makes the directions orthonormal for the next
pass. After ``passes`` of these the leading directions of X^T X in their span are the encoder; its size depends on
``buckets`` and ``dim``, not on the corpus. Encoding is one product per text, without a shuffle.

Words are runs of ``\\w`` in lower case. Null, empty and wordless texts encode to zeros and weigh nothing in the fit.
Texts of any length are read whole. A corpus with fewer directions than ``dim`` fills up with zeros. Rows may repeat. Other
columns, whatever their names, stay as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.session import stored

CHUNK = 1 << 16  # entries of sparse rows multiplied at a time,
BLOCK = 512      # of at most this many rows


def counted(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers, ascending; log-scaled counts) of a text's words."""
    words = Counter(re.findall(r"\w+", (text or "").lower()))
    at = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int32, len(words))
    idx, place = np.unique(at, return_inverse=True)
    return idx, 1 + np.log(np.bincount(place, np.fromiter(words.values(), float, len(words)), len(idx)))


def weighed(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    idx, val = counted(text, len(idf))
    val = val * idf[idx]
    size = np.linalg.norm(val)
    return idx, val / size if size else val


def _sums(df: DataFrame, make, size: int) -> np.ndarray:
    """Sum over all tasks of the vectors of ``size`` that ``make(batches)`` returns: in sqrt(tasks) groups, then here."""

    def partial(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([make(batches).tobytes()], pa.binary())], ["s"])

    def again(batches):
        import pyarrow as pa

        total = np.zeros(size)
        for b in batches:
            for s in b.column(0):
                total += np.frombuffer(s.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["s"])

    groups = max(1, math.isqrt(df.rdd.getNumPartitions()))
    rows = df.mapInArrow(partial, "s binary").repartition(groups).mapInArrow(again, "s binary").collect()
    return sum((np.frombuffer(r["s"]) for r in rows), np.zeros(size))


def gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """X^T (X q) over all sparse rows (idx, val)."""

    def make(batches):
        out = np.zeros_like(q)
        for b in batches:
            counts = np.diff(b.column(0).offsets.to_numpy())
            idx, val = b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(counts)])
            at = 0
            while at < b.num_rows:
                to = min(max(at + 1, int(np.searchsorted(ends, ends[at] + CHUNK, "right")) - 1), at + BLOCK)
                used, place = np.unique(idx[ends[at]:ends[to]], return_inverse=True)
                x = np.zeros((to - at, len(used)))  # few rows and only their buckets, so full products are fast and small
                x[np.repeat(np.arange(to - at), counts[at:to]), place] = val[ends[at]:ends[to]]
                out[used] += x.T @ (x @ q[used])
                at = to
        return out

    return _sums(rows, make, q.size).reshape(q.shape)


@dataclass
class Encoder:
    idf: np.ndarray
    axes: np.ndarray    # buckets x dim, orthonormal, leading first
    values: np.ndarray  # eigenvalues of X^T X along them

    def encode(self, df: DataFrame, text_col: str = "text", out: str = "embedding") -> DataFrame:
        """``df`` with ``out``: the text's place along the axes, of length one (zeros where it has none)."""
        names = [c for c in df.columns if c != out]
        src = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
        idf, axes = self.idf, self.axes

        def run(batches):
            import pyarrow as pa

            for b in batches:
                place = np.zeros((b.num_rows, axes.shape[1]))
                for k, t in enumerate(b.column(1)):
                    idx, val = weighed(t.as_py(), idf)
                    place[k] = val @ axes[idx]
                size = np.linalg.norm(place, axis=1, keepdims=True)
                place = np.divide(place, size, out=np.zeros_like(place), where=size > 1e-12)
                at = pa.array(np.arange(0, place.size + 1, axes.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, pa.array(place.ravel()))], ["row", "e"])

        schema = T.StructType([src.schema["row"], T.StructField("e", T.ArrayType(T.DoubleType()))])
        return src.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in names], F.col("e").alias(out))


def train_encoder(df: DataFrame, text_col: str = "text", dim: int = 64, buckets: int = 8192, passes: int = 4, extra: int = 16, seed: int = 42) -> Encoder:
    """The encoder of a corpus: ``passes`` + 3 readings, of which only the first reads texts."""
    texts = df.select(F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(batches):
        import pyarrow as pa

        for b in batches:
            got = [counted(t.as_py(), buckets) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float64()))],
                                             ["idx", "val"])

    kind = "idx array<int>, val array<double>"
    counts = stored(texts.mapInArrow(count, kind), "encoder-counts")

    def documents(batches):
        out = np.zeros(buckets + 1)
        for b in batches:
            out[:-1] += np.bincount(b.column(0).flatten().to_numpy(), minlength=buckets)
            out[-1] += b.num_rows
        return out

    seen = _sums(counts, documents, buckets + 1)
    idf = np.log((seen[-1] + 1) / (seen[:-1] + 1)) + 1

    def weigh(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column(0)), 0))
            if not b.num_rows:
                continue
            sizes = np.diff(b.column(0).offsets.to_numpy())
            idx, val = b.column(0).flatten(), b.column(1).flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            val = val * idf[idx.to_numpy()]
            val /= np.repeat(np.sqrt(np.add.reduceat(val * val, ends[:-1])), sizes)
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, idx), pa.ListArray.from_arrays(ends, pa.array(val))], ["idx", "val"])

    rows = stored(counts.mapInArrow(weigh, kind), "encoder-rows")
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(buckets, min(dim + extra, buckets))))[0]
    for _ in range(passes):
        q = np.linalg.qr(gram_times(rows, q))[0]
    values, turn = np.linalg.eigh(q.T @ gram_times(rows, q))
    values, turn = values[::-1][:dim], turn[:, ::-1][:, :dim]
    axes = (q @ turn) * (values > 1e-9)
    return Encoder(idf, axes, np.maximum(values, 0))

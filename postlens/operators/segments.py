"""Word-level text shapes: segments, sliding windows, per-user word streams.

All of them work on the token array of ``functions.text.words`` with
``sequence`` / ``slice`` / ``transform`` / ``posexplode``; no Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import words
from postlens.operators.ordered import running_sum


def _starts(n, step: int):
    # sequence(0, n-1, step) fails for n = 0, so guard it
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def segment_posts(df: DataFrame, size: int = 100, text_col: str = "text", tid_col: str = "TID") -> DataFrame:
    """Split each text into runs of at most ``size`` words; TID gets ``_1``, ``_2``...

    word_count is recomputed per segment; empty or null text gives no row.
    """
    base = df.withColumn("_w", F.coalesce(words(text_col), F.array().cast("array<string>")))
    n = F.size("_w")
    segs = F.transform(_starts(n, size), lambda i: F.slice(F.col("_w"), i + 1, F.lit(size)))
    out = base.select(*[c for c in df.columns], F.posexplode(segs).alias("_i", "_seg"))
    return (out.withColumn(text_col, F.array_join("_seg", " "))
            .withColumn("word_count", F.size("_seg").cast("long"))
            .withColumn(tid_col, F.concat_ws("_", F.col(tid_col), (F.col("_i") + 1).cast("string")))
            .drop("_i", "_seg"))


def sliding_chunks(df: DataFrame, size: int = 50, overlap: int = 25, text_col: str = "text",
                   chunk_col: str = "ChunkID") -> DataFrame:
    """Windows of ``size`` words starting every ``size - overlap`` words while start < n.

    Trailing short windows are kept (as published); chunk ids start at 1.
    """
    step = size - overlap
    base = df.withColumn("_w", F.coalesce(words(text_col), F.array().cast("array<string>")))
    n = F.size("_w")
    wins = F.transform(_starts(n, step), lambda i: F.array_join(F.slice(F.col("_w"), i + 1, F.lit(size)), " "))
    out = base.select(*[c for c in df.columns if c != text_col], F.posexplode(wins).alias("_i", text_col))
    return out.withColumn(chunk_col, (F.col("_i") + 1).cast("long")).drop("_i")


def user_word_offsets(df: DataFrame, order: Sequence, user_col: str = "user_id", text_col: str = "text") -> DataFrame:
    """The ordered concatenation of a user's texts, kept distributed.

    Instead of one string per user (unbounded: one user may hold a third of the
    corpus), every post gets ``word_offset``: the position of its first word in
    the user's blank-joined text. Offsets come from the skew-safe running sum.
    """
    base = df.where(F.col(user_col).isNotNull()).withColumn(
        "n_words", F.size(F.coalesce(words(text_col), F.array().cast("array<string>"))).cast("long"))
    return running_sum(base, [user_col], order, "n_words", "word_offset", exclusive=True)


def user_sliding_chunks(df: DataFrame, order: Sequence, size: int = 50, overlap: int = 25, user_col: str = "user_id",
                        text_col: str = "text", chunk_col: str = "ChunkID") -> DataFrame:
    """Sliding word windows over each user's concatenated texts, one row per window.

    Every post emits only the pieces of the windows it overlaps (window j covers
    words [j*step, j*step+size) of the user's stream); pieces are then grouped by
    (user, window). A group holds at most ``size`` words, so no user's text is
    ever gathered in one place.
    """
    step = size - overlap
    off = user_word_offsets(df, order, user_col, text_col)
    base = off.withColumn("_w", F.coalesce(words(text_col), F.array().cast("array<string>")))
    o, n = F.col("word_offset"), F.col("n_words")
    j_lo = F.greatest(F.lit(0), F.floor((o - F.lit(size)) / F.lit(step)) + 1).cast("long")
    j_hi = F.floor((o + n - 1) / F.lit(step)).cast("long")
    js = F.when(n > 0, F.sequence(j_lo, j_hi)).otherwise(F.array().cast("array<bigint>"))
    pieces = base.select(user_col, "_w", o.alias("_o"), n.alias("_n"), F.explode(js).alias("_j"))
    a = F.greatest(F.col("_j") * step - F.col("_o"), F.lit(0))
    b = F.least(F.col("_j") * step + size - F.col("_o"), F.col("_n"))
    pieces = pieces.select(user_col, "_j", F.struct((F.col("_o") + a).alias("start"),
                                                    F.array_join(F.slice("_w", (a + 1).cast("int"), (b - a).cast("int")), " ")
                                                    .alias("piece")).alias("_p"))
    grouped = pieces.groupBy(user_col, "_j").agg(F.sort_array(F.collect_list("_p")).alias("_ps"))
    return grouped.select(user_col, (F.col("_j") + 1).cast("long").alias(chunk_col),
                          F.array_join(F.transform("_ps", lambda p: p["piece"]), " ").alias(text_col))

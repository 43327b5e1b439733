"""Per-user ordered selections: word budget, median-length post, whole-user cut."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.text import user_from_tid, word_count
from postlens.operators.ordered import row_position, running_sum


def word_budget(df: DataFrame, order: Sequence, max_words: int = 1500, user_col: str = "user_id",
                text_col: str = "text") -> DataFrame:
    """Take a user's posts in order while the running word total stays <= max_words.

    Stopping at the first overflow equals ``running total <= max`` because word
    counts are non-negative. Null users are dropped (grouping drops them).
    """
    base = df.where(F.col(user_col).isNotNull()).withColumn("word_count", word_count(text_col))
    rs = running_sum(base, [user_col], order, "word_count", "running_words")
    return rs.where(F.col("running_words") <= max_words)


def median_post(df: DataFrame, order: Sequence, user_col: str = "user_id", text_col: str = "text") -> DataFrame:
    """Per user, the post at 0-based index n // 2 when sorted by word count (upper middle)."""
    base = df.where(F.col(user_col).isNotNull()).withColumn("word_count", word_count(text_col))
    ranked = row_position(base, ["word_count", *order], out="_rank", keys=[user_col], key_total="posts")
    return ranked.where(F.col("_rank") == F.floor(F.col("posts") / 2) + 1).drop("_rank")


def cut_whole_user(df: DataFrame, order: Sequence, limit: int = 100_000, tid_col: str = "TID") -> DataFrame:
    """First ``limit`` rows, then only the directly following rows of row ``limit``'s user.

    ``order`` is a total order. The row at the limit is the last of the first ``limit``
    rows (a top-n in every task), the cut is the least later row of another user (one
    aggregate), and what comes before it is kept: nothing is numbered or sorted whole.
    """
    base = df.withColumn("_user", user_from_tid(tid_col)).withColumn("_ord", F.struct(*order))
    first = base.select("_ord", "_user").orderBy("_ord").limit(limit)
    edge = first.agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("_ord", "_user")).alias("last")).where(
        F.col("n") == limit).select("last._ord", F.col("last._user").alias("_user"))
    edge = F.broadcast(edge.select(F.col("_ord").alias("_edge"), F.col("_user").alias("_edge_user")))  # one row at most
    later = base.select("_ord", "_user").join(edge, (F.col("_ord") > F.col("_edge"))
                                              & ~F.col("_user").eqNullSafe(F.col("_edge_user")))
    stop = later.agg(F.min("_ord")).scalar()
    return base.where(stop.isNull() | (F.col("_ord") < stop)).drop("_user", "_ord")

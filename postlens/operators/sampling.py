"""First-n, top-k and seeded sampling operators.

Randomness is a seeded md5 rank (``ordered.md5_rank_key``), so a sample is
reproducible, independent of partitioning, and equal to the DuckDB oracle.
Limits appear only where the limit is the feature (first n, sample of n).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.operators.ordered import first_by_order, md5_rank_key, running_sum


def first_rows(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """First n rows in ``order`` (TakeOrderedAndProject: a per-partition top-n, then a merge)."""
    return df.orderBy(*order).limit(n)


def first_n_users(df: DataFrame, n: int = 50, order: Sequence = ("ord",), user_col: str = "user_id") -> DataFrame:
    """All rows of the first n users by first appearance.

    First appearance = min(order) per user (partial hash aggregate); the top n of
    those is bounded by n, so it is broadcast into the semi join.
    """
    firsts = df.where(F.col(user_col).isNotNull()).groupBy(user_col).agg(
        F.min(F.struct(*[F.col(o) for o in order])).alias("_first"))
    top = firsts.orderBy("_first").limit(n).select(user_col)
    return df.join(F.broadcast(top), user_col, "left_semi")


def first_n_users_lexical(df: DataFrame, n: int = 3575, user_col: str = "user_id") -> DataFrame:
    """Rows of the first n user ids in string order (a grouped frame's order)."""
    top = df.select(F.col(user_col).cast("string").alias("_u")).where(F.col("_u").isNotNull()).distinct() \
        .orderBy("_u").limit(n)
    return df.join(F.broadcast(top), F.col(user_col).cast("string") == F.col("_u"), "left_semi")


def first_n_matching(df: DataFrame, cond: Column, n: int = 2700, order: Sequence = ("ord",),
                     strict: bool = True) -> DataFrame:
    """First n rows that satisfy ``cond``; with ``strict`` the call is refused when fewer match.

    The refusal counts up to n rows at once. Non-strict mode keeps the rows and
    reports ``enough`` instead.
    """
    matching = df.where(cond)
    if strict:
        _refuse_below(matching, n, "matching rows")
    count = matching.select(F.count(F.lit(1))).scalar()
    return matching.orderBy(*order).limit(n).withColumn("enough", count >= F.lit(n))


def _refuse_below(df: DataFrame, n: int, what: str) -> None:
    found = df.limit(n).count()
    if found < n:
        raise ValueError(f"{n} {what} are asked for, there are {found}")


def sample_user_posts(df: DataFrame, n: int = 100, seed: int = 42, user_col: str = "user_id",
                      key_col: str = "TID", strict: bool = True) -> DataFrame:
    """One seeded-random post from each of n seeded-random users (null users never chosen).

    Users: top n by md5 rank (bounded by n, broadcast). Post per user: min of
    (md5 rank, key) as a partial aggregate, so a hot user costs no single-task sort.
    """
    users = df.where(F.col(user_col).isNotNull()).select(user_col).distinct()
    if strict:
        _refuse_below(users, n, "users")
    chosen = users.orderBy(md5_rank_key(seed, user_col), user_col).limit(n)
    rows = df.join(F.broadcast(chosen), user_col, "left_semi").withColumn("_h", md5_rank_key(seed, key_col))
    return first_by_order(rows, [user_col], ["_h", key_col], cols=[c for c in df.columns])


def sample_texts(df: DataFrame, n: int = 5, seed: int = 42, text_col: str = "text", key_col: str = "TID") -> DataFrame:
    """n seeded-random non-null texts, numbered 1..n in sample order."""
    h = md5_rank_key(seed, key_col)
    top = df.where(F.col(text_col).isNotNull()).select(key_col, text_col, h.alias("_h")).orderBy("_h", key_col).limit(n)
    packed = top.agg(F.sort_array(F.collect_list(F.struct("_h", key_col, text_col))).alias("_s"))
    return packed.select(F.posexplode("_s").alias("_i", "_r")).select(
        (F.col("_i") + 1).cast("long").alias("example_no"), F.col(f"_r.{text_col}").alias(text_col))


def numbered_block(examples: DataFrame, text_col: str = "text") -> DataFrame:
    """``1. text\\n2. text ...`` from (example_no, text) rows (n is small by construction)."""
    s = examples.agg(F.sort_array(F.collect_list(F.struct("example_no", text_col))).alias("_s"))
    return s.select(F.array_join(F.transform("_s", lambda x: F.concat(x["example_no"].cast("string"), F.lit(". "),
                                                                       x[text_col])), "\n").alias("examples"))


def class_sample(df: DataFrame, frac: float, seed: int = 42, label_col: str = "y", key_cols: Sequence[str] = ("user_id",),
                 rounding: str = "floor") -> DataFrame:
    """Keep ``floor(n_c * frac)`` (or ``round``) seeded-random rows of every class.

    The per-class rank comes from the skew-safe running count, so a class holding
    half of the data is still ranked by many tasks.
    """
    ranked = running_sum(df.withColumn("_h", md5_rank_key(seed, *key_cols)), [label_col],
                         ["_h", *key_cols], F.lit(1), "_rank", key_total="_n")
    if rounding == "floor":
        keep = F.floor(F.col("_n") * F.lit(frac))
    else:  # pandas frac= rounds half to even
        keep = F.bround(F.col("_n") * F.lit(frac), 0)
    return ranked.where(F.col("_rank") <= keep).drop("_h", "_rank", "_n")

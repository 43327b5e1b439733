"""Corpus preparation: filters, gates, joins, per-user aggregates, set operations.

All functions are ``DataFrame -> DataFrame`` (plus keyword parameters carrying
the published defaults) and never collect data to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.text import as_text, normalize_column_name, py_strip, word_count
from postlens.operators.ordered import row_position

# FIXED VALUES: sentinels and openers of rejected generations.
REJECT_CONTAINS = "[No valid comment generated]"
REJECT_STARTS = ("Here", "AI")
NON_FEATURE_COLS = ("TID", "sid", "label", "source", "model", "user_id")


# ----------------------------------------------------------------- filters ---

def rejected_generation(text_col: str = "Generated Text") -> Column:
    t = as_text(text_col)
    cond = t.contains(REJECT_CONTAINS)
    for s in REJECT_STARTS:
        cond = cond | t.startswith(s)
    return cond


def clean_generated(df: DataFrame, text_col: str = "Generated Text") -> DataFrame:
    """Drop rows whose text holds the no-comment sentinel or starts with Here / AI."""
    require_columns(df, [text_col])
    return df.where(~F.coalesce(rejected_generation(text_col), F.lit(False)))


def clean_generated_counts(df: DataFrame, text_col: str = "Generated Text") -> DataFrame:
    """rows, removed, kept of ``clean_generated`` in one pass."""
    rej = F.coalesce(rejected_generation(text_col), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(rej).alias("removed"),
                  F.count_if(~rej).alias("kept"))


def filter_word_range(df: DataFrame, lo: int = 30, hi: int = 200, col: str = "word_count") -> DataFrame:
    return df.where(F.col(col).between(lo, hi))


def filter_posts_only(df: DataFrame, type_col: str = "type", value: str = "post") -> DataFrame:
    return df.where(F.col(type_col) == value)


def filter_value(df: DataFrame, col: str, value: str) -> DataFrame:
    """``lower(strip(col)) == value`` (e.g. gender == 'male')."""
    return df.where(F.lower(py_strip(F.col(col).cast("string"))) == value)


def drop_nulls(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(subset))


def semi_join(df: DataFrame, ids: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Membership filter (``isin``) as a left-semi join; AQE broadcasts a small id side at runtime."""
    return df.join(ids, on=on, how="left_semi")


def anti_join(df: DataFrame, ids: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Negated membership as a left-anti join (no NOT IN null trap)."""
    return df.join(ids, on=on, how="left_anti")


# ------------------------------------------------------------------ schema ---

def normalize_columns(df: DataFrame, lower: bool = True) -> DataFrame:
    return df.toDF(*[normalize_column_name(c, lower) for c in df.columns])


def require_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"required column(s) not found: {missing}; available: {df.columns}")


def resolve_column(df: DataFrame, candidates: Sequence[str], out: str, case_insensitive: bool = True,
                   fallback: Column | None = None) -> DataFrame:
    """Rename the first existing candidate column to ``out`` (schema lookup only)."""
    lookup = {c.lower(): c for c in df.columns} if case_insensitive else {c: c for c in df.columns}
    for cand in candidates:
        key = cand.lower() if case_insensitive else cand
        if key in lookup:
            return df.withColumn(out, F.col(f"`{lookup[key]}`").cast("string"))
    if fallback is not None:
        return df.withColumn(out, fallback)
    raise KeyError(f"none of {list(candidates)} in {df.columns}")


def resolve_text(df: DataFrame, order: Sequence, out: str = "text", case_insensitive: bool = False) -> DataFrame:
    """The text column: ``text``, else ``comment_text``, else ``Comment i`` with i the 0-based row position in ``order``."""
    try:
        return resolve_column(df, ["text", "comment_text"], out, case_insensitive)
    except KeyError:
        pos = row_position(df, order, out="_pos")
        return pos.withColumn(out, F.concat(F.lit("Comment "), (F.col("_pos") - 1).cast("string"))).drop("_pos")


def feature_columns(df: DataFrame, exclude: Sequence[str] = NON_FEATURE_COLS) -> list[str]:
    """Numeric columns not excluded (``wid`` is a feature, as published)."""
    return [f.name for f in df.schema.fields
            if f.name not in exclude and isinstance(f.dataType, T.NumericType)]


def label_encode(df: DataFrame, col: str, positive: str, out: str = "y") -> DataFrame:
    return df.withColumn(out, (F.col(col) == positive).cast("long"))


# ------------------------------------------------------------------- gates ---

def gate_report(df: DataFrame, required_cols: Sequence[str] = (), min_rows: int | None = None,
                min_users: int | None = None, user_col: str = "user_id",
                not_null: Sequence[str] = ()) -> DataFrame:
    """All gates as one table (gate, observed, required, passed), computed in one pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    if min_users is not None:
        aggs.append(F.countDistinct(user_col).alias("users"))
    for c in not_null:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"null_{c}"))
    a = df.agg(*aggs)
    rows = []
    for c in required_cols:
        present = c in df.columns
        rows.append(F.struct(F.lit(f"column:{c}").alias("gate"), F.lit(1 if present else 0).cast("long").alias("observed"),
                             F.lit(1).cast("long").alias("required"), F.lit(present).alias("passed")))
    if min_rows is not None:
        rows.append(F.struct(F.lit("min_rows").alias("gate"), F.col("rows").cast("long").alias("observed"),
                             F.lit(min_rows).cast("long").alias("required"), (F.col("rows") >= min_rows).alias("passed")))
    if min_users is not None:
        rows.append(F.struct(F.lit("min_users").alias("gate"), F.col("users").cast("long").alias("observed"),
                             F.lit(min_users).cast("long").alias("required"), (F.col("users") >= min_users).alias("passed")))
    for c in not_null:
        rows.append(F.struct(F.lit(f"no_nulls:{c}").alias("gate"), F.col(f"null_{c}").cast("long").alias("observed"),
                             F.lit(0).cast("long").alias("required"), (F.col(f"null_{c}") == 0).alias("passed")))
    return a.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def enforce(df: DataFrame, check: Column, message: str) -> DataFrame:
    """Rows pass only while ``check`` holds; the query fails with ``message`` on a row where it is false or null."""
    return df.where(F.when(check, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


# ------------------------------------------------------------------- joins ---

def match_posts(posts: DataFrame, meta: DataFrame, on: Sequence[str] = ("user_id", "post_id"),
                null_safe: bool = False, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner equi-join; clashing non-key columns get pandas-style ``_x`` / ``_y`` suffixes."""
    on = list(on)
    clash = (set(posts.columns) & set(meta.columns)) - set(on)
    left = posts.select(*[F.col(c).alias(c + suffixes[0]) if c in clash else F.col(c) for c in posts.columns])
    right = meta.select(*[F.col(c).alias(c + suffixes[1]) if c in clash else F.col(c).alias(c if c not in on else f"_r_{c}")
                          for c in meta.columns])
    cond = None
    for k in on:
        c = left[k].eqNullSafe(right[f"_r_{k}"]) if null_safe else (left[k] == right[f"_r_{k}"])
        cond = c if cond is None else cond & c
    out = left.join(right, cond, "inner")
    return out.drop(*[f"_r_{k}" for k in on])


def compare_distributions(manual: DataFrame, automated: DataFrame) -> DataFrame:
    """Full outer merge of two (Trait, Normalized, Count) tables; missing counts are 0."""
    m = manual.groupBy("Trait", "Normalized").agg(F.sum("Count").cast("long").alias("manual_count"))
    a = automated.groupBy("Trait", "Normalized").agg(F.sum("Count").cast("long").alias("automated_count"))
    j = m.join(a, ["Trait", "Normalized"], "full_outer")
    return j.select(F.initcap("Trait").alias("trait_title"), "Trait", "Normalized",
                    F.coalesce("manual_count", F.lit(0)).cast("long").alias("manual_count"),
                    F.coalesce("automated_count", F.lit(0)).cast("long").alias("automated_count"))


def union_ids(*dfs: DataFrame, col: str = "user_id") -> DataFrame:
    out = None
    for d in dfs:
        s = d.select(F.col(col).cast("string").alias(col))
        out = s if out is None else out.union(s)
    return out.distinct()


def union_groups(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# -------------------------------------------------------------- aggregates ---

def users_with_post_count(df: DataFrame, lo: int = 0, hi: int = 200, user_col: str = "user_id") -> DataFrame:
    """Rows of users whose post count (after earlier filters) lies in [lo, hi]."""
    counts = df.groupBy(user_col).count().where(F.col("count").between(lo, hi)).select(user_col)
    return df.join(counts, user_col, "left_semi")


def user_word_stats(df: DataFrame, user_col: str = "user_id", wc_col: str = "word_count") -> DataFrame:
    return df.groupBy(user_col).agg(
        F.count(F.lit(1)).alias("posts"),
        F.sum(wc_col).cast("long").alias("words"),
        (F.sum(wc_col) / F.count(F.lit(1))).alias("avg_words"),
    )


def hist2d(stats: DataFrame, x: str = "posts", y: str = "avg_words", step: int = 5, hi: int = 200) -> DataFrame:
    """numpy.histogram2d on [0, hi] x [0, hi] with ``step``-wide bins (last bin closed).

    Values outside are dropped; the full grid is returned with zero counts.
    """
    nb = hi // step

    def b(c):
        return F.least(F.floor(F.col(c) / F.lit(float(step))), F.lit(nb - 1)).cast("long")

    inside = stats.where(F.col(x).between(0, hi) & F.col(y).between(0, hi))
    counts = inside.groupBy(b(x).alias("x_bin"), b(y).alias("y_bin")).agg(F.count(F.lit(1)).alias("users"))
    spark = stats.sparkSession
    # the (hi/step)^2 grid is generated, not joined: bounded by the parameters
    grid = spark.range(nb).select(F.col("id").alias("x_bin"),
                                  F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("y_bin"))
    return (grid.join(F.broadcast(counts), ["x_bin", "y_bin"], "left")
            .select((F.col("x_bin") * step).alias("x_lo"), (F.col("y_bin") * step).alias("y_lo"),
                    F.coalesce("users", F.lit(0)).cast("long").alias("users")))


def distinct_users(df: DataFrame, user_col: str = "user_id", group_col: str | None = None) -> DataFrame:
    g = [group_col] if group_col else []
    return df.groupBy(*g).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(user_col).alias("users"))


def user_feature_means(df: DataFrame, features: Sequence[str] | None = None, user_col: str = "user_id",
                       extra_keys: Sequence[str] = ()) -> DataFrame:
    """Mean of every feature per user: one hash aggregate with partial aggregation."""
    feats = list(features) if features is not None else feature_columns(df, NON_FEATURE_COLS + tuple(extra_keys))
    return df.groupBy(user_col, *extra_keys).agg(*[F.avg(c).alias(c) for c in feats])


def with_word_count(df: DataFrame, text_col: str = "text", out: str = "word_count") -> DataFrame:
    return df.withColumn(out, word_count(text_col))


def to_post_schema(df: DataFrame, order: Sequence, text_col: str = "generated_text", label: str = "bipolar",
                   language: str = "en") -> DataFrame:
    """Generated rows -> post schema: user_id 1..N in row order, post_id 1, TID ``<uid>_1``."""
    require_columns(df, [text_col])
    pos = row_position(df, order, out="_uid")
    return pos.select(
        F.concat_ws("_", F.col("_uid").cast("string"), F.lit("1")).alias("TID"),
        F.col("_uid").alias("user_id"),
        F.lit(1).cast("long").alias("post_id"),
        F.lit(label).alias("label"),
        as_text(text_col).alias("text"),
        F.lit(language).alias("language"),
    )

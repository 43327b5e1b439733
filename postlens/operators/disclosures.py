"""Demographic disclosure mining: extraction, normalisation, de-duplication, distributions.

Two pipelines, as published:
* per post ("manual"): extract from each post, keep the latest disclosure per
  (user, trait) by creation time;
* per user stream ("automated"): sliding 50/25 word windows over the user's
  concatenated posts, keep the first disclosure per (user, trait) by window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.demographics import PATTERNS, TRAITS, extract_matches, normalize_trait, triggers
from postlens.functions.text import truncate_text
from postlens.operators.ordered import first_by_order
from postlens.operators.segments import user_sliding_chunks

DISCLOSURE_COLS = ["UserID", "Trait", "DisclosureType", "MatchedPhrase", "Normalized"]


def extract_disclosures(df: DataFrame, text_col: str = "text", keep: Sequence[str] = (),
                        compat: bool = True) -> DataFrame:
    """One row per match of any of the 43 patterns, in extraction order.

    Adds pattern_ord (trait -> explicit/implicit -> pattern order) and match_idx
    (position among the pattern's non-overlapping matches). Each text is read once by an
    automaton of what the patterns require; only patterns that can match are run.
    """
    traits = F.array(*[F.lit(t) for t, _, _, _ in PATTERNS])
    dtypes = F.array(*[F.lit(d) for _, d, _, _ in PATTERNS])
    masked = df.select(*keep, F.col(text_col).alias("_text"), triggers().column(F.col(text_col)).alias("_mask")).where("_mask <> 0")
    m = masked.select(*keep, F.explode(extract_matches("_text", "_mask")).alias("_m"))
    m = m.where(F.size("_m.matches") > 0)
    m = m.select(*keep, F.col("_m.pattern_ord").alias("pattern_ord"),
                 F.posexplode("_m.matches").alias("match_idx", "MatchedPhrase"))
    m = (m.withColumn("Trait", F.element_at(traits, F.col("pattern_ord") + 1))
         .withColumn("DisclosureType", F.element_at(dtypes, F.col("pattern_ord") + 1)))
    return m.withColumn("Normalized", normalize_trait("Trait", "MatchedPhrase", compat)).withColumn(
        "match_idx", F.col("match_idx").cast("long")).withColumn("pattern_ord", F.col("pattern_ord").cast("long"))


def latest_disclosures(posts: DataFrame, order: Sequence[str], user_col: str = "user_id", text_col: str = "text",
                       created_col: str = "created_utc", ids: DataFrame | None = None) -> DataFrame:
    """Per-post extraction, then the latest disclosure per (user, trait).

    Latest = highest creation time; ties by post order, pattern order, match
    position. The choice is a partial aggregate (min of a struct), not a window.
    """
    if ids is not None:
        posts = posts.join(ids, user_col, "left_semi")
    p = posts.withColumn("OriginalText", truncate_text(F.coalesce(F.col(text_col), F.lit(""))))
    ex = extract_disclosures(p, text_col, keep=[user_col, created_col, "OriginalText", *order])
    ex = ex.withColumn("UserID", F.concat(F.lit("user_"), F.col(user_col).cast("string"))).withColumn(
        "CreatedUTC", F.coalesce(F.col(created_col), F.lit(0)).cast("long"))
    return first_by_order(ex, ["UserID", "Trait"], ["CreatedUTC", *order, "pattern_ord", "match_idx"],
                          cols=[*DISCLOSURE_COLS, "CreatedUTC", "OriginalText"],
                          descending=[True] + [False] * (len(order) + 2))


def chunked_disclosures(posts: DataFrame, order: Sequence[str], user_col: str = "user_id", text_col: str = "text",
                        size: int = 50, overlap: int = 25, ids: DataFrame | None = None) -> DataFrame:
    """Windows over each user's concatenated texts, then the first disclosure per (user, trait)."""
    if ids is not None:
        posts = posts.join(ids, user_col, "left_semi")
    chunks = user_sliding_chunks(posts, order, size, overlap, user_col, text_col)
    ex = extract_disclosures(chunks, text_col, keep=[user_col, "ChunkID"])
    ex = ex.withColumn("UserID", F.concat(F.lit("user_"), F.col(user_col).cast("string")))
    return first_by_order(ex, ["UserID", "Trait"], ["ChunkID", "pattern_ord", "match_idx"],
                          cols=[*DISCLOSURE_COLS, "ChunkID"])


def trait_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("Trait", "Normalized").agg(F.count(F.lit(1)).alias("Count"))


def trait_evaluation(gold: DataFrame, pred: DataFrame, users: DataFrame, user_col: str = "UserID") -> DataFrame:
    """Confusion counts and P/R/F1 per (trait, explicit | implicit | overall).

    Universe: every user x trait. A pair is a true positive when both sides
    disclose the trait (with that type) and agree on the normalised value; a
    disagreement counts as one false positive and one false negative.
    """
    g = gold.select(user_col, "Trait", F.col("DisclosureType").alias("g_type"), F.col("Normalized").alias("g_val"))
    p = pred.select(user_col, "Trait", F.col("DisclosureType").alias("p_type"), F.col("Normalized").alias("p_val"))
    grid = users.select(user_col).distinct().select(user_col, F.explode(F.array(*[F.lit(t) for t in TRAITS])).alias("Trait"))
    j = grid.join(g, [user_col, "Trait"], "left").join(p, [user_col, "Trait"], "left")
    j = j.select("*", F.explode(F.array(F.lit("explicit"), F.lit("implicit"), F.lit("overall"))).alias("type"))
    has_g = F.col("g_val").isNotNull() & ((F.col("type") == "overall") | (F.col("g_type") == F.col("type")))
    has_p = F.col("p_val").isNotNull() & ((F.col("type") == "overall") | (F.col("p_type") == F.col("type")))
    agree = has_g & has_p & (F.col("g_val") == F.col("p_val"))
    c = j.groupBy(F.col("Trait").alias("trait"), "type").agg(
        F.count_if(agree).alias("TP"),
        F.count_if(has_p & ~agree).alias("FP"),
        F.count_if(has_g & ~agree).alias("FN"),
        F.count_if(~has_g & ~has_p).alias("TN"),
    )
    prec = F.when(F.col("TP") + F.col("FP") > 0, F.col("TP") / (F.col("TP") + F.col("FP"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("TP") + F.col("FN") > 0, F.col("TP") / (F.col("TP") + F.col("FN"))).otherwise(F.lit(0.0))
    c = c.withColumn("Precision", prec).withColumn("Recall", rec)
    f1 = F.when(F.col("Precision") + F.col("Recall") > 0,
                2 * F.col("Precision") * F.col("Recall") / (F.col("Precision") + F.col("Recall"))).otherwise(F.lit(0.0))
    return c.withColumn("F1", f1)

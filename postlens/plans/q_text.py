"""Catalog: text shapes (T), per-user windows (W), disclosure mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions import demographics as D
from postlens.functions.text import strip_quotes, truncate_text, user_from_tid
from postlens.operators import disclosures as X
from postlens.operators import segments as S
from postlens.operators import windows as W
from postlens.plans import views as V
from postlens.plans.oracle_text import (bin_age_sql, education_sql, extract_sql, gender_sql, strip_quotes_sql,
                                        windows_sql)
from postlens.plans.oracle_views import WORDS_RE2, define, wc_sql, with_views
from postlens.plans.registry import query

DOC_WORDS = f"(SELECT TID, user_id, regexp_extract_all(text, '{WORDS_RE2}') AS w FROM v_doc_posts)"


@query("segment_posts", with_views("v_doc_posts") + f"""
SELECT TID || '_' || CAST(st // 100 + 1 AS VARCHAR) AS TID, user_id,
       array_to_string(w[st + 1:st + 100], ' ') AS text, CAST(len(w[st + 1:st + 100]) AS BIGINT) AS word_count
FROM (SELECT TID, user_id, w, unnest(range(0, len(w), 100)) AS st FROM {DOC_WORDS})""", headline=True)
def q_segment_posts(spark, d):
    return S.segment_posts(V.v_doc_posts(spark, d), 100).select("TID", "user_id", "text", "word_count")


@query("sliding_chunks", with_views("v_doc_posts") + "SELECT * FROM " + windows_sql(DOC_WORDS, "TID", 50, 25))
def q_sliding_chunks(spark, d):
    return S.sliding_chunks(V.v_doc_posts(spark, d), 50, 25).select("TID", "ChunkID", "text")


@query("concat_user_text", with_views("v_posts") + f"""
SELECT user_id, TID, CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY conv_id, turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS word_offset, n AS n_words
FROM (SELECT *, CAST(len(coalesce(regexp_extract_all(text, '{WORDS_RE2}'), [])) AS BIGINT) AS n FROM v_posts
      WHERE user_id IS NOT NULL)""")
def q_concat_user_text(spark, d):
    return S.user_word_offsets(V.v_posts(spark, d), ["conv_id", "turn"]).select("user_id", "TID", "word_offset", "n_words")


def _user_words(cond: str = "user_id IS NOT NULL") -> str:
    return f"""(SELECT user_id, regexp_extract_all(string_agg(text, ' ' ORDER BY conv_id, turn), '{WORDS_RE2}') AS w
  FROM v_disclosure_posts WHERE {cond} GROUP BY user_id)"""


@query("user_sliding_chunks", with_views("v_disclosure_posts") + "SELECT * FROM " + windows_sql(_user_words(), "user_id", 50, 25))
def q_user_sliding_chunks(spark, d):
    return S.user_sliding_chunks(V.v_disclosure_posts(spark, d), ["conv_id", "turn"], 50, 25).select("user_id", "ChunkID", "text")


@query("word_budget", with_views("v_doc_posts") + f"""
SELECT user_id, post_id, word_count, running_words FROM (
  SELECT user_id, post_id, word_count,
         CAST(sum(word_count) OVER (PARTITION BY user_id ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_words
  FROM (SELECT *, {wc_sql('text')} AS word_count FROM v_doc_posts WHERE user_id IS NOT NULL))
WHERE running_words <= 1500""", headline=True)
def q_word_budget(spark, d):
    return W.word_budget(V.v_doc_posts(spark, d), ["doc_id"], 1500).select("user_id", "post_id", "word_count",
                                                                           "running_words")


@query("median_post", with_views("v_doc_posts") + f"""
SELECT user_id, post_id, word_count, posts FROM (
  SELECT user_id, post_id, word_count, row_number() OVER (PARTITION BY user_id ORDER BY word_count, doc_id) AS rn,
         count(*) OVER (PARTITION BY user_id) AS posts
  FROM (SELECT *, {wc_sql('text')} AS word_count FROM v_doc_posts WHERE user_id IS NOT NULL))
WHERE rn = posts // 2 + 1""")
def q_median_post(spark, d):
    return W.median_post(V.v_doc_posts(spark, d), ["doc_id"]).select("user_id", "post_id", "word_count", "posts")


SENT_ORDER = ["_ok", "_ln", "_pk", "sid"]


def sentences_ordered(spark, d):
    li = V.table(spark, d, "lineitem").select(
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("TID"),
        F.col("l_orderkey").alias("_ok"), F.col("l_linenumber").alias("_ln"), F.col("l_partkey").alias("_pk"),
        F.col("l_suppkey").alias("sid"))
    return li


@query("cut_whole_user", """
WITH p AS (SELECT CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS TID,
                  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_pos FROM lineitem),
     u AS (SELECT *, split_part(TID, '_', 1) AS usr FROM p),
     lim AS (SELECT usr FROM u WHERE row_pos = 4000),
     stp AS (SELECT min(row_pos) AS s FROM u WHERE row_pos > 4000 AND usr IS DISTINCT FROM (SELECT usr FROM lim))
SELECT TID FROM u
WHERE row_pos <= 4000 OR (SELECT s FROM stp) IS NULL OR row_pos < (SELECT s FROM stp)""")
def q_cut_whole_user(spark, d):
    return W.cut_whole_user(sentences_ordered(spark, d), SENT_ORDER, 4_000).select("TID")


@query("user_from_tid", with_views("v_sent") + "SELECT TID, split_part(TID, '_', 1) AS user_id FROM v_sent")
def q_user_from_tid(spark, d):
    return V.v_sent(spark, d).select("TID", user_from_tid("TID").alias("user_id"))


@query("truncate_text", with_views("v_doc_posts") + """
SELECT TID, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS text FROM v_doc_posts""")
def q_truncate_text(spark, d):
    return V.v_doc_posts(spark, d).select("TID", truncate_text("text").alias("text"))


@query("strip_quotes", with_views("v_generated") + "SELECT prompt_id, attempt, " + ", ".join(
    f"{strip_quotes_sql('text', v)} AS text_{v}" for v in "abcde") + " FROM v_generated")
def q_strip_quotes(spark, d):
    g = V.v_generated(spark, d)
    return g.select("prompt_id", "attempt", *[strip_quotes("text", v).alias(f"text_{v}") for v in "abcde"])


# ------------------------------------------------------------ disclosures ---

def post_users(spark, d):
    """The listed users of the disclosure pipelines: everyone with at least one post."""
    return V.v_posts(spark, d).where(F.col("type") == "post").select("user_id").distinct()


POST_USERS_SQL = "(SELECT user_id FROM v_posts WHERE type = 'post')"

def _extract_posts_sql():
    keep = "TID, user_id, conv_id, turn, created_utc, OriginalText"
    src = (f"(SELECT TID, user_id, conv_id, turn, created_utc, text, "
           f"CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS OriginalText "
           "FROM v_disclosure_posts)")
    return extract_sql(src, "text", keep.split(", "))


define("ex_posts", ["v_disclosure_posts", "v_posts"], _extract_posts_sql())


@query("extract_disclosures", with_views("ex_posts") +
       "SELECT TID, pattern_ord, match_idx, Trait, DisclosureType, MatchedPhrase, Normalized FROM ex_posts")
def q_extract_disclosures(spark, d):
    return X.extract_disclosures(V.v_disclosure_posts(spark, d), keep=["TID"]).select(
        "TID", "pattern_ord", "match_idx", "Trait", "DisclosureType", "MatchedPhrase", "Normalized")


def _phrases(spark, d):
    return X.extract_disclosures(V.v_disclosure_posts(spark, d), keep=["TID"]).select("TID", "pattern_ord", "match_idx", "MatchedPhrase")


@query("bin_age", with_views("ex_posts") +
       f"SELECT TID, pattern_ord, match_idx, {bin_age_sql('MatchedPhrase')} AS age_bin FROM ex_posts")
def q_bin_age(spark, d):
    return _phrases(spark, d).select("TID", "pattern_ord", "match_idx", D.bin_age("MatchedPhrase").alias("age_bin"))


@query("normalize_gender", with_views("ex_posts") +
       f"SELECT TID, pattern_ord, match_idx, {gender_sql('MatchedPhrase')} AS gender FROM ex_posts")
def q_normalize_gender(spark, d):
    return _phrases(spark, d).select("TID", "pattern_ord", "match_idx",
                                     D.normalize_gender("MatchedPhrase").alias("gender"))


@query("normalize_education", with_views("ex_posts") +
       f"SELECT TID, pattern_ord, match_idx, {education_sql('MatchedPhrase')} AS education FROM ex_posts")
def q_normalize_education(spark, d):
    return _phrases(spark, d).select("TID", "pattern_ord", "match_idx",
                                     D.normalize_education("MatchedPhrase").alias("education"))


def manual(spark, d):
    return X.latest_disclosures(V.v_disclosure_posts(spark, d), ["conv_id", "turn"], ids=post_users(spark, d))


def automated(spark, d):
    return X.chunked_disclosures(V.v_disclosure_posts(spark, d), ["conv_id", "turn"], ids=post_users(spark, d))


define("manual", ["ex_posts"], """
SELECT UserID, Trait, DisclosureType, MatchedPhrase, Normalized, CreatedUTC, OriginalText FROM (
  SELECT 'user_' || user_id AS UserID, Trait, DisclosureType, MatchedPhrase, Normalized,
         CAST(coalesce(created_utc, 0) AS BIGINT) AS CreatedUTC, OriginalText,
         row_number() OVER (PARTITION BY user_id, Trait
                            ORDER BY coalesce(created_utc, 0) DESC, conv_id, turn, pattern_ord, match_idx) AS rn
  FROM ex_posts WHERE user_id IN """ + POST_USERS_SQL + """) WHERE rn = 1""")

define("user_chunks", ["v_disclosure_posts", "v_posts"], "SELECT * FROM " + windows_sql(_user_words(f"user_id IN {POST_USERS_SQL}"), "user_id", 50, 25))
define("ex_chunks", ["user_chunks"], extract_sql("user_chunks", "text", ["user_id", "ChunkID"]))
define("automated", ["ex_chunks"], """
SELECT UserID, Trait, DisclosureType, MatchedPhrase, Normalized, ChunkID FROM (
  SELECT 'user_' || user_id AS UserID, Trait, DisclosureType, MatchedPhrase, Normalized, ChunkID,
         row_number() OVER (PARTITION BY user_id, Trait ORDER BY ChunkID, pattern_ord, match_idx) AS rn
  FROM ex_chunks) WHERE rn = 1""")


@query("latest_disclosure", with_views("manual") + "SELECT * FROM manual", headline=True)
def q_latest_disclosure(spark, d):
    return manual(spark, d)


@query("first_disclosure_chunked", with_views("automated") + "SELECT * FROM automated")
def q_first_disclosure_chunked(spark, d):
    return automated(spark, d)


@query("trait_distribution", with_views("manual") +
       "SELECT Trait, Normalized, count(*) AS Count FROM manual GROUP BY Trait, Normalized")
def q_trait_distribution(spark, d):
    return X.trait_distribution(manual(spark, d))


@query("compare_distributions", with_views("manual", "automated") + """
, m AS (SELECT Trait, Normalized, count(*) AS c FROM manual GROUP BY ALL),
  a AS (SELECT Trait, Normalized, count(*) AS c FROM automated GROUP BY ALL)
SELECT upper(substr(coalesce(m.Trait, a.Trait), 1, 1)) || lower(substr(coalesce(m.Trait, a.Trait), 2)) AS trait_title,
       coalesce(m.Trait, a.Trait) AS Trait, coalesce(m.Normalized, a.Normalized) AS Normalized,
       CAST(coalesce(m.c, 0) AS BIGINT) AS manual_count, CAST(coalesce(a.c, 0) AS BIGINT) AS automated_count
FROM m FULL OUTER JOIN a ON m.Trait = a.Trait AND m.Normalized = a.Normalized""")
def q_compare_distributions(spark, d):
    from postlens.operators.prep import compare_distributions
    return compare_distributions(X.trait_distribution(manual(spark, d)), X.trait_distribution(automated(spark, d)))


@query("trait_evaluation", with_views("manual", "automated") + f"""
, g AS (SELECT 'user_' || user_id AS UserID, t.Trait FROM (SELECT DISTINCT user_id FROM {POST_USERS_SQL}),
        (SELECT unnest(['age', 'gender', 'education']) AS Trait) t),
  j AS (SELECT g.UserID, g.Trait, m.DisclosureType AS g_type, m.Normalized AS g_val,
               a.DisclosureType AS p_type, a.Normalized AS p_val, ty.type
        FROM g LEFT JOIN manual m ON m.UserID = g.UserID AND m.Trait = g.Trait
               LEFT JOIN automated a ON a.UserID = g.UserID AND a.Trait = g.Trait,
             (SELECT unnest(['explicit', 'implicit', 'overall']) AS type) ty),
  f AS (SELECT Trait, type,
               g_val IS NOT NULL AND (type = 'overall' OR g_type = type) AS hg,
               p_val IS NOT NULL AND (type = 'overall' OR p_type = type) AS hp, g_val, p_val FROM j),
  c AS (SELECT Trait AS trait, type,
               count(*) FILTER (WHERE hg AND hp AND g_val = p_val) AS TP,
               count(*) FILTER (WHERE hp AND NOT (hg AND hp AND g_val = p_val)) AS FP,
               count(*) FILTER (WHERE hg AND NOT (hg AND hp AND g_val = p_val)) AS FN,
               count(*) FILTER (WHERE NOT hg AND NOT hp) AS TN FROM f GROUP BY ALL),
  pr AS (SELECT *, CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END AS Precision,
                   CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END AS Recall FROM c)
SELECT trait, type, TP, FP, FN, TN, round(Precision, 6) AS Precision, round(Recall, 6) AS Recall,
       round(CASE WHEN Precision + Recall > 0 THEN 2 * Precision * Recall / (Precision + Recall) ELSE 0.0 END, 6) AS F1
FROM pr""")
def q_trait_evaluation(spark, d):
    users = post_users(spark, d).select(F.concat(F.lit("user_"), F.col("user_id")).alias("UserID"))
    ev = X.trait_evaluation(manual(spark, d), automated(spark, d), users)
    return ev.select("trait", "type", "TP", "FP", "FN", "TN", *[F.round(c, 6).alias(c) for c in ("Precision", "Recall", "F1")])

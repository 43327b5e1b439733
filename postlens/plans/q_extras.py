"""Catalog: measures claimed by the published README only."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.stop_words import STOP_WORDS as STOP
from postlens.operators import lexical as L
from postlens.plans import views as V
from postlens.plans.oracle_views import WORDS_RE2, sql_list, with_views
from postlens.plans.registry import query, r6

TOKENS_SQL = ("list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\W+'), lambda t: length(t) > 0)")
define_tokens = f"(SELECT TID, {TOKENS_SQL} AS toks FROM v_doc_posts)"


@query("tokens_no_stopwords", with_views("v_doc_posts") + f"""
SELECT TID, CAST(len(toks) AS INTEGER) AS all_tokens, CAST(len(list_filter(toks, lambda t: NOT list_contains({sql_list(STOP)}, t))) AS INTEGER) AS kept
FROM {define_tokens}""")
def q_tokens_no_stopwords(spark, d):
    t = L.tokens_no_stopwords(V.v_doc_posts(spark, d))
    return t.select("TID", F.size("all_tokens").alias("all_tokens"), F.size("tokens").alias("kept"))


@query("tf_idf", with_views("v_doc_posts") + f"""
, k AS (SELECT TID, unnest(list_filter(toks, lambda t: NOT list_contains({sql_list(STOP)}, t))) AS term FROM {define_tokens}),
  tf AS (SELECT TID, term, count(*) AS tf FROM k GROUP BY ALL),
  dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  n AS (SELECT count(*) AS n FROM v_doc_posts)
SELECT TID, term, tf, df, round(tf * ln((n.n + 1) / (df + 1)), 6) AS tf_idf FROM tf JOIN dfq USING (term), n""")
def q_tf_idf(spark, d):
    t = L.tokens_no_stopwords(V.v_doc_posts(spark, d))
    r = L.tf_idf(t, "TID")
    return r.select("TID", "term", "tf", "df", r6("tf_idf").alias("tf_idf"))


@query("lexical_diversity", with_views("v_doc_posts") + f"""
SELECT TID, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) END, 6) AS lexical_diversity
FROM (SELECT TID, regexp_extract_all(text, '{WORDS_RE2}') AS w FROM v_doc_posts)""")
def q_lexical_diversity(spark, d):
    return L.lexical_diversity(V.v_doc_posts(spark, d)).select("TID", r6("lexical_diversity").alias("lexical_diversity"))

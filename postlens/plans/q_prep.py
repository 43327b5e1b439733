"""Catalog: corpus preparation (P, J, A, U, L families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.operators import prep, sampling
from postlens.plans import views as V
from postlens.plans.oracle_views import with_views, wc_sql
from postlens.plans.registry import query, r6
from postlens.operators.ordered import md5_rank_key_sql

SEED = 42


def matched(spark, d):
    return prep.match_posts(V.v_posts(spark, d), V.v_meta(spark, d))


MATCHED_SQL = """
    matched AS (
      SELECT p.user_id, p.post_id, p.TID, p.created_utc AS created_utc_x, p.type, p.text, p.language,
             p.conv_id, p.turn, m.created_utc AS created_utc_y, m.word_count
      FROM v_posts p JOIN v_meta m ON p.user_id = m.user_id AND p.post_id = m.post_id)"""


def _with_matched(*extra):
    return with_views("v_posts", "v_meta", *extra).rstrip() + "," + MATCHED_SQL + "\n"


@query("match_posts", _with_matched() + "SELECT * FROM matched")
def q_match_posts(spark, d):
    return matched(spark, d)


@query("filter_word_range", _with_matched() +
       "SELECT user_id, post_id, word_count FROM matched WHERE word_count BETWEEN 30 AND 200")
def q_filter_word_range(spark, d):
    return prep.filter_word_range(matched(spark, d), 30, 200).select("user_id", "post_id", "word_count")


def valid_posts(spark, d):
    return prep.users_with_post_count(prep.filter_word_range(matched(spark, d), 30, 200), 0, 200)


VALID_SQL = """,
    wr AS (SELECT * FROM matched WHERE word_count BETWEEN 30 AND 200),
    valid AS (SELECT * FROM wr WHERE user_id IN
              (SELECT user_id FROM wr GROUP BY user_id HAVING count(*) BETWEEN 0 AND 200))
"""


@query("filter_user_post_range", _with_matched().rstrip() + VALID_SQL +
       "SELECT user_id, post_id, word_count FROM valid")
def q_filter_user_post_range(spark, d):
    return valid_posts(spark, d).select("user_id", "post_id", "word_count")


def user_word_stats(spark, d):
    s = prep.user_word_stats(valid_posts(spark, d))
    return s.select("user_id", "posts", "words", r6("avg_words").alias("avg_words"))


USER_STATS_SQL = _with_matched().rstrip() + VALID_SQL + """
SELECT user_id, count(*) AS posts, CAST(sum(word_count) AS BIGINT) AS words,
       round(sum(word_count) / count(*), 6) AS avg_words
FROM valid GROUP BY user_id"""


@query("user_word_stats", USER_STATS_SQL, headline=True)
def q_user_word_stats(spark, d):
    return user_word_stats(spark, d)


@query("hist2d_users", _with_matched().rstrip() + VALID_SQL + """,
    st AS (SELECT user_id, count(*) AS posts, sum(word_count) / count(*) AS avg_words FROM valid GROUP BY user_id),
    b AS (SELECT CAST(least(floor(posts / 5.0), 39) AS BIGINT) AS xb, CAST(least(floor(avg_words / 5.0), 39) AS BIGINT) AS yb
          FROM st WHERE posts BETWEEN 0 AND 200 AND avg_words BETWEEN 0 AND 200),
    c AS (SELECT xb, yb, count(*) AS n FROM b GROUP BY xb, yb),
    g AS (SELECT x.r AS xb, y.r AS yb FROM range(40) x(r), range(40) y(r))
SELECT g.xb * 5 AS x_lo, g.yb * 5 AS y_lo, CAST(coalesce(c.n, 0) AS BIGINT) AS users
FROM g LEFT JOIN c ON c.xb = g.xb AND c.yb = g.yb""")
def q_hist2d(spark, d):
    s = prep.user_word_stats(valid_posts(spark, d))
    return prep.hist2d(s, "posts", "avg_words", 5, 200)


@query("word_count", with_views("v_posts") + f"SELECT TID, {wc_sql('text')} AS word_count FROM v_posts")
def q_word_count(spark, d):
    return prep.with_word_count(V.v_posts(spark, d)).select("TID", "word_count")


@query("filter_posts_only", with_views("v_posts") + "SELECT TID, user_id, post_id FROM v_posts WHERE type = 'post'")
def q_filter_posts_only(spark, d):
    return prep.filter_posts_only(V.v_posts(spark, d)).select("TID", "user_id", "post_id")


def system_users(spark, d):
    """Id list: users (conversations) that contain a system turn."""
    return V.v_posts(spark, d).join(
        V.table(spark, d, "conversations").where(F.col("role") == "system")
        .select(F.col("conv_id").cast("string").alias("user_id")).distinct(), "user_id", "left_semi"
    ).select("user_id").distinct()


SYS_SQL = "(SELECT DISTINCT CAST(conv_id AS VARCHAR) AS user_id FROM conversations WHERE role = 'system')"


@query("semi_join_users", with_views("v_posts") + f"SELECT TID, user_id FROM v_posts WHERE user_id IN {SYS_SQL}")
def q_semi_join_users(spark, d):
    return prep.semi_join(V.v_posts(spark, d), system_users(spark, d), "user_id").select("TID", "user_id")


@query("anti_join_users", with_views("v_posts") +
       f"SELECT TID, user_id FROM v_posts p WHERE NOT EXISTS (SELECT 1 FROM {SYS_SQL} s WHERE s.user_id = p.user_id)")
def q_anti_join_users(spark, d):
    return prep.anti_join(V.v_posts(spark, d), system_users(spark, d), "user_id").select("TID", "user_id")


@query("filter_by_ids", with_views("v_posts", "v_meta") + """
SELECT p.TID, p.user_id, p.post_id FROM v_posts p
WHERE p.TID IN (SELECT user_id || '_' || post_id FROM v_meta WHERE word_count >= 100)""")
def q_filter_by_ids(spark, d):
    ids = V.v_meta(spark, d).where(F.col("word_count") >= 100).select(
        F.concat_ws("_", "user_id", "post_id").alias("TID"))
    return prep.semi_join(V.v_posts(spark, d), ids, "TID").select("TID", "user_id", "post_id")


def list_a(spark, d):
    return system_users(spark, d)


def list_b(spark, d):
    """Second id list: users with a metadata row of at least 150 words."""
    return V.v_meta(spark, d).where(F.col("word_count") >= 150).select("user_id").distinct()


LIST_B_SQL = "(SELECT DISTINCT user_id FROM v_meta WHERE word_count >= 150)"


@query("union_ids", with_views("v_meta") + f"SELECT user_id FROM {SYS_SQL} UNION SELECT user_id FROM {LIST_B_SQL}")
def q_union_ids(spark, d):
    return prep.union_ids(list_a(spark, d), list_b(spark, d))


@query("holdout_pool", with_views("v_posts", "v_meta") + f"""
SELECT DISTINCT user_id FROM v_posts WHERE user_id NOT IN (SELECT user_id FROM {SYS_SQL} UNION SELECT user_id FROM {LIST_B_SQL})""")
def q_holdout_pool(spark, d):
    users = V.v_posts(spark, d).select("user_id").distinct()
    return prep.anti_join(users, prep.union_ids(list_a(spark, d), list_b(spark, d)), "user_id")


@query("distinct_users", with_views("v_posts") +
       "SELECT type, count(*) AS rows, count(DISTINCT user_id) AS users FROM v_posts GROUP BY type")
def q_distinct_users(spark, d):
    return prep.distinct_users(V.v_posts(spark, d), group_col="type")


def gender_csv(spark, d):
    return prep.normalize_columns(V.v_gender_csv(spark, d))


@query("normalize_columns", with_views("v_gender_csv") + """
SELECT "Row ID" AS row_id, " Name" AS name, " Gender Identity " AS gender_identity, "Market  Segment" AS market_segment
FROM v_gender_csv""")
def q_normalize_columns(spark, d):
    return gender_csv(spark, d)


@query("filter_gender", with_views("v_gender_csv") + """
SELECT "Row ID" AS row_id, " Gender Identity " AS gender_identity FROM v_gender_csv
WHERE lower(trim(" Gender Identity ")) = 'male'""")
def q_filter_gender(spark, d):
    return prep.filter_value(gender_csv(spark, d), "gender_identity", "male").select("row_id", "gender_identity")


@query("first_n_matching", with_views("v_gender_csv") + """
SELECT "Row ID" AS row_id, " Gender Identity " AS gender_identity,
       (SELECT count(*) FROM v_gender_csv WHERE lower(trim(" Gender Identity ")) = 'male') >= 200 AS enough
FROM v_gender_csv WHERE lower(trim(" Gender Identity ")) = 'male'
ORDER BY "Row ID" LIMIT 200""")
def q_first_n_matching(spark, d):
    return sampling.first_n_matching(gender_csv(spark, d), F.lower(F.trim("gender_identity")) == "male",
                                     n=200, order=["row_id"], strict=False).select("row_id", "gender_identity", "enough")


@query("gate_report", with_views("v_gender_csv") + """
, m AS (SELECT * FROM v_gender_csv WHERE lower(trim(" Gender Identity ")) = 'male')
SELECT 'column:gender_identity' AS gate, CAST(1 AS BIGINT) AS observed, CAST(1 AS BIGINT) AS required, true AS passed
UNION ALL SELECT 'min_rows', count(*), CAST(2700 AS BIGINT), count(*) >= 2700 FROM m
UNION ALL SELECT 'min_users', count(DISTINCT "Row ID"), CAST(100 AS BIGINT), count(DISTINCT "Row ID") >= 100 FROM m
UNION ALL SELECT 'no_nulls:gender_identity', count(*) FILTER (WHERE " Gender Identity " IS NULL), CAST(0 AS BIGINT),
          count(*) FILTER (WHERE " Gender Identity " IS NULL) = 0 FROM m
""")
def q_gate_report(spark, d):
    m = prep.filter_value(gender_csv(spark, d), "gender_identity", "male")
    return prep.gate_report(m, required_cols=["gender_identity"], min_rows=2700, min_users=100,
                            user_col="row_id", not_null=["gender_identity"])


@query("resolve_persona_column", with_views("v_personas") +
       "SELECT persona_id, persona_text FROM v_personas")
def q_resolve_persona_column(spark, d):
    df = V.v_personas(spark, d).withColumnRenamed("persona_text", "Persona")
    return prep.resolve_column(df, ["model_response", "persona", "original_text"], "persona_text").select(
        "persona_id", "persona_text")


@query("resolve_persona_exact", with_views("v_personas") + "SELECT persona_id, persona_text FROM v_personas")
def q_resolve_persona_exact(spark, d):
    """The case-sensitive form: ``Persona`` is not ``persona``, so the original text is taken."""
    df = V.v_personas(spark, d).withColumnRenamed("persona_text", "original_text").withColumn("Persona", F.lit("another case"))
    return prep.resolve_column(df, ["model_response", "persona", "original_text"], "persona_text", case_insensitive=False).select(
        "persona_id", "persona_text")


@query("resolve_text", with_views("v_posts") + """
SELECT TID, 'text' AS found, text FROM v_posts
UNION ALL SELECT TID, 'comment_text', text || '!' FROM v_posts
UNION ALL SELECT TID, 'none', 'Comment ' || CAST(row_number() OVER (ORDER BY conv_id, turn) - 1 AS VARCHAR) FROM v_posts""")
def q_resolve_text(spark, d):
    """A text column of either name, and rows without one."""
    posts = V.v_posts(spark, d)
    other = posts.withColumn("comment_text", F.concat("text", F.lit("!"))).drop("text")
    out = [prep.resolve_text(df, ["conv_id", "turn"]).select("TID", F.lit(found).alias("found"), "text")
           for found, df in (("text", posts.withColumn("comment_text", F.lit("not this"))), ("comment_text", other), ("none", posts.drop("text")))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("drop_nulls", with_views("v_personas") + "SELECT persona_id FROM v_personas WHERE persona_text IS NOT NULL")
def q_drop_nulls(spark, d):
    return prep.drop_nulls(V.v_personas(spark, d), ["persona_text"]).select("persona_id")


def generated_csv(spark, d):
    return V.v_generated(spark, d).withColumnRenamed("text", "Generated Text")


@query("clean_generated", with_views("v_generated") + """
SELECT prompt_id, attempt FROM v_generated
WHERE NOT coalesce(contains(text, '[No valid comment generated]') OR starts_with(text, 'Here') OR starts_with(text, 'AI'), false)""")
def q_clean_generated(spark, d):
    return prep.clean_generated(generated_csv(spark, d)).select("prompt_id", "attempt")


@query("clean_generated_counts", with_views("v_generated") + """
SELECT count(*) AS rows,
       count(*) FILTER (WHERE contains(text, '[No valid comment generated]') OR starts_with(text, 'Here') OR starts_with(text, 'AI')) AS removed,
       count(*) FILTER (WHERE NOT (contains(text, '[No valid comment generated]') OR starts_with(text, 'Here') OR starts_with(text, 'AI'))) AS kept
FROM v_generated""")
def q_clean_generated_counts(spark, d):
    return prep.clean_generated_counts(generated_csv(spark, d))


@query("convert_format", with_views("v_generated") + """
SELECT CAST(rn AS VARCHAR) || '_1' AS TID, rn AS user_id, CAST(1 AS BIGINT) AS post_id, 'bipolar' AS label,
       coalesce(text, 'nan') AS text, 'en' AS language
FROM (SELECT *, row_number() OVER (ORDER BY prompt_id, attempt) AS rn FROM v_generated
      WHERE NOT coalesce(contains(text, '[No valid comment generated]') OR starts_with(text, 'Here') OR starts_with(text, 'AI'), false))""")
def q_convert_format(spark, d):
    cleaned = prep.clean_generated(generated_csv(spark, d)).withColumnRenamed("Generated Text", "generated_text")
    return prep.to_post_schema(cleaned, order=["prompt_id", "attempt"])


@query("scan_first_n", with_views("v_posts") + "SELECT TID, user_id FROM v_posts ORDER BY conv_id, turn LIMIT 454")
def q_scan_first_n(spark, d):
    return sampling.first_rows(V.v_posts(spark, d), 454, ["conv_id", "turn"]).select("TID", "user_id")


@query("first_n_users", with_views("v_doc_posts") + """
SELECT TID, user_id FROM v_doc_posts WHERE user_id IN
  (SELECT user_id FROM v_doc_posts GROUP BY user_id ORDER BY min(doc_id) LIMIT 5)""")
def q_first_n_users(spark, d):
    return sampling.first_n_users(V.v_doc_posts(spark, d), 5, ["doc_id"]).select("TID", "user_id")


@query("sample_user_posts", with_views("v_posts") + f"""
, u AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM v_posts WHERE user_id IS NOT NULL)
        ORDER BY {md5_rank_key_sql(SEED, 'user_id')}, user_id LIMIT 15),
  r AS (SELECT p.*, row_number() OVER (PARTITION BY p.user_id ORDER BY {md5_rank_key_sql(SEED, 'p.TID')}, p.TID) AS rn
        FROM v_posts p JOIN u ON u.user_id = p.user_id)
SELECT user_id, TID, text FROM r WHERE rn = 1""")
def q_sample_user_posts(spark, d):
    return sampling.sample_user_posts(V.v_posts(spark, d), n=15, seed=SEED, key_col="TID").select(
        "user_id", "TID", "text")


@query("sample_texts", with_views("v_posts") + f"""
SELECT CAST(row_number() OVER (ORDER BY h, TID) AS BIGINT) AS example_no, text FROM
 (SELECT TID, text, {md5_rank_key_sql(SEED, 'TID')} AS h FROM v_posts WHERE text IS NOT NULL ORDER BY h, TID LIMIT 5)""")
def q_sample_texts(spark, d):
    return sampling.sample_texts(V.v_posts(spark, d), n=5, seed=SEED, key_col="TID").select("example_no", "text")


@query("number_examples", with_views("v_posts") + f"""
SELECT string_agg(CAST(example_no AS VARCHAR) || '. ' || text, chr(10) ORDER BY example_no) AS examples FROM
(SELECT row_number() OVER (ORDER BY h, TID) AS example_no, text FROM
 (SELECT TID, text, {md5_rank_key_sql(SEED, 'TID')} AS h FROM v_posts WHERE text IS NOT NULL ORDER BY h, TID LIMIT 3))""")
def q_number_examples(spark, d):
    return sampling.numbered_block(sampling.sample_texts(V.v_posts(spark, d), n=3, seed=SEED, key_col="TID"))


@query("union_groups", with_views("v_sent_auth", "v_sent_syn") + """
SELECT TID, wid, l_quantity, l_extendedprice, l_discount, l_tax, 'authentic' AS kind FROM v_sent_auth
UNION ALL SELECT TID, wid, l_quantity, NULL, NULL, NULL, 'synthetic' FROM v_sent_syn""")
def q_union_groups(spark, d):
    a = V.v_sent_auth(spark, d).select("TID", *V.SENT_FEATURES).withColumn("kind", F.lit("authentic"))
    s = V.v_sent_syn(spark, d).select("TID", "wid", "l_quantity").withColumn("kind", F.lit("synthetic"))
    return prep.union_groups(a, s)

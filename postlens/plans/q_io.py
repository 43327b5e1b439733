"""Catalog: sources and sinks (S1-S5, K1, K2) as write -> read-back -> aggregate round trips."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.text import word_count
from postlens.operators import prep
from postlens.plans import views as V
from postlens.plans.oracle_views import wc_sql, with_views
from postlens.plans.registry import query
from postlens.sources import files

POST_COLS = ["TID", "user_id", "post_id", "type", "text"]
POST_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in POST_COLS] +
                           [T.StructField("created_utc", T.LongType(), True)])
META_SCHEMA = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("post_id", T.StringType()),
                            T.StructField("created_utc", T.LongType()), T.StructField("word_count", T.LongType())])


def _posts_summary(df):
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"),
                                  F.sum(word_count("text")).cast("long").alias("words"),
                                  F.sum(F.length("text")).cast("long").alias("chars"))


POSTS_SUMMARY_SQL = with_views("v_posts") + f"""
SELECT type, count(*) AS rows, count(DISTINCT user_id) AS users, CAST(sum({wc_sql('text')}) AS BIGINT) AS words,
       CAST(sum(length(text)) AS BIGINT) AS chars FROM v_posts GROUP BY type"""


@query("scan_csv", POSTS_SUMMARY_SQL)
def q_scan_csv(spark, d):
    path = files.write_csv(V.v_posts(spark, d).select(*POST_COLS, "created_utc"), files.scratch_path(spark, "csv"))
    return _posts_summary(files.read_csv(spark, path, POST_SCHEMA, multi_line=True))


@query("sink_csv_roundtrip", with_views("v_posts") + """
SELECT count(*) AS rows, CAST(sum(created_utc) AS BIGINT) AS created_sum,
       count(*) FILTER (WHERE contains(text, chr(10)) OR contains(text, '"') OR contains(text, ',')) AS quoted_rows
FROM v_posts""")
def q_sink_csv_roundtrip(spark, d):
    path = files.write_csv(V.v_posts(spark, d).select(*POST_COLS, "created_utc"), files.scratch_path(spark, "sink"))
    back = files.read_csv(spark, path, POST_SCHEMA, multi_line=True)
    t = F.col("text")
    quoted = t.contains("\n") | t.contains('"') | t.contains(",")
    return back.agg(F.count(F.lit(1)).alias("rows"), F.sum("created_utc").cast("long").alias("created_sum"),
                    F.count_if(quoted).alias("quoted_rows"))


@query("scan_jsonl", with_views("v_meta") + """
SELECT count(*) AS rows, count(DISTINCT user_id) AS users, CAST(sum(word_count) AS BIGINT) AS words,
       CAST(sum(created_utc) AS BIGINT) AS created_sum FROM v_meta""")
def q_scan_jsonl(spark, d):
    path = files.write_jsonl(V.v_meta(spark, d), files.scratch_path(spark, "jsonl"))
    m = files.read_jsonl(spark, path, META_SCHEMA)
    return m.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("user_id").alias("users"),
                 F.sum("word_count").cast("long").alias("words"), F.sum("created_utc").cast("long").alias("created_sum"))


@query("sink_jsonl_roundtrip", POSTS_SUMMARY_SQL)
def q_sink_jsonl_roundtrip(spark, d):
    path = files.write_jsonl(V.v_posts(spark, d).select(*POST_COLS, "created_utc"), files.scratch_path(spark, "sinkj"))
    return _posts_summary(files.read_jsonl(spark, path, POST_SCHEMA))


JSONL_SCHEMA = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("text", T.StringType()),
                             T.StructField("created_utc", T.LongType())])


def bad_jsonl(spark, d) -> str:
    """Events as JSON lines (user_id, text, created_utc); times as integers, decimals and quoted by turns;
    every 17th line cut in half (malformed)."""
    ev = V.table(spark, d, "events")
    at = F.col("event_id")
    rest = lambda t: F.to_json(F.struct(F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("text"),
                                        t.alias("created_utc")))
    line = F.when(at % 3 == 0, rest(at)).when(at % 3 == 1, rest(at.cast("double"))).otherwise(rest(at.cast("string")))
    cut = F.when(F.pmod("event_id", F.lit(17)) == 0, F.substring(line, 1, (F.length(line) / 2).cast("int"))).otherwise(line)
    path = files.scratch_path(spark, "badjsonl")
    ev.select(cut.alias("value")).write.mode("overwrite").text(path)
    return path


@query("scan_jsonl_tolerant", """
SELECT CAST(user_id AS VARCHAR) AS user_id, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS created_sum,
       count(DISTINCT event_type) AS texts
FROM events WHERE event_id % 17 <> 0 GROUP BY user_id""")
def q_scan_jsonl_tolerant(spark, d):
    df = files.read_jsonl_tolerant(spark, bad_jsonl(spark, d), JSONL_SCHEMA,
                                   {"user_id": "", "text": "", "created_utc": 0})
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("created_utc").cast("long").alias("created_sum"),
                                     F.countDistinct("text").alias("texts"))


@query("scan_detect_sep", with_views("v_gender_csv") + """
SELECT " Gender Identity " AS gender_identity, count(*) AS rows FROM v_gender_csv GROUP BY 1""")
def q_scan_detect_sep(spark, d):
    path = files.write_csv(V.v_gender_csv(spark, d), files.scratch_path(spark, "semicolon"), sep=";")
    df = prep.normalize_columns(files.read_detect_sep(spark, path))
    return df.groupBy("gender_identity").agg(F.count(F.lit(1)).alias("rows"))


@query("scan_four_blanks", with_views("v_gender_csv") + """
SELECT " Gender Identity " AS gender_identity, "Row ID" % 10 AS tens, count(*) AS rows FROM v_gender_csv GROUP BY ALL""")
def q_scan_four_blanks(spark, d):
    """A file whose columns are parted by four blanks."""
    path = files.write_csv(V.v_gender_csv(spark, d), files.scratch_path(spark, "blanks"), sep="    ", quote_all=True)
    df = prep.normalize_columns(files.read_detect_sep(spark, path))
    return df.groupBy("gender_identity", (F.col("row_id").cast("long") % 10).alias("tens")).agg(F.count(F.lit(1)).alias("rows"))


@query("scan_all_string", with_views("v_posts") + """
SELECT count(*) AS rows, count(DISTINCT created_utc) AS distinct_created, max(length(CAST(created_utc AS VARCHAR))) AS max_len
FROM v_posts""")
def q_scan_all_string(spark, d):
    path = files.write_csv(V.v_posts(spark, d).select(*POST_COLS, "created_utc"), files.scratch_path(spark, "allstr"))
    df = files.read_csv(spark, path, files.all_string_schema(POST_COLS + ["created_utc"]), multi_line=True)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("created_utc").alias("distinct_created"),
                  F.max(F.length("created_utc")).cast("long").alias("max_len"))

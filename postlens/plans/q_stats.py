"""Catalog: per-user feature means and authentic-vs-synthetic distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.text import user_from_tid
from postlens.operators import prep, sampling, stats
from postlens.plans import views as V
from postlens.plans.oracle_views import define, with_views
from postlens.plans.registry import query, r6
from postlens.session import cut_lineage

FEATS = V.SENT_FEATURES
SAMPLE_SIZE = 3575


def user_means(sent):
    return prep.user_feature_means(sent.withColumn("user_id", user_from_tid("TID")), FEATS)


def auth_users(spark, d):
    return user_means(V.v_sent_auth(spark, d))


def syn_users(spark, d):
    return user_means(V.v_sent_syn(spark, d))


def longs(spark, d):
    """Long-form user means of both samples. They feed several branches (edges, bins, JS,
    Wasserstein buckets), so lineage is cut once with a reliable checkpoint."""
    a = stats.to_long(auth_users(spark, d), FEATS)
    b = stats.to_long(syn_users(spark, d), FEATS)
    return cut_lineage(a), cut_lineage(b)


_avg = ", ".join(f"avg({f}) AS {f}" for f in FEATS)
define("auth_means", ["v_sent_auth"], f"SELECT split_part(TID, '_', 1) AS user_id, {_avg} FROM v_sent_auth GROUP BY 1")
define("syn_means", ["v_sent_syn"], f"SELECT split_part(TID, '_', 1) AS user_id, {_avg} FROM v_sent_syn GROUP BY 1")
define("auth_s", ["auth_means"], "SELECT * FROM auth_means")
define("syn_s", ["syn_means"], "SELECT * FROM syn_means")
_feat_list = ", ".join(FEATS)
define("a_long", ["auth_s"], f"SELECT feature, CAST(value AS DOUBLE) AS value FROM (UNPIVOT auth_s ON {_feat_list} "
                             "INTO NAME feature VALUE value) WHERE value IS NOT NULL AND NOT isnan(value)")
define("b_long", ["syn_s"], f"SELECT feature, CAST(value AS DOUBLE) AS value FROM (UNPIVOT syn_s ON {_feat_list} "
                            "INTO NAME feature VALUE value) WHERE value IS NOT NULL AND NOT isnan(value)")
define("edges", ["a_long"], """
SELECT feature, mn, mx, 50.0 / (mx - mn) AS norm, (mx - mn) / 50.0 AS step FROM (
  SELECT feature, CASE WHEN mn0 = mx0 THEN mn0 - 0.5 ELSE mn0 END AS mn, CASE WHEN mn0 = mx0 THEN mx0 + 0.5 ELSE mx0 END AS mx
  FROM (SELECT feature, min(value) AS mn0, max(value) AS mx0 FROM a_long GROUP BY feature))""")


def _e(i: str) -> str:
    return f"(CASE WHEN ({i}) >= 50 THEN mx ELSE ({i}) * step + mn END)"


define("hist", ["a_long", "b_long", "edges"], f"""
SELECT g.feature, g.kind, g.bin, CAST(coalesce(c.n, 0) AS BIGINT) AS count, g.width,
       CAST(coalesce(t.n_in, 0) AS BIGINT) AS n_in FROM
  (SELECT feature, kind, bin, {_e('bin + 1')} - {_e('bin')} AS width
   FROM edges, (SELECT unnest(['a', 'b']) AS kind), (SELECT CAST(unnest(range(50)) AS BIGINT) AS bin)) g
  LEFT JOIN (
    SELECT feature, kind, i3 AS bin, count(*) AS n FROM (
      SELECT *, CASE WHEN value >= {_e('i2 + 1')} AND i2 <> 49 THEN i2 + 1 ELSE i2 END AS i3 FROM (
        SELECT *, CASE WHEN value < {_e('i1')} THEN i1 - 1 ELSE i1 END AS i2 FROM (
          SELECT *, CASE WHEN i0 = 50 THEN 49 ELSE i0 END AS i1 FROM (
            SELECT v.feature, v.kind, v.value, e.mn, e.mx, e.step, CAST(floor((v.value - e.mn) * e.norm) AS BIGINT) AS i0
            FROM (SELECT feature, value, 'a' AS kind FROM a_long UNION ALL SELECT feature, value, 'b' FROM b_long) v
            JOIN edges e ON e.feature = v.feature WHERE v.value >= e.mn AND v.value <= e.mx)))) GROUP BY ALL) c
    ON c.feature = g.feature AND c.kind = g.kind AND c.bin = g.bin
  LEFT JOIN (SELECT feature, kind, sum(n) AS n_in FROM (
      SELECT feature, kind, count(*) AS n FROM (SELECT feature, value, 'a' AS kind FROM a_long UNION ALL
                                                SELECT feature, value, 'b' FROM b_long) v
      JOIN edges e USING (feature) WHERE v.value >= e.mn AND v.value <= e.mx GROUP BY ALL) GROUP BY ALL) t
    ON t.feature = g.feature AND t.kind = g.kind""")
define("js", ["hist"], """
SELECT feature, CASE WHEN nq = 0 THEN sqrt(greatest(s / 2 / ln(2), 0.0)) END AS JS_divergence FROM (
  SELECT feature, sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) AS s, count(*) FILTER (WHERE q IS NULL) AS nq
  FROM (SELECT feature, bin, max(CASE WHEN kind = 'a' THEN pp END) AS p, max(CASE WHEN kind = 'b' THEN pp END) AS q FROM (
          SELECT feature, kind, bin, d / sum(d) OVER (PARTITION BY feature, kind) AS pp FROM (
            SELECT *, CASE WHEN n_in > 0 THEN count / (n_in * width) + 1e-12 END AS d FROM hist))
        GROUP BY ALL) GROUP BY ALL)""")
define("wd", ["a_long", "b_long"], """
SELECT feature, CASE WHEN max(na) > 0 AND max(nb) > 0 THEN sum(abs(fa - fb) * coalesce(dx, 0)) END AS Wasserstein FROM (
  SELECT feature, value, sum(ca) OVER w / sum(ca) OVER p AS fa, sum(cb) OVER w / sum(cb) OVER p AS fb,
         lead(value) OVER (PARTITION BY feature ORDER BY value) - value AS dx,
         sum(ca) OVER p AS na, sum(cb) OVER p AS nb
  FROM (SELECT feature, value, count(*) FILTER (WHERE k = 'a') AS ca, count(*) FILTER (WHERE k = 'b') AS cb
        FROM (SELECT feature, value, 'a' AS k FROM a_long UNION ALL SELECT feature, value, 'b' FROM b_long) GROUP BY ALL)
  WINDOW w AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY feature))
GROUP BY feature""")
define("summary", ["js", "wd"], "SELECT feature, JS_divergence, Wasserstein FROM js FULL OUTER JOIN wd USING (feature)")


define("all_means", ["v_sent"], f"SELECT split_part(TID, '_', 1) AS user_id, {_avg} FROM v_sent GROUP BY 1")


@query("user_feature_means", with_views("all_means") + "SELECT user_id, " + ", ".join(
    f"round({f}, 6) AS {f}" for f in FEATS) + " FROM all_means")
def q_user_feature_means(spark, d):
    return user_means(V.v_sent(spark, d)).select("user_id", *[r6(f).alias(f) for f in FEATS])


@query("first_n_users_lexical", with_views("auth_means") +
       f"SELECT user_id FROM auth_means ORDER BY user_id LIMIT {SAMPLE_SIZE}")
def q_first_n_users_lexical(spark, d):
    return sampling.first_n_users_lexical(auth_users(spark, d), SAMPLE_SIZE).select("user_id")


@query("feature_histogram", with_views("hist") + "SELECT feature, kind, bin, count, n_in FROM hist")
def q_feature_histogram(spark, d):
    a, b = longs(spark, d)
    return stats.feature_histogram(a, b).select("feature", "kind", "bin", "count", "n_in")


@query("js_distance", with_views("js") + "SELECT feature, round(JS_divergence, 6) AS JS_divergence FROM js")
def q_js_distance(spark, d):
    a, b = longs(spark, d)
    return stats.js_distance(a, b).select("feature", r6("JS_divergence").alias("JS_divergence"))


@query("wasserstein", with_views("wd") + "SELECT feature, round(Wasserstein, 6) AS Wasserstein FROM wd")
def q_wasserstein(spark, d):
    a, b = longs(spark, d)
    return stats.wasserstein(a, b).select("feature", r6("Wasserstein").alias("Wasserstein"))


@query("feature_distance_summary", with_views("summary") +
       "SELECT feature, round(JS_divergence, 6) AS JS_divergence, round(Wasserstein, 6) AS Wasserstein FROM summary",
       headline=True)
def q_feature_distance_summary(spark, d):
    a, b = longs(spark, d)
    s = stats.feature_distance_summary(a, b)
    return s.select("feature", r6("JS_divergence").alias("JS_divergence"), r6("Wasserstein").alias("Wasserstein"))


@query("top10_features", with_views("summary") + """
SELECT * FROM (SELECT 'JS_divergence' AS metric, feature, round(JS_divergence, 6) AS value FROM summary
               WHERE JS_divergence IS NOT NULL ORDER BY JS_divergence DESC, feature LIMIT 10)
UNION ALL
SELECT * FROM (SELECT 'Wasserstein', feature, round(Wasserstein, 6) FROM summary
               WHERE Wasserstein IS NOT NULL ORDER BY Wasserstein DESC, feature LIMIT 10)""")
def q_top10_features(spark, d):
    a, b = longs(spark, d)
    t = stats.top_features(stats.feature_distance_summary(a, b), 10)
    return t.select("metric", "feature", r6("value").alias("value"))


@query("feature_columns", with_views("v_sent") + "SELECT feature, CAST(count(value) AS BIGINT) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM v_sent" for f in FEATS) + ") GROUP BY feature")
def q_feature_columns(spark, d):
    """The columns that count as features, found by exclusion, and how many values each has."""
    df = V.v_sent(spark, d)
    n = df.agg(*[F.count(c).alias(c) for c in prep.feature_columns(df)])
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("n")) for c in n.columns])).alias("s")).select("s.*")


SUBSET = FEATS[:2]
DENSITY_SQL = """
, l AS (SELECT feature, value, 'authentic' AS kind FROM a_long UNION ALL SELECT feature, value, 'synthetic' FROM b_long),
  st AS (SELECT feature, kind, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi
         FROM l WHERE KEPT GROUP BY ALL),
  g AS (SELECT *, lo - 3 * h AS g0, ((hi + 3 * h) - (lo - 3 * h)) / 199 AS dg FROM st WHERE h IS NOT NULL AND h > 0),
  pts AS (SELECT feature, kind, n, h, g0, dg, CAST(unnest(range(200)) AS BIGINT) AS point FROM g),
  v AS (SELECT feature, kind, value, count(*) AS c FROM l GROUP BY ALL)
SELECT p.feature, p.kind, p.point, round(p.g0 + p.point * p.dg, 6) AS x,
       round(sum(v.c * exp(-0.5 * pow((p.g0 + p.point * p.dg - v.value) / p.h, 2))) / (p.n * p.h * sqrt(2 * pi())), 6) AS density
FROM pts p JOIN v ON v.feature = p.feature AND v.kind = p.kind
GROUP BY p.feature, p.kind, p.point, p.g0, p.dg, p.n, p.h"""


@query("density_subset", with_views("a_long", "b_long") + DENSITY_SQL.replace(
    "KEPT", "feature IN (" + ", ".join(f"'{f}'" for f in SUBSET) + ")"))
def q_density_subset(spark, d):
    a, b = longs(spark, d)
    long = a.withColumn("kind", F.lit("authentic")).unionByName(b.withColumn("kind", F.lit("synthetic")))
    dc = stats.density_curve(long, 200, features=SUBSET)
    return dc.select("feature", "kind", "point", r6("x").alias("x"), r6("density").alias("density"))


@query("density_curve", with_views("a_long", "b_long") + DENSITY_SQL.replace("KEPT", "true"))
def q_density_curve(spark, d):
    a, b = longs(spark, d)
    long = a.withColumn("kind", F.lit("authentic")).unionByName(b.withColumn("kind", F.lit("synthetic")))
    dc = stats.density_curve(long, 200)
    return dc.select("feature", "kind", "point", r6("x").alias("x"), r6("density").alias("density"))

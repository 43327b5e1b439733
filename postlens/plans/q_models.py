"""Catalog: vectors and retrieval (M1-M4, J5, W7, W8, K3) and classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from postlens.functions.text import user_from_tid
from postlens.operators import model as M
from postlens.operators import prep
from postlens.operators import vectors as VEC
from postlens.operators.clustering import mini_batch_kmeans
from postlens.operators.encoder import train_encoder
from postlens.operators.layout import landmark_layout
from postlens.operators.ordered import md5_rank_key_sql
from postlens.plans import views as V
from postlens.plans.oracle_views import define, with_views
from postlens.plans.registry import query, r6
from postlens.session import stored

SEED = 42
FEATS = V.SENT_FEATURES

# ------------------------------------------------------------------ vectors ---

define("el", [], """SELECT vec_id, CAST(label AS BIGINT) AS cluster, CAST(unnest(embedding) AS DOUBLE) AS v,
                           unnest(range(len(embedding))) AS dim FROM embeddings""")
define("cent", ["el"], "SELECT cluster, dim, avg(v) AS c FROM el GROUP BY ALL")
define("cn", ["cent"], "SELECT cluster, sqrt(sum(c * c)) AS n FROM cent GROUP BY ALL")
define("en", ["el"], "SELECT vec_id, sqrt(sum(v * v)) AS n FROM el GROUP BY ALL")
define("ps", ["el", "cent", "cn", "en"], """
SELECT e.vec_id AS persona_id, c.cluster, sum(e.v * c.c) / (max(en.n) * max(cn.n)) AS sim
FROM el e JOIN cent c ON c.dim = e.dim JOIN en ON en.vec_id = e.vec_id JOIN cn ON cn.cluster = c.cluster
GROUP BY e.vec_id, c.cluster""")
define("dv", ["ps"], """
SELECT persona_id,
       max(CASE WHEN rd = 1 THEN cluster END) AS top_cluster,
       max(CASE WHEN ra = k // 2 + 1 THEN cluster END) AS mid_cluster,
       max(CASE WHEN ra = 1 THEN cluster END) AS bottom_cluster
FROM (SELECT *, row_number() OVER (PARTITION BY persona_id ORDER BY sim DESC, cluster) AS rd,
                row_number() OVER (PARTITION BY persona_id ORDER BY sim, cluster) AS ra,
                count(*) OVER (PARTITION BY persona_id) AS k FROM ps) GROUP BY persona_id""")
define("req", ["dv"], """
SELECT DISTINCT persona_id, cluster FROM (
  SELECT persona_id, unnest([top_cluster, mid_cluster, bottom_cluster]) AS cluster FROM dv)""")
define("pm", ["req", "el", "en"], """
SELECT r.persona_id, r.cluster, m.vec_id AS member_id, sum(p.v * m.v) / (max(pn.n) * max(mn.n)) AS sim
FROM req r JOIN el p ON p.vec_id = r.persona_id JOIN el m ON m.cluster = r.cluster AND m.dim = p.dim
     JOIN en pn ON pn.vec_id = r.persona_id JOIN en mn ON mn.vec_id = m.vec_id
GROUP BY r.persona_id, r.cluster, m.vec_id""")
define("ext", ["pm"], """
SELECT persona_id, cluster,
       max(CASE WHEN rd = 1 THEN member_id END) AS most_id, max(CASE WHEN rd = 1 THEN sim END) AS most_sim,
       max(CASE WHEN ra = 1 THEN member_id END) AS least_id, max(CASE WHEN ra = 1 THEN sim END) AS least_sim
FROM (SELECT *, row_number() OVER (PARTITION BY persona_id, cluster ORDER BY sim DESC, member_id) AS rd,
                row_number() OVER (PARTITION BY persona_id, cluster ORDER BY sim, member_id) AS ra FROM pm)
GROUP BY persona_id, cluster""")


def emb(spark, d):
    return V.v_emb(spark, d)


def centroids(spark, d):
    return VEC.centroids_by_label(emb(spark, d))


def personas(spark, d):
    return V.v_personas(spark, d)


@query("cosine_similarity", with_views("el", "cent", "cn", "en") + """
SELECT e.vec_id, e.cluster, round(sum(e.v * c.c) / (max(en.n) * max(cn.n)), 6) AS sim
FROM el e JOIN cent c ON c.cluster = e.cluster AND c.dim = e.dim JOIN en ON en.vec_id = e.vec_id
     JOIN cn ON cn.cluster = e.cluster GROUP BY e.vec_id, e.cluster""")
def q_cosine_similarity(spark, d):
    e = emb(spark, d)
    c = centroids(spark, d)
    # one centroid per label: k rows, bounded by the label count; AQE broadcasts it
    j = e.join(c, "cluster")
    return j.select("vec_id", "cluster", r6(VEC.cosine(VEC.as_double_array("embedding"), "centroid")).alias("sim"))


@query("persona_cluster_sim", with_views("ps") + "SELECT persona_id, cluster, round(sim, 6) AS sim FROM ps")
def q_persona_cluster_sim(spark, d):
    s = VEC.persona_cluster_sim(personas(spark, d), centroids(spark, d))
    return s.select("persona_id", F.explode("sims").alias("s")).select(
        "persona_id", F.col("s.cluster").alias("cluster"), r6("s.sim").alias("sim"))


@query("diverse_clusters", with_views("dv") + "SELECT * FROM dv")
def q_diverse_clusters(spark, d):
    s = VEC.persona_cluster_sim(personas(spark, d), centroids(spark, d))
    return VEC.diverse_clusters(s).drop("_p")


def _diverse(spark, d):
    return stored(VEC.diverse_clusters(VEC.persona_cluster_sim(personas(spark, d), centroids(spark, d))), "diverse")


def _extremes(spark, d):
    div = _diverse(spark, d)
    req = div.select("persona_id", "_p", F.explode(F.array_distinct(F.array("top_cluster", "mid_cluster", "bottom_cluster"))).alias("cluster"))
    return VEC.cluster_extremes(req, emb(spark, d))


@query("cluster_extremes", with_views("ext") +
       "SELECT persona_id, cluster, most_id, round(most_sim, 6) AS most_sim, least_id, round(least_sim, 6) AS least_sim FROM ext")
def q_cluster_extremes(spark, d):
    e = _extremes(spark, d)
    return e.select("persona_id", "cluster", "most_id", r6("most_sim").alias("most_sim"), "least_id",
                    r6("least_sim").alias("least_sim"))


@query("cluster_top_n", with_views("dv", "pm") + """
SELECT persona_id, cluster, rank, member_id, round(sim, 6) AS sim FROM (
  SELECT pm.*, row_number() OVER (PARTITION BY pm.persona_id ORDER BY pm.sim DESC, pm.member_id) AS rank
  FROM pm JOIN dv ON dv.persona_id = pm.persona_id AND dv.top_cluster = pm.cluster) WHERE rank <= 3""")
def q_cluster_top_n(spark, d):
    div = _diverse(spark, d)
    req = div.select("persona_id", "_p", F.col("top_cluster").alias("cluster"))
    t = VEC.cluster_top_n(req, emb(spark, d), 3)
    return t.select("persona_id", "cluster", "rank", "member_id", r6("sim").alias("sim"))


define("fse", ["dv", "ext"], """
SELECT s.persona_id, CAST(s.slot * 2 + k.k + 1 AS BIGINT) AS example_no, s.cluster,
       CASE WHEN k.k = 0 THEN x.most_id ELSE x.least_id END AS member_id,
       round(CASE WHEN k.k = 0 THEN x.most_sim ELSE x.least_sim END, 6) AS sim
FROM (SELECT persona_id, unnest([top_cluster, mid_cluster, bottom_cluster]) AS cluster, unnest([0, 1, 2]) AS slot FROM dv) s
JOIN ext x ON x.persona_id = s.persona_id AND x.cluster = s.cluster, (SELECT unnest([0, 1]) AS k) k""")


def few_shot(spark, d):
    return VEC.few_shot_examples(personas(spark, d), emb(spark, d), centroids(spark, d))


@query("few_shot_examples", with_views("fse") + "SELECT * FROM fse",
       headline=True)
def q_few_shot_examples(spark, d):
    f = few_shot(spark, d)
    return f.select("persona_id", "example_no", "cluster", "member_id", r6("sim").alias("sim"))


@query("embedding_text_roundtrip", """
SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total
FROM embeddings""")
def q_embedding_text_roundtrip(spark, d):
    e = VEC.embedding_to_text(V.table(spark, d, "embeddings"))
    back = VEC.embedding_from_text(e.select("vec_id", "embedding_text"))
    return back.select("vec_id", F.size("embedding").alias("dims"),
                       r6(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query("centroid_cosine", """
WITH el AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS dim FROM embeddings),
     a AS (SELECT dim, avg(v) AS c FROM el WHERE label % 2 = 0 GROUP BY dim),
     b AS (SELECT dim, avg(v) AS c FROM el WHERE label % 2 = 1 GROUP BY dim)
SELECT round(sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c))), 6) AS centroid_cosine
FROM a JOIN b USING (dim)""")
def q_centroid_cosine(spark, d):
    e = V.table(spark, d, "embeddings")
    c = VEC.centroid_cosine(e, F.pmod("label", F.lit(2)))
    return c.select(r6("centroid_cosine").alias("centroid_cosine"))


@query("embed_text")
def q_embed_text(spark, d):
    return VEC.embed_text(V.v_doc_posts(spark, d), dim=384).select("TID", "embedding")


@query("embed_text_trained")
def q_embed_text_trained(spark, d):
    """The same texts along the leading directions of the corpus."""
    posts = V.v_doc_posts(spark, d).select("TID", "text")
    return train_encoder(posts, dim=64, seed=SEED).encode(posts).select("TID", "embedding")


@query("cluster_embeddings")
def q_cluster_embeddings(spark, d):
    """Mini-batch k-means as published: k = 200, batches of 1,000, best of 3 starts."""
    e = emb(spark, d)
    return mini_batch_kmeans(e, "vec_id", "embedding", k=200, seed=SEED, starts=3, batch=1000).assign(e).select("vec_id", "cluster")


# -------------------------------------------------------------- classifiers ---

def users(sent):
    """User means with a class label: odd order numbers are 'positive', even ones 'control'."""
    m = prep.user_feature_means(sent.withColumn("user_id", user_from_tid("TID")), FEATS)
    lab = F.when(F.pmod(F.col("user_id").cast("long"), F.lit(2)) == 1, "positive").otherwise("control")
    return prep.label_encode(m.withColumn("label", lab), "label", "positive")


def auth_users(spark, d):
    return users(V.v_sent_auth(spark, d))


def syn_users(spark, d):
    return users(V.v_sent_syn(spark, d))


_avg = ", ".join(f"avg({f}) AS {f}" for f in FEATS)
for _name, _view in (("auth_u", "v_sent_auth"), ("syn_u", "v_sent_syn")):
    define(_name, [_view], f"""
SELECT *, CASE WHEN CAST(user_id AS BIGINT) % 2 = 1 THEN 'positive' ELSE 'control' END AS label,
       CAST(CAST(user_id AS BIGINT) % 2 = 1 AS BIGINT) AS y
FROM (SELECT split_part(TID, '_', 1) AS user_id, {_avg} FROM {_view} GROUP BY 1)""")

H_USER = md5_rank_key_sql(SEED, "user_id")
define("split", ["auth_u"], f"""
SELECT user_id, y, CASE WHEN rk <= n - ceil(n * 0.2) THEN 'train'
                        WHEN rk <= n - ceil(n * 0.2) + (ceil(n * 0.2) - ceil(ceil(n * 0.2) * 0.5)) THEN 'dev'
                        ELSE 'test' END AS split
FROM (SELECT user_id, y, row_number() OVER (PARTITION BY y ORDER BY {H_USER}, user_id) AS rk,
             count(*) OVER (PARTITION BY y) AS n FROM auth_u)""")


def _frac_sql(src: str, frac: float) -> str:
    return f"""(SELECT * EXCLUDE (rk, n) FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {H_USER}, user_id) AS rk,
                count(*) OVER (PARTITION BY y) AS n FROM {src}) WHERE rk <= floor(n * {frac}))"""


def split(spark, d):
    return M.stratified_split(auth_users(spark, d), "y", ["user_id"], SEED)


@query("label_encode", with_views("auth_u") + "SELECT user_id, label, y FROM auth_u")
def q_label_encode(spark, d):
    return auth_users(spark, d).select("user_id", "label", "y")


@query("stratified_split", with_views("split") + "SELECT * FROM split", headline=True)
def q_stratified_split(spark, d):
    return split(spark, d).select("user_id", "y", "split")


@query("fraction_sample", with_views("auth_u") + "SELECT user_id, y FROM " + _frac_sql("auth_u", 0.5))
def q_fraction_sample(spark, d):
    return M.fraction_sample(auth_users(spark, d), 0.5, seed=SEED).select("user_id", "y")


@query("fraction_sample_round", with_views("auth_u") + "SELECT user_id, y FROM " + _frac_sql("auth_u", 0.3).replace(
    "floor(n * 0.3)", "round_even(n * 0.3, 0)"))
def q_fraction_sample_round(spark, d):
    """The other published rule: the share of a class rounded, half to even."""
    return M.fraction_sample(auth_users(spark, d), 0.3, seed=SEED, rounding="round").select("user_id", "y")


@query("augment_sample", with_views("syn_u") + "SELECT user_id, y FROM " + _frac_sql("(SELECT * FROM syn_u WHERE y = 1)", 0.5))
def q_augment_sample(spark, d):
    pos = syn_users(spark, d).where(F.col("y") == 1)
    return M.fraction_sample(pos, 0.5, seed=SEED).select("user_id", "y")


@query("augmented_train", with_views("split", "auth_u", "syn_u") + f"""
SELECT user_id, y, 'authentic' AS origin FROM {_frac_sql("(SELECT * FROM split WHERE split = 'train')", 1.0)}
UNION ALL SELECT user_id, y, 'synthetic' FROM {_frac_sql("(SELECT user_id, CAST(1 AS BIGINT) AS y FROM syn_u WHERE label = 'positive')", 0.5)}
UNION ALL SELECT user_id, y, 'synthetic' FROM {_frac_sql("(SELECT user_id, CAST(0 AS BIGINT) AS y FROM syn_u WHERE label = 'control')", 0.5)}""")
def q_augmented_train(spark, d):
    train = split(spark, d).where(F.col("split") == "train").select("user_id", "y")
    syn = syn_users(spark, d)
    pos = syn.where(F.col("label") == "positive").select("user_id")
    ctrl = syn.where(F.col("label") == "control").select("user_id")
    aug = M.augmented_train(train, pos, ctrl, auth_frac=1.0, syn_pos_frac=0.5, syn_ctrl_frac=0.5, seed=SEED)
    return aug.select("user_id", "y", "origin")


@query("augmented_final", with_views("split", "auth_u", "syn_u") + f"""
SELECT user_id, y, 'authentic' AS origin FROM {_frac_sql("(SELECT * FROM split WHERE split = 'train')", 1.0)}
UNION ALL SELECT user_id, y, 'authentic' FROM split WHERE split = 'dev'
UNION ALL SELECT user_id, y, 'synthetic' FROM {_frac_sql("(SELECT user_id, CAST(1 AS BIGINT) AS y FROM syn_u WHERE label = 'positive')", 0.5)}
UNION ALL SELECT user_id, y, 'synthetic' FROM {_frac_sql("(SELECT user_id, CAST(0 AS BIGINT) AS y FROM syn_u WHERE label = 'control')", 0.5)}""")
def q_augmented_final(spark, d):
    parts = split(spark, d).select("split", "user_id", "y")
    train, dev = (parts.where(F.col("split") == x).drop("split") for x in ("train", "dev"))
    syn = syn_users(spark, d)
    pos = syn.where(F.col("label") == "positive").select("user_id")
    ctrl = syn.where(F.col("label") == "control").select("user_id")
    aug = M.augmented_train(train, pos, ctrl, auth_frac=1.0, syn_pos_frac=0.5, syn_ctrl_frac=0.5, seed=SEED, dev=dev)
    return aug.select("user_id", "y", "origin")


def _kept_split(spark, d):
    """The split; for a training set above ``SPARK_ROWS`` written once, as its parts are read many times."""
    s = split(spark, d)
    kept = stored(s, "split")
    return kept if kept.where(F.col("split") == "train").count() > M.SPARK_ROWS else s


@query("final_model")
def q_final_model(spark, d):
    """The grid point with the best dev F1, refitted on train and dev, judged on test."""
    s = _kept_split(spark, d)
    part = lambda x: s.where(F.col("split") == x)
    best = M.rf_grid_search(part("train"), part("dev"), FEATS, "y", SEED)[1]
    pred = M.final_fit(part("train"), part("dev"), part("test"), FEATS, best, "y", SEED)
    return M.classification_report(pred, "y", "prediction")


MMD_BLOCK, MMD_PERMUTATIONS = 16, 99
MMD_SQL = f"""
WITH e AS (SELECT vec_id, label % 2 AS g, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND label % 2 IN (0, 1)),
r AS (SELECT *, (row_number() OVER (PARTITION BY g ORDER BY {md5_rank_key_sql(SEED, "vec_id")}, vec_id) - 1) // {MMD_BLOCK} AS blk FROM e),
f AS (SELECT * FROM r WHERE blk < (SELECT min(n) // {MMD_BLOCK} FROM (SELECT count(*) AS n FROM e GROUP BY g))),
k AS (SELECT a.blk, a.vec_id AS ia, b.vec_id AS ib, a.g = b.g AS same,
        exp(-list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS k
      FROM f a JOIN f b ON a.blk = b.blk AND a.vec_id <> b.vec_id),
h AS (SELECT avg(h) AS mmd2, count(*) AS blocks FROM (SELECT blk, sum(k) FILTER (same) / {MMD_BLOCK * (MMD_BLOCK - 1)}
        - sum(k) FILTER (NOT same) / {MMD_BLOCK ** 2} AS h FROM k GROUP BY blk)),
q AS (SELECT p, blk, vec_id, row_number() OVER (PARTITION BY p, blk ORDER BY {md5_rank_key_sql(SEED, "p", "vec_id")}, vec_id) <= {MMD_BLOCK} AS x
      FROM f, (SELECT unnest(range({MMD_PERMUTATIONS})) AS p)),
o AS (SELECT p, avg(h) AS h FROM (SELECT a.p, k.blk, sum(k.k) FILTER (a.x = b.x) / {MMD_BLOCK * (MMD_BLOCK - 1)}
        - sum(k.k) FILTER (a.x <> b.x) / {MMD_BLOCK ** 2} AS h
      FROM k JOIN q a ON a.blk = k.blk AND a.vec_id = k.ia JOIN q b ON b.blk = k.blk AND b.vec_id = k.ib AND b.p = a.p GROUP BY ALL) GROUP BY p)
SELECT round(h.mmd2, 6) AS mmd2, (1 + (SELECT count(*) FROM o WHERE o.h >= h.mmd2 - 1e-12)) / {MMD_PERMUTATIONS + 1}.0 AS p_value, h.blocks
FROM h"""


@query("mmd2", MMD_SQL)
def q_mmd2(spark, d):
    m = VEC.mmd2(V.table(spark, d, "embeddings"), F.pmod("label", F.lit(2)), block=MMD_BLOCK, permutations=MMD_PERMUTATIONS, seed=SEED)
    return m.select(r6("mmd2").alias("mmd2"), "p_value", "blocks")


@query("mmd2_features")
def q_mmd2_features(spark, d):
    """The same distance by random features, and the error that they leave."""
    return VEC.mmd2_features(V.table(spark, d, "embeddings"), F.pmod("label", F.lit(2)), 64, gamma=1.0)


@query("first_n_personas", with_views("v_personas") + "SELECT persona_id, persona_text FROM v_personas ORDER BY persona_id LIMIT 20")
def q_first_n_personas(spark, d):
    from postlens.operators import sampling

    return sampling.first_rows(V.v_personas(spark, d), 20, ["persona_id"]).select("persona_id", "persona_text")


@query("holdout_split", with_views("v_posts", "v_meta") + """
SELECT user_id, CASE WHEN user_id IN (SELECT DISTINCT CAST(conv_id AS VARCHAR) FROM conversations WHERE role = 'system'
                                      UNION SELECT user_id FROM v_meta WHERE word_count >= 150) THEN 'test' ELSE 'pool' END AS part
FROM (SELECT DISTINCT user_id FROM v_posts)""")
def q_holdout_split(spark, d):
    from postlens.plans.q_prep import list_a, list_b

    u = V.v_posts(spark, d).select("user_id").distinct()
    return M.holdout_split(u, prep.union_ids(list_a(spark, d), list_b(spark, d)))


@query("classification_report", with_views("v_scores") + """
, c AS (SELECT count(*) FILTER (WHERE y = 0 AND pred = 0) AS n00, count(*) FILTER (WHERE y = 0 AND pred = 1) AS n01,
               count(*) FILTER (WHERE y = 1 AND pred = 0) AS n10, count(*) FILTER (WHERE y = 1 AND pred = 1) AS n11 FROM v_scores),
  k AS (SELECT *,
          CASE WHEN n00 + n10 > 0 THEN n00 / (n00 + n10) ELSE 0.0 END AS p0, CASE WHEN n00 + n01 > 0 THEN n00 / (n00 + n01) ELSE 0.0 END AS r0,
          CASE WHEN n11 + n01 > 0 THEN n11 / (n11 + n01) ELSE 0.0 END AS p1, CASE WHEN n11 + n10 > 0 THEN n11 / (n11 + n10) ELSE 0.0 END AS r1,
          n00 + n01 AS s0, n10 + n11 AS s1 FROM c),
  f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0.0 END AS f0,
                  CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0.0 END AS f1 FROM k)
SELECT '0' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, s0 AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), s1 FROM f
UNION ALL SELECT 'accuracy', round((n00 + n11) / (s0 + s1), 6), round((n00 + n11) / (s0 + s1), 6), round((n00 + n11) / (s0 + s1), 6), s0 + s1 FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), s0 + s1 FROM f
UNION ALL SELECT 'weighted avg', round((p0 * s0 + p1 * s1) / (s0 + s1), 6), round((r0 * s0 + r1 * s1) / (s0 + s1), 6),
                 round((f0 * s0 + f1 * s1) / (s0 + s1), 6), s0 + s1 FROM f""")
def q_classification_report(spark, d):
    r = M.classification_report(V.v_scores(spark, d), "y", "pred")
    return r.select("label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


AUC_SQL = """
SELECT {g} round(CASE WHEN sum(pos) > 0 AND max(nt) > 0 THEN sum(pos * (nb + neg / 2.0)) / (sum(pos) * max(nt)) END, 6) AS auc FROM (
  SELECT {g} score, pos, neg, coalesce(sum(neg) OVER (PARTITION BY {pg} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
         sum(neg) OVER (PARTITION BY {pg}) AS nt
  FROM (SELECT {g} score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM v_scores GROUP BY ALL))
{gb}"""


@query("roc_auc", with_views("v_scores") + AUC_SQL.format(g="", pg="1", gb=""))
def q_roc_auc(spark, d):
    return M.roc_auc(V.v_scores(spark, d), "y", "score").select(r6("auc").alias("auc"))


@query("metrics_by_setting", with_views("v_scores") + """
, a AS (""" + AUC_SQL.format(g="source,", pg="source", gb="GROUP BY source") + """),
  m AS (SELECT source, count(*) FILTER (WHERE y = pred) / count(*) AS accuracy,
               CASE WHEN 2 * count(*) FILTER (WHERE y = 1 AND pred = 1) + count(*) FILTER (WHERE y <> 1 AND pred = 1)
                         + count(*) FILTER (WHERE y = 1 AND pred <> 1) > 0
                    THEN 2 * count(*) FILTER (WHERE y = 1 AND pred = 1) / (2 * count(*) FILTER (WHERE y = 1 AND pred = 1)
                         + count(*) FILTER (WHERE y <> 1 AND pred = 1) + count(*) FILTER (WHERE y = 1 AND pred <> 1))
                    ELSE 0.0 END AS f1 FROM v_scores GROUP BY source)
SELECT m.source, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, a.auc FROM m LEFT JOIN a USING (source)""")
def q_metrics_by_setting(spark, d):
    m = M.metrics_by_group(V.v_scores(spark, d), "source")
    return m.select("source", r6("accuracy").alias("accuracy"), r6("f1").alias("f1"), r6("auc").alias("auc"))


def _train_test(spark, d, split=split):
    s = split(spark, d)
    return s.where(F.col("split") == "train"), s.where(F.col("split") == "test")


@query("random_forest")
def q_random_forest(spark, d):
    train, test = _train_test(spark, d, _kept_split)
    if train.count() > M.SPARK_ROWS:
        return M.forest_predictions(train, test, FEATS, "y", SEED).select("user_id", "y", "prediction", "score")
    m = M.random_forest(train, FEATS, "y", SEED, **M.rf_params(None, 1, 100))
    return M.predict(m, test, FEATS).select("user_id", "y", "prediction", "score")


@query("rf_grid_search")
def q_rf_grid_search(spark, d):
    s = _kept_split(spark, d)
    results, best = M.rf_grid_search(s.where(F.col("split") == "train"), s.where(F.col("split") == "dev"), FEATS,
                                     "y", SEED)
    rows = [(r["n_estimators"], r["max_depth"], r["min_samples_split"], r["min_samples_leaf"], float(r["dev_f1"]),
             r is best) for r in results]
    return spark.createDataFrame(rows, "n_estimators int, max_depth int, min_samples_split int, min_samples_leaf int, "
                                       "dev_f1 double, best boolean")


@query("project_2d")
def q_project_2d(spark, d):
    return M.project_2d(auth_users(spark, d), FEATS, keep=["user_id", "label"])


@query("project_layout")
def q_project_layout(spark, d):
    """Every user's place in a non-linear two-column layout."""
    return landmark_layout(auth_users(spark, d), FEATS).select("user_id", r6("x").alias("x"), r6("y").alias("y"))


@query("logistic_regression")
def q_logistic_regression(spark, d):
    train, test = _train_test(spark, d)
    return M.linear_model("logistic_regression", train, test.select("user_id", "y", *FEATS), FEATS).select("user_id", "y", "prediction")


@query("linear_svm")
def q_linear_svm(spark, d):
    train, test = _train_test(spark, d)
    return M.linear_model("linear_svm", train, test.select("user_id", "y", *FEATS), FEATS).select("user_id", "y", "prediction")

"""The registered queries of the training-data operators: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import (decontam, divergence, embed_dedup, langid, lbl_lm, pii, quality, quality_rules, simhash, sp_wfst,
                          token_records, toxicity, whitening)
from postlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle:
            ORACLES[key] = oracle
        return fn
    return deco


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_records")
def op1(spark, d):
    r = token_records.round_trip(table(spark, d, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)
    return r.select(F.col("id").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark),
w AS (SELECT DISTINCT item, array_to_string(ws[i + 1:i + 13], ' ') AS win, least(len(ws), 13) AS n
  FROM (SELECT item, ws, unnest(range(0, greatest(len(ws) - 12, 1))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
g AS (SELECT doc_id, i, n, array_to_string(ws[i + 1:i + n], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT g.doc_id, g.i, g.n, w.item FROM g JOIN w ON g.win = w.win AND g.n = w.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, coalesce(t.items_sha256, sha256('')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


@query("op2_decontamination", OP2_SQL)
def op2(spark, d):
    r = decontam.contamination(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return r.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items",
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


@query("op3_lm_scoring")
def op3(spark, d):
    return lbl_lm.scored(table(spark, d, "documents"))


@query("op4_simhash_near_dedup")
def op4(spark, d):
    r = simhash.near_duplicates(table(spark, d, "documents"), "doc_id", "text", width=3, max_bits=2)
    return r.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_embedding_near_dedup")
def op5(spark, d):
    r = embed_dedup.near_duplicates(table(spark, d, "embeddings"), "vec_id", "embedding", threshold=0.95)
    return r.withColumnRenamed("id", "vec_id")


@query("op6_quality_classifier")
def op6(spark, d):
    docs = table(spark, d, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, d, "labels")))


@query("op7_language_id")
def op7(spark, d):
    return langid.identified(table(spark, d, "documents"))


@query("op8_sentencepiece")
def op8(spark, d):
    return sp_wfst.digests(table(spark, d, "documents"), tokenizer("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


@query("op9_toxicity")
def op9(spark, d):
    docs = table(spark, d, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, d, "labels")))


@query("op10_pii")
def op10(spark, d):
    found, _ = pii.detect(table(spark, d, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"),
                        pii.listed(F.col("spans")).alias("spans"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
keep AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) JOIN keep USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM keep GROUP BY lang),
m AS (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n FROM g JOIN keep k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS gn, sum(n) OVER (PARTITION BY lang) AS ln,
  sum(n) OVER (PARTITION BY lang, term) AS tn FROM m),
p AS (SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 2)) // (gn + 2 * v) AS HUGEINT) AS p,
  CAST(1 + (1000000000 * (tn + 2)) // (ln + 2 * v) AS HUGEINT) AS q FROM t JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 10"""


@query("op11_source_divergence", OP11_SQL)
def op11(spark, d):
    return divergence.report(table(spark, d, "documents"), min_docs=10, top=10)


@query("op12_embedding_whitening")
def op12(spark, d):
    return whitening.whiten(table(spark, d, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


@query("op13_quality_rules")
def op13(spark, d):
    r, _ = quality_rules.judged(table(spark, d, "documents"), keep=["doc_id"])
    return r.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept")

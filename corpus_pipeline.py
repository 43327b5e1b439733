"""A training-corpus pipeline over ``documents``: each stage is one operator of ``postlens.llm``.

A stage takes (spark, docs, sf_dir) and works on all documents that the stage before
kept. Toxic documents go, one document of each near-duplicate group stays,
contaminated documents go, personal data is masked, and what is left is encoded. Each
result is a table in the shared folder, read again as the next stage's documents, so
a lost executor costs no more than the running stage's tasks.

Null and empty texts are documents like any other (near-duplicates of one another, so one stays). Rows that
repeat an id and a text are one document from near_dedup on; repeated or null ids with different texts
stay apart. Ties go to the smallest id. Very long texts are worked on whole, in pieces. Further columns, also
of clashing names, pass unchanged up to the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.llm import decontam, pii, simhash, sp_wfst, toxicity
from postlens.llm.common import stored, table
from postlens.llm.queries import tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on this stage's documents and ``labels``, does not reject."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: three-word shingles, at most two bits."""
    return simhash.keep_one(docs, "doc_id", "text", width=3, max_bits=2)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by ``benchmark``: one word in twenty inside 13-word passages of it."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked by its kind; ``n_chars``, where there is one, follows the text."""
    out = pii.redact(docs, "text")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_pieces, ids): the encoded corpus; lang and source are null where ``docs`` has no such column."""
    extra = [(F.col(c) if c in docs.columns else F.lit(None).cast("string")).alias(f"_{c}") for c in ("lang", "source")]
    e = sp_wfst.encode(docs, tokenizer("piece_bpe_32k.model"), "doc_id", "text", extra)
    return e.select(F.col("id").alias("doc_id"), F.col("_lang").alias("lang"), F.col("_source").alias("source"),
                    F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate),
          ("pii", mask_pii), ("sentencepiece", encode)]

#: No SQL for run()'s rows: classifiers, XXH64 bit votes and shortest paths are beyond it; tests/llm use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages; each result is written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs

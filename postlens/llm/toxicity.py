"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents against unlabelled text, with a class prior estimated
from the two; see ``pu`` for the risk and ``text_classifier`` for features and
bounds. A text without words scores as the features of an empty text do; repeated or null ids, ties,
empty tables, clashing columns and very long texts are treated as ``text_classifier`` states.
``without_toxic`` returns exactly the columns that it was given, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import text_classifier as T
from postlens.llm.common import crc_mod

THRESHOLD = 0.5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> T.Model:
    return T.fit(docs, labels, "toxic", crc_mod(id_col, 5) != 0, id_col)


def scored(docs: DataFrame, model: T.Model, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document row."""
    s = T.score(docs, model, id_col)
    return s.select(F.col("id").alias(id_col), (crc_mod("id", 5) == 0).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: T.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those predicted toxic; all columns stay as they are, scored in one pass, no join."""
    own = {c: f"_postlens_{k}" for k, c in enumerate(docs.columns)}
    extra = [F.col(f"`{c}`").alias(n) for c, n in own.items() if c != text_col]
    s = T.score(docs, model, id_col, text_col, extra, keep_text=own[text_col])
    return s.where(F.col("score") < THRESHOLD).select(*[F.col(n).alias(c) for c, n in own.items()])

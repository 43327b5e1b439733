"""Quality by non-negative positive-unlabelled learning.

Trusted good documents against unlabelled web text, with a class prior estimated
from the two; see ``pu`` for the risk and ``text_classifier`` for features and bounds.
Junk shows in its form more than in its words: style features are all used, words
only where they differ strongly. Odd rows (null and empty texts, repeated or null ids, ties, empty tables,
clashing columns, very long texts) are treated as ``text_classifier`` states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.llm import text_classifier as T
from postlens.llm.common import crc_mod

THRESHOLD = 0.7


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> T.Model:
    return T.fit(docs, labels, "quality", crc_mod(id_col, 4) != 2, id_col, strength_over=8.0, style_always=True,
                 steps=2000, rate=0.1, l2=1e-6)


def scored(docs: DataFrame, model: T.Model, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document row."""
    s = T.score(docs, model, id_col)
    return s.select(F.col("id").alias(id_col), (crc_mod("id", 4) == 2).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

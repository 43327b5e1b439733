"""Token-level measures named in the published README (no code there; semantics ours)."""

from __future__ import annotations

from pyspark.ml.feature import RegexTokenizer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.functions.stop_words import STOP_WORDS
from postlens.functions.text import words
from postlens.session import stored

TOKEN_PATTERN = r"\W+"


def tokens_no_stopwords(df: DataFrame, text_col: str = "text", out: str = "tokens") -> DataFrame:
    """Lower-cased word tokens without English stop words (MLlib RegexTokenizer + StopWordsRemover)."""
    tok = RegexTokenizer(inputCol=text_col, outputCol="_pl_all", pattern=TOKEN_PATTERN, toLowercase=True)
    rm = StopWordsRemover(inputCol="_pl_all", outputCol=out, stopWords=STOP_WORDS)
    return rm.transform(tok.transform(df.na.fill("", [text_col]))).withColumnRenamed("_pl_all", "all_tokens")


HEAVY_TERMS = 1000


def tf_idf(tokens: DataFrame, doc_col: str, tokens_col: str = "tokens", heavy_terms: int = HEAVY_TERMS) -> DataFrame:
    """(doc, term, tf, df, tf_idf) with idf = ln((N + 1) / (df + 1)), MLlib's formula, in SQL form.

    A term with a ``heavy_terms``-th of all (doc, term) rows or more is heavy. There are at most ``heavy_terms`` of
    them whatever the data (their rows add up to no more than all), so their document frequencies are broadcast and
    their rows stay where they are; only the other terms are joined by a shuffle, in which no term has
    more than that share. Nothing rests on AQE's skew join. The counts by (doc, term), and by term, are written once to the shared
    folder, so texts are read and cut into tokens once. Null terms are left out.
    """
    # the outer form, as Spark evaluates the tokens of the other twice more, to test for empty arrays
    terms = tokens.select(doc_col, F.explode_outer(tokens_col).alias("term")).where(F.col("term").isNotNull())
    tf = stored(terms.groupBy(doc_col, "term").agg(F.count(F.lit(1)).alias("tf")), "tf")
    n_docs = tokens.select(F.count(F.lit(1))).scalar()
    dfreq = stored(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "df")
    is_heavy = F.col("df") * heavy_terms >= dfreq.agg(F.sum("df")).scalar()
    heavy = F.broadcast(dfreq.where(is_heavy))
    many = tf.join(heavy, "term")
    few = tf.join(heavy, "term", "left_anti").join(dfreq.where(~is_heavy), "term")
    return many.unionByName(few).withColumn("tf_idf", F.col("tf") * F.log((n_docs + 1) / (F.col("df") + 1)))


def lexical_diversity(df: DataFrame, text_col: str = "text") -> DataFrame:
    w = words(text_col)
    return df.withColumn("lexical_diversity", F.try_divide(F.size(F.array_distinct(w)).cast("double"), F.size(w)))

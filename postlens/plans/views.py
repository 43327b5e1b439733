"""Stand-in views over the driver tables (Spark side).

The reference reads post CSVs, metadata JSONL, sentence-feature CSVs, embedding
CSVs and generated-comment CSVs that are not shipped. These views derive tables
of the same shape from the given parquet tables, over whole tables: no id
subsets, no row caps. ``oracle_views.py`` repeats each one as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens.functions.text import word_count

# Test phrases appended to conversation turns so that the disclosure patterns have
# something to find (the invented prose contains no disclosures). One or more per
# pattern, one that must not match, one with two ages, and one empty phrase.
DISCLOSURE_PHRASES = [
    "I'm 25 and tired of this",
    "honestly I am 34 now",
    "I was 12 back then",
    "posting as 19M here",
    "I'm a 22 year old student",
    "I just turned 30 last month",
    "turned 40 this week",
    "when I was around 9",
    "back in 8th grade",
    "started high school at 14",
    "age: 27",
    "just reached 50",
    "still 17 though",
    "now that I'm 40",
    "I'm now 33",
    "I'm already 60",
    "I'm a guy who likes trains",
    "I'm a trans woman",
    "my pronouns are they/them",
    "I'm transgender",
    "I'm non-binary",
    "I'm genderfluid",
    "as a woman in tech",
    "I've always been a boy at heart",
    "I'm studying biology at the university",
    "I'm a chemistry major",
    "just got accepted to law school",
    "enrolled in a nursing program",
    "senior at college now",
    "graduated with a BS in physics",
    "I'm a teenager",
    "I'm a preteen",
    "I'm a minor",
    "I'm under 21",
    "a young adult novel fan",
    "a twentysomething",
    "I'm too young to vote",
    "i m attracted to women",
    "my girlfriend says hi",
    "she said I was cute",
    "taking a gap year",
    "met at the campus library",
    "alumni meetup",
    "I'm attracted to men",
    "I'm 17 and my sister is 21F",
    "",
    "my boyfriend and I",
    "as a guy",
    "my pronouns are she/her",
    "graduated with a MS in math",
    "graduated with a bachelor's in art",
    "graduated with an associate's in law",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_posts(spark, sf_dir) -> DataFrame:
    """Posts: one conversation = one user, one turn = one post. Order key (conv_id, turn)."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("user_id"),
        F.col("turn").cast("string").alias("post_id"),
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("TID"),
        F.col("turn").cast("long").alias("created_utc"),
        F.when(F.col("role") == "user", "post").otherwise("comment").alias("type"),
        "text",
        F.lit("en").alias("language"),
        "conv_id",
        "turn",
    )


def v_meta(spark, sf_dir) -> DataFrame:
    """Post metadata; system turns carry none, so some posts find no match."""
    c = table(spark, sf_dir, "conversations").where(F.col("role") != "system")
    return c.select(
        F.col("conv_id").cast("string").alias("user_id"),
        F.col("turn").cast("string").alias("post_id"),
        F.col("turn").cast("long").alias("created_utc"),
        word_count("text").alias("word_count"),
    )


def v_doc_posts(spark, sf_dir) -> DataFrame:
    """Long posts: one source = one user. Order key doc_id."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("source").alias("user_id"),
        F.col("doc_id").cast("string").alias("post_id"),
        F.concat_ws("_", F.col("source"), F.col("doc_id").cast("string")).alias("TID"),
        "text",
        F.col("lang").alias("language"),
        "doc_id",
    )


def v_disclosure_posts(spark, sf_dir) -> DataFrame:
    """Posts with one test phrase appended (phrase chosen from the row's key)."""
    phrases = F.array(*[F.lit(p) for p in DISCLOSURE_PHRASES])
    idx = F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(DISCLOSURE_PHRASES))) + 1
    return v_posts(spark, sf_dir).withColumn(
        "text", F.concat(F.col("text"), F.lit(" "), F.element_at(phrases, idx.cast("int"))))


SENT_FEATURES = ["wid", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _sentences(spark, sf_dir, status: str | None = None) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    li = li if status is None else li.where(F.col("l_linestatus") == status)
    return li.select(
        F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("TID"),
        F.col("l_suppkey").alias("sid"),
        F.col("l_returnflag").alias("label"),
        F.lit("corpus").alias("source"),
        F.lit("none").alias("model"),
        F.col("l_linenumber").cast("double").alias("wid"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    )


def v_sent(spark, sf_dir) -> DataFrame:
    """Sentence features of both corpora (all line items)."""
    return _sentences(spark, sf_dir)


def v_sent_auth(spark, sf_dir) -> DataFrame:
    """Sentence features of the authentic corpus (closed line items)."""
    return _sentences(spark, sf_dir, "F")


def v_sent_syn(spark, sf_dir) -> DataFrame:
    """Sentence features of the synthetic corpus (open line items)."""
    return _sentences(spark, sf_dir, "O")


def v_emb(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("string").alias("TID"), "vec_id", "embedding",
                    F.col("label").cast("long").alias("cluster"))


def v_personas(spark, sf_dir) -> DataFrame:
    """Every embedding is a persona; its text is the document with the same id, if any."""
    e = table(spark, sf_dir, "embeddings")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("persona_text"))
    return e.join(d, "vec_id", "left").select(F.col("vec_id").alias("persona_id"), "embedding", "persona_text")


def v_member_texts(spark, sf_dir) -> DataFrame:
    """The text behind every embedding: the document with the same id, empty if there is none."""
    p = v_personas(spark, sf_dir)
    return p.select(F.col("persona_id").alias("vec_id"), F.coalesce("persona_text", F.lit("")).alias("text"))


def v_generated(spark, sf_dir) -> DataFrame:
    """Generation attempts: one conversation = one prompt, turn + 1 = attempt number.

    The case number ``(conv_id * 3 + turn) % 11`` decides how the text is altered,
    so every screening rule and sentinel appears in the data.
    """
    c = table(spark, sf_dir, "conversations")
    k = F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(11))
    t = F.col("text")
    text = (F.when(k == 0, F.when(F.pmod("conv_id", F.lit(2)) == 0, F.concat(F.lit('"'), t, F.lit('"')))
                   .otherwise(F.concat(F.lit("  '"), t, F.lit("' "))))
            .when(k == 1, F.concat(F.lit("Here is my comment: "), t))
            .when(k == 2, F.concat(F.lit("AI "), t))
            .when(k == 3, F.concat(t, F.lit(" Hope this helps")))
            .when(k == 4, F.lit(""))
            .when(k == 5, F.lit("[No valid comment generated]"))
            .when(k == 6, F.lit("[No valid comment]"))
            .when(k == 7, F.lit("[Error: model timed out]"))
            .when(k == 8, F.concat(F.lit("His take: "), t))
            .when(k == 9, F.concat(t, F.lit(" living with bipolar is hard")))
            .otherwise(t))
    return c.select(F.col("conv_id").alias("prompt_id"), (F.col("turn") + 1).alias("attempt"),
                    text.alias("text"))


def v_scores(spark, sf_dir) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    doc = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    j = lab.join(doc, "doc_id")
    score = (F.pmod(F.col("n_chars"), F.lit(1000)) / F.lit(1000.0))
    return j.select("doc_id", "source", F.col("quality").cast("long").alias("y"), score.alias("score"),
                    (score >= 0.5).cast("long").alias("pred"))


# Header with stray blanks and case, values with stray case and blanks.
GENDER_CSV_HEADER = " Gender Identity "
GENDER_VALUES = ["Male", " male ", "FEMALE", "female", "", "Other", "MALE "]


def v_gender_csv(spark, sf_dir) -> DataFrame:
    cu = table(spark, sf_dir, "customer")
    vals = F.array(*[F.lit(v) for v in GENDER_VALUES])
    g = F.element_at(vals, (F.pmod("c_custkey", F.lit(len(GENDER_VALUES))) + 1).cast("int"))
    return cu.select(F.col("c_custkey").alias("Row ID"), F.col("c_name").alias(" Name"),
                     g.alias(GENDER_CSV_HEADER), F.col("c_mktsegment").alias("Market  Segment"))

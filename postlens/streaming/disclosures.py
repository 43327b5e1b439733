"""Disclosure extraction over arriving JSON-lines files (Structured Streaming).

The published manual path reads a metadata JSONL file line by line, skips
malformed lines and extracts disclosures from every post. Here new files in a
folder are picked up as micro-batches; extraction is stateless and runs with
the same column expressions as the batch operator. Malformed lines are dropped
by the parser. The latest-per-(user, trait) choice stays a batch step over the
appended output (``operators.disclosures.latest_disclosures`` logic via
``first_by_order``), so no unbounded state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.functions.text import truncate_text
from postlens.operators.disclosures import extract_disclosures
from postlens.sources.files import parse_tolerant

META_SCHEMA = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("post_id", T.StringType()),
                            T.StructField("text", T.StringType()), T.StructField("created_utc", T.LongType())])


def disclosure_stream(spark: SparkSession, in_dir: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming DataFrame of disclosures from JSONL files appearing in ``in_dir``."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger).text(in_dir)
    src = parse_tolerant(lines, META_SCHEMA, {"user_id": "", "text": "", "created_utc": 0}).withColumn(
        "OriginalText", truncate_text("text"))
    ex = extract_disclosures(src, "text", keep=["user_id", "post_id", "created_utc", "OriginalText"])
    return ex.select(F.concat(F.lit("user_"), "user_id").alias("UserID"), "post_id", "Trait", "DisclosureType",
                     "MatchedPhrase", "Normalized", F.col("created_utc").alias("CreatedUTC"), "OriginalText",
                     "pattern_ord", "match_idx")


def run_to_parquet(spark: SparkSession, in_dir: str, out_dir: str, checkpoint_dir: str, available_now: bool = True):
    """Append every micro-batch to parquet; the checkpoint makes restarts exactly-once."""
    q = (disclosure_stream(spark, in_dir).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="30 seconds")
    return q.start()

"""File sources and sinks: CSV, JSON lines, tolerant JSON lines, separator sniffing.

Readers always take an explicit schema (never ``inferSchema``). Scratch output
goes under the session's checkpoint directory, which on a cluster names a shared
folder; nothing is written to a machine-local temporary directory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlens.session import scratch

SEP_CANDIDATES = [",", "    ", ";"]  # comma, four spaces, semicolon; comma is the fallback
NULL_SENTINEL = "\u0000__postlens_null__"


def scratch_path(spark: SparkSession, name: str) -> str:
    return scratch(spark, f"io-{name}")


def all_string_schema(cols) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def write_csv(df: DataFrame, path: str, sep: str = ",", quote_all: bool = False) -> str:
    """Header, RFC-4180 quoting (quote and escape ``"``); no index column. ``quote_all`` for separators that values may touch."""
    (df.write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("quoteAll", quote_all)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
             keep_empty: bool = False, multi_line: bool = False) -> DataFrame:
    """CSV with a header and quoted fields.

    ``keep_empty`` keeps empty fields as '' (not null), like an all-string read.
    Large files are split over tasks. ``multi_line`` allows line ends inside quoted fields; a
    file is then read by one task, so write such data as many files.
    """
    r = (spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"')
         .option("escape", '"').option("multiLine", multi_line).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False))
    if keep_empty:
        r = r.option("emptyValue", "").option("nullValue", NULL_SENTINEL)
    return r.csv(path)


def write_jsonl(df: DataFrame, path: str) -> str:
    """One JSON object per line, UTF-8 kept as is (no ASCII escaping)."""
    df.write.mode("overwrite").json(path)
    return path


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType, defaults: dict) -> DataFrame:
    """Skip lines that are no JSON object; fill missing fields with defaults (e.g. id '', text '', created 0)."""
    return parse_tolerant(spark.read.text(path), schema, defaults)


def parse_tolerant(lines: DataFrame, schema: T.StructType, defaults: dict) -> DataFrame:
    """Rows of ``lines(value)`` that are JSON objects, whatever the types of their fields.

    Only the JSON itself decides: a time written 1600000000, 1600000000.0 or "1600000000"
    is the same time. Fields are taken as text and cast; what cannot be cast is missing.
    """
    line = F.col("value")
    good = lines.where(F.try_parse_json(line).isNotNull() & F.ltrim(line).startswith("{"))
    fields = good.select(F.from_json(line, all_string_schema(schema.fieldNames())).alias("j")).select("j.*")

    def cast(f):
        c = F.col(f.name)
        if isinstance(f.dataType, T.IntegralType):
            c = F.coalesce(c.try_cast("decimal(38,0)"), c.try_cast("double")).try_cast(f.dataType)
        elif not isinstance(f.dataType, T.StringType):
            c = c.try_cast(f.dataType)
        if defaults.get(f.name) is not None:
            c = F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType))
        return c.alias(f.name)

    return fields.select(*[cast(f) for f in schema.fields])


def detect_separator(spark: SparkSession, path: str, sample_chars: int = 2048) -> str:
    """Choose the separator from the header line only (one line reaches the driver).

    The candidate occurring most often in the first ``sample_chars`` characters
    of the header wins; with none present, comma.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return ","
    head = first[0][0][:sample_chars]
    counts = [(head.count(c), -i, c) for i, c in enumerate(SEP_CANDIDATES)]
    best = max(counts)
    return best[2] if best[0] > 0 else ","


def header_columns(spark: SparkSession, path: str, sep: str) -> list[str]:
    import csv
    import io

    first = spark.read.text(path).limit(1).collect()[0][0]
    if len(sep) == 1:
        return next(csv.reader(io.StringIO(first), delimiter=sep))
    return [c[1:-1].replace('""', '"') if len(c) > 1 and c[0] == c[-1] == '"' else c for c in first.split(sep)]


def read_detect_sep(spark: SparkSession, path: str) -> DataFrame:
    """All-string read with a sniffed separator, of one character or several; empty fields stay '' (not null)."""
    sep = detect_separator(spark, path)
    return read_csv(spark, path, all_string_schema(header_columns(spark, path, sep)), sep=sep, keep_empty=True).na.fill("")

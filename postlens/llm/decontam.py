"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

``build_index`` tokenises every document once and stores its postings (row, position,
term) as Parquet in the shared folder, in document order, together with one row per
document that carries its id and word count. Postings are stored for the terms that
the searches will ask for (the words of the test windows); ``terms=None`` indexes all.

``exact_matches`` looks a window up as an inverted index does: corpus counts pick its
rarest terms; their lists, shifted by the terms' offsets, are intersected on
(document, start); what is left is checked against the lists of all its other terms.
So a word that a third of all documents hold costs nothing unless a window has no
rarer one. ``proximity_matches`` asks for all terms of a window near its rarest one.

Words: A-Z in lower case, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null and empty
texts have no words and give a result row with zeros; test items without words are
never found. Every row of ``documents`` has its own row number, so repeated ids and
rows are reported one by one; windows that tie in rarity take the earlier term. Very long texts are indexed whole:
their words are split in one row, their postings are rows of their own. Only the named columns are read. Empty tables give
empty lists. Broadcasts are asked for after a count; beyond ``BROADCAST_ROWS`` the
join is left to Spark as a shuffle join, where skewed terms are split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlens.llm.common import ascii_lower, stored

DELIMITERS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
RAREST = 2
BROADCAST_ROWS = 500_000


@dataclass
class Index:
    postings: DataFrame  # row, pos, term
    documents: DataFrame  # row, id, n_words, extra columns
    terms: DataFrame  # term, word


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """A broadcast hint if ``df`` (stored or small to count) has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    """array<string> of the words of a text, in order."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), DELIMITERS), lambda w: w != "")


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(windows: wid, words, n; members: wid, item): the distinct windows of all items, and whose they are.

    ``size`` consecutive words each; an item of fewer words, but not none, is one window.
    """
    w = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words(F.col(text_col)).alias("ws"))
    w = w.where(F.size("ws") > 0).select("item", F.explode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - size)),
        lambda i: F.slice("ws", i + 1, size))).alias("words"))
    w = stored(w.distinct(), "item-windows")
    windows = stored(w.select("words").distinct().select(
        F.monotonically_increasing_id().alias("wid"), "words", F.size("words").alias("n")), "windows")
    members = w.join(windows, "words").select("wid", "item")
    return windows, members


def build_index(docs: DataFrame, terms: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                extra: tuple | list = ()) -> Index:
    """Postings of ``docs`` for the words in ``terms(word)``, or for all words of the documents.

    One pass: split, number, look the words up, write. The text is split as it is and
    only single words are lower-cased, which spares a rewrite of the whole text.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
                       F.split(F.coalesce(F.col(text_col), F.lit("")), DELIMITERS).alias("ws"), *extra)
    lead = (F.element_at("ws", 1) == "").cast("int")
    tail = ((F.size("ws") > 1) & (F.element_at("ws", -1) == "")).cast("int")
    base = base.withColumn("n_words", (F.size("ws") - lead - tail).cast("long")).withColumn("lead", lead)
    if terms is None:
        all_words = base.select(F.explode("ws").alias("w")).select(ascii_lower(F.col("w")).alias("word"))
        terms = all_words.where("word <> ''").distinct()
    terms = stored(terms.select("word").distinct().select(F.monotonically_increasing_id().alias("term"), "word"), "terms")
    each = base.select("row", "id", "n_words", "lead", *extra, F.posexplode("ws").alias("at", "w"))
    each = each.withColumn("word", ascii_lower(F.col("w"))).join(maybe_broadcast(terms), "word", "left")
    first = F.col("at") == 0  # every document has such a row; it also carries what belongs to the document
    table = each.where(F.col("term").isNotNull() | first).select(
        "row", (F.col("at") - F.col("lead")).alias("pos"), "term",
        *[F.when(first, F.col(c)).alias(c) for c in ("id", "n_words", *extra)])
    table = stored(table, "postings")
    return Index(table.where(F.col("term").isNotNull()).select("row", "pos", "term"),
                 table.where(F.col("n_words").isNotNull()).select("row", "id", "n_words", *extra), terms)


def _window_terms(index: Index, windows: DataFrame) -> DataFrame:
    """(wid, n, off, term, cf) of the windows whose terms all occur in the corpus."""
    cf = index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    t = windows.select("wid", "n", F.posexplode("words").alias("off", "word")).join(index.terms, "word")
    t = t.join(cf, "term").select("wid", "n", "off", "term", "cf")
    whole = Window.partitionBy("wid")
    return stored(t.withColumn("found", F.count(F.lit(1)).over(whole)).where("found = n").drop("found"), "window-terms")


def exact_matches(index: Index, windows: DataFrame, rarest: int = RAREST) -> DataFrame:
    """(row, wid, start, n): every occurrence of every window, at word position ``start``."""
    terms = _window_terms(index, windows)
    ranked = terms.withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy("cf", "off")))
    ranked = stored(ranked, "ranked-terms")
    anchors = ranked.where(F.col("rank") <= rarest).select("term", "wid", "off", F.least("n", F.lit(rarest)).alias("need"))
    lists = index.postings.join(maybe_broadcast(anchors), "term").select(
        "row", "wid", (F.col("pos") - F.col("off")).alias("start"), "need").where("start >= 0")
    left = lists.groupBy("row", "wid", "start").agg(F.count(F.lit(1)).alias("got"), F.max("need").alias("need"))
    left = stored(left.where("got = need").select("row", "wid", "start"), "candidates")
    rest = ranked.where(F.col("rank") > rarest).select("wid", "off", "term")
    rows = maybe_broadcast(left.select("row").distinct())
    nearby = index.postings.join(rows, "row", "left_semi")
    asked = left.join(maybe_broadcast(rest), "wid").select(
        "row", "wid", "start", (F.col("start") + F.col("off")).alias("pos"), "term")
    seen = asked.join(nearby, ["row", "pos", "term"]).groupBy("row", "wid", "start").agg(F.count(F.lit(1)).alias("got"))
    sizes = maybe_broadcast(windows.select("wid", "n"))
    checked = seen.join(sizes, "wid").where(F.col("got") == F.col("n") - rarest)
    short = left.join(sizes, "wid").where(F.col("n") <= rarest)  # nothing left to check
    cols = ["row", "wid", "start", "n"]
    return checked.select(*cols).unionByName(short.select(*cols))


def proximity_matches(index: Index, windows: DataFrame, slop: int = 8) -> DataFrame:
    """(row, wid, pos): places of a window's rarest term with all its other terms within ``n + slop`` words, any order."""
    terms = _window_terms(index, windows)
    ranked = stored(terms.groupBy("wid", "n", "term").agg(F.min("cf").alias("cf")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("wid").orderBy("cf", "term"))), "ranked-terms")
    reach = F.col("n") + slop
    pivots = index.postings.join(maybe_broadcast(ranked.where("rank = 1").select("term", "wid", "n")), "term").select(
        "row", "wid", "n", F.col("pos").alias("pivot"))
    asked = pivots.join(maybe_broadcast(ranked.select("wid", "term")), "wid")
    longest = (windows.agg(F.max("n")).first()[0] or WINDOW) + slop  # no partner is more than a cell away
    cell = F.floor(F.col("pivot") / longest)
    asked = asked.select("*", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = index.postings.withColumn("cell", F.floor(F.col("pos") / longest))
    hit = asked.join(near, ["row", "cell", "term"]).where(F.abs(F.col("pos") - F.col("pivot")) <= reach)
    found = hit.groupBy("row", "wid", "pivot").agg(F.count_distinct("term").alias("got"))
    need = ranked.groupBy("wid").agg(F.count(F.lit(1)).alias("need"))
    return found.join(maybe_broadcast(need), "wid").where("got = need").select("row", "wid", F.col("pivot").alias("pos"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  size: int = WINDOW, extra: tuple | list = ()) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated, *extra), one row per document row.

    n_hit: words inside any occurrence of a window; items: ids with occurring windows,
    as sorted strings; contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    """
    windows, members = test_windows(items, text_col="text", size=size)
    vocabulary = windows.select(F.explode("words").alias("word")).distinct()
    index = build_index(docs, vocabulary, id_col, text_col, extra)
    found = stored(exact_matches(index, windows), "matches")
    covered = found.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("pos"))
    n_hit = covered.distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    owners = found.select("row", "wid").distinct().join(maybe_broadcast(members), "wid").select("row", "item").distinct()
    # at most one entry per test item
    by_row = owners.groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    out = index.documents.join(n_hit.join(by_row, "row"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
                      ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), *extra)


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated ones; rows are matched by id and hash of the text."""
    marked = docs.withColumn("_postlens_hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    bad = contamination(marked, items, id_col, text_col, extra=["_postlens_hash"]).where("contaminated").select(
        F.col("id").alias("_bad_id"), F.col("_postlens_hash").alias("_bad_hash")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("_bad_id")) & (F.col("_postlens_hash") == F.col("_bad_hash"))
    return marked.join(bad, same, "left_anti").drop("_postlens_hash")

"""Source divergence audit: how far the sources of a language differ in their use of terms.

Terms are runs of letters A-Z, a-z and of code points from U+0080, only A-Z
lower-cased. One ``bytes.translate`` lowers letters and blanks everything else,
``bytes.split`` cuts, and a Counter per document gives its terms' frequencies (a very
long text is split a megabyte at a time). A task adds these up by group (language,
source) in counters of at most ``HELD`` entries and sends them on as sparse rows, so a
source with a third of all documents sends at most its distinct terms a flush. Spark
sums by (language, term, source), keeps the terms in at least ``min_docs`` documents
of a language, and smooths counts to integers p = 1 + floor(10^9 (count + 2) / (N + 2 V)).

Two groups differ by the sum over the language's kept terms of floor((p - q)^2 / (p + q)).
Most terms are absent from most groups, where p is the group's constant p0: the sum is
V times the divergence of the two constants plus, over terms that one of them has, the
difference to that. Those terms are dealt out by (language, pair of tiles of about
``TILE`` sources, block of terms), never by language or source alone; a task lays its
block out as a matrix of terms by sources, a slice at a time, and returns one sum for
each pair of sources. All arithmetic is in 64-bit integers (products are formed by long
division in steps of 1000, exact while N + 2 V stays below 9 * 10^15).

Null text, language and source are read as ''. Empty texts and texts without terms
still make their group occur; its p are then all p0. A language without kept terms
gives value 0 for every pair and no term rows. Repeated rows count as documents; ids
are not read. Ties rank by item in UTF-8 order. An empty table gives no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import stored, text_pieces

HELD = 200_000       # entries of a task's counters before they are sent on
TILE = 128           # sources of a tile, about
BLOCK_ROWS = 400_000  # sparse rows of a block of terms, about
CELLS = 1 << 21      # cells of a slice of the matrix
LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ONE = 1_000_000_000


def frequencies(text: bytes) -> Counter:
    """Term -> occurrences in a whole text (UTF-8)."""
    found: Counter = Counter()
    for piece in text_pieces(text.translate(LOWER)):
        found.update(piece.split())
    return found


def group_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): partial sums by task; a group without terms has one row with an empty term."""
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).cast("binary")
    src = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source"),
                      F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"))

    def run(batches):
        import pyarrow as pa

        counts: defaultdict = defaultdict(Counter)
        within: defaultdict = defaultdict(Counter)

        def flush():
            for g, c in counts.items():
                terms = [b"", *c]
                d = within[g]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g[0]] * len(terms), pa.binary()), pa.array([g[1]] * len(terms), pa.binary()), pa.array(terms, pa.binary()),
                     pa.array([0, *c.values()], pa.int64()), pa.array([0, *map(d.__getitem__, c)], pa.int64())],
                    ["lang", "source", "term", "n", "docs"])
            counts.clear()
            within.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(*(b.column(k) for k in range(3)), strict=True):
                g = lang.as_py(), source.as_py()
                own = frequencies(text.as_py())
                held -= len(counts[g])
                counts[g].update(own)
                within[g].update(own.keys())
                held += len(counts[g])
                if held >= HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    return src.mapInArrow(run, "lang binary, source binary, term binary, n long, docs long")


def proportion(count: Column, total: Column) -> Column:
    """1 + floor(10^9 count / total) in 64-bit integers, for 0 <= count <= total: long division, three digits at a time."""
    rest, out = count, F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, total)
        rest = rest % total
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audited(docs: DataFrame, min_docs: int = 10, text_col: str = "text", lang_col: str = "lang",
            source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(terms, groups), both in the shared folder.

    ``terms``: lang, source, term, count, p of the group, q of the language; the kept terms that the group has.
    ``groups``: lang, source, v (kept terms of the language), total, p0 (p of a term that the group lacks), rows, sources.
    """
    raw = group_counts(docs, text_col, lang_col, source_col).repartition("lang", "term")
    by_group = raw.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    by_group = by_group.withColumn("in_docs", F.sum("docs").over(w)).withColumn("lang_n", F.sum("n").over(w))
    # the empty term carries the groups
    kept = stored(by_group.where((F.col("term") == F.lit(b"")) | (F.col("in_docs") >= min_docs))
                  .select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    real = F.col("term") != F.lit(b"")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.when(real, 1)).alias("rows"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("sources"))
    vocabulary = kept.where(real).select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = groups.join(langs, "lang").join(vocabulary, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    size = F.col("total") + 2 * F.col("v")
    groups = stored(groups.withColumn("p0", F.when(F.col("v") > 0, proportion(F.lit(2).cast("long"), F.greatest(size, F.lit(2))))), "groups")
    terms = kept.where(real).join(groups.select("lang", "source", "total", "lang_total", "v"), ["lang", "source"])
    terms = terms.select("lang", "source", "term", F.col("n").alias("count"), proportion(F.col("n") + 2, size).alias("p"),
                         proportion(F.col("lang_n") + 2, F.col("lang_total") + 2 * F.col("v")).alias("q"))
    return stored(terms, "group-terms"), groups


def source_pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value): each source of a language against each other one, over all kept terms."""
    tile = F.pmod(F.xxhash64("source"), F.col("tiles"))
    g = groups.withColumn("tiles", F.greatest(F.ceil(F.col("sources") / TILE), F.lit(1)).cast("long")).withColumn("tile", tile)
    most = g.groupBy("lang", "tile").agg(F.sum("rows").alias("r")).groupBy("lang").agg(
        F.greatest(F.ceil(2 * F.max("r") / BLOCK_ROWS), F.lit(1)).cast("long").alias("blocks"))
    g = g.join(most, "lang").select("lang", "source", "tile", "tiles", "blocks", "p0")
    base = g.where(F.col("p0").isNotNull())
    entries = terms.select("lang", "source", "term", "p").join(base, ["lang", "source"]).withColumn(
        "block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    constants = base.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn(
        "p", F.col("p0")).withColumn("term", F.lit(None).cast("binary"))
    cols = ["lang", "source", "term", "p", "tile", "tiles", "block"]
    both = entries.select(*cols).unionByName(constants.select(*cols))
    both = both.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))).select(
        "lang", F.least("tile", "u").alias("i"), F.greatest("tile", "u").alias("j"), "block", "tile", "source", "term", "p")

    def block_sums(key, t):
        import pyarrow as pa
        import pyarrow.compute as pc

        flat = t.filter(pc.is_null(t["term"]))
        p0 = np.array(flat["p"].to_pylist(), np.int64)
        names, tiles = flat["source"].to_pylist(), np.array(flat["tile"].to_pylist())
        t = t.filter(pc.is_valid(t["term"]))
        first, second = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(tiles == first), np.flatnonzero(tiles == second)
        got = np.zeros((len(left), len(right)), np.int64)
        if t.num_rows:
            at = {s: k for k, s in enumerate(names)}
            coded = t["source"].combine_chunks().dictionary_encode()
            s = np.array([at[x] for x in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
            term = t["term"].combine_chunks().dictionary_encode().indices.to_numpy()
            order = np.argsort(term, kind="stable")
            term, s, p = term[order], s[order], t["p"].to_numpy()[order]
            step = max(1, CELLS // len(names))
            for low in range(0, int(term[-1]) + 1, step):
                a, b = np.searchsorted(term, (low, low + step))
                cells = np.tile(p0, (int(term[b - 1]) + 1 - low, 1))
                cells[term[a:b] - low, s[a:b]] = p[a:b]
                other = np.ascontiguousarray(cells[:, right].T)
                for k, x in enumerate(left):
                    mine = cells[:, x]
                    f = (mine - other) ** 2 // (mine + other)
                    none = (p0[x] - p0[right]) ** 2 // (p0[x] + p0[right])
                    got[k] += f.sum(1) - len(mine) * none
        a, b = np.divmod(np.arange(got.size), max(len(right), 1))
        pick = np.flatnonzero(np.array(names, object)[left[a]] < np.array(names, object)[right[b]]) if first == second else np.arange(got.size)
        a, b = a[pick], b[pick]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(pick), pa.binary()), "source": pa.array([names[left[x]] for x in a], pa.binary()),
                         "other": pa.array([names[right[x]] for x in b], pa.binary()), "d": pa.array(got.ravel()[pick], pa.int64())})

    sums = both.groupBy("lang", "i", "j", "block").applyInArrow(block_sums, "lang binary, source binary, other binary, d long")
    sums = sums.groupBy("lang", "source", "other").agg(F.sum("d").alias("d"))
    sums = sums.unionByName(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "d"))
    x = groups.select("lang", "source", "p0", "v")
    y = groups.select("lang", F.col("source").alias("other"), F.col("p0").alias("q0"))
    # one row for each two sources of a language: the result itself
    every = x.join(y, "lang").where(F.col("source") != F.col("other"))
    f0 = divergence(F.col("p0"), F.col("q0"))
    return every.join(sums, ["lang", "source", "other"], "left").select(
        "lang", "source", "other", F.coalesce(F.col("v") * f0 + F.coalesce("d", F.lit(0)), F.lit(0)).cast("long").alias("value"))


def report(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` ranks all other sources, part ``term`` the ``top`` overused terms."""
    terms, groups = audited(docs, min_docs)
    pair = source_pairs(terms, groups).withColumnRenamed("other", "item")
    over = terms.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int")
    one = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.alias("rank"))
    out = one(pair, "pair").unionByName(one(over, "term").where(F.col("rank") <= top))
    return out.select(*[F.col(c).cast("string").alias(c) if c in ("lang", "source", "item") else F.col(c) for c in out.columns])

"""Language identification by interpolated Kneser-Ney character models, one per language.

A text is its lower-cased runs of letters (with the marks after them), each between two word boundaries; every
letter and every final boundary is predicted from at most ``ORDER - 1`` characters
before it in the run. Counts of n-grams cover every training document: tasks count
distinct words first, then their n-grams, and Spark adds the counts up. An n-gram is
known by a 64-bit hash, so n-grams are told apart at every size; continuation counts,
context totals and discounts are Spark aggregates. The driver gets the shares and
back-off weights of the distinct n-grams, one order after the other: the model grows with
them (12 bytes, and 4 more for each further language), not with the text.

The model is one set of sorted hash arrays for each order: hash of the n-gram, and
beside it the log-probability under every language; a second set holds the weights of
the contexts to back off with. So one binary search serves all languages. The language
is that of the lowest cross-entropy per character. Margins per character times a power of the
number of characters, over a temperature, become probabilities; power, temperature and each
language's usual range of cross-entropies (mean plus 4 deviations; beyond it a text is
rejected) are fitted on all training documents, each measured by a model of the half (by a hash
of the id) that it is not in; tasks add up the losses of all settings. A language of fewer than ``LEAST`` documents
has no range; where all are such, documents are measured by the model that counted them.

Null texts and texts without letters: ``und``, score 0, not accepted. Training rows
with null lang or without letters teach nothing; without any training row every text
is ``und``. Rows may repeat; of languages that tie the first by name is taken. Very long texts are read whole, in pieces. Only the
named columns are read, so others cannot clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import binary_texts, crc_mod, stored, text_pieces, worker_store

ORDER = 4
FLUSH_WORDS = 200_000
KNOWN_WORDS = 400_000
LEAST = 100  # rows of a language that has a usual range, and that makes halves large enough to measure each other
SETTINGS = [(power, float(t)) for power in (0.0, 0.25, 0.5, 0.75, 1.0) for t in np.geomspace(50, 0.02, 41)]


@cache
def not_letters():
    """Runs of what no word holds: all but letters and the marks after them (Unicode categories L and M)."""
    import regex

    return regex.compile(r"(?:[^\p{L}\p{M}\n]|(?<![\p{L}\p{M}])\p{M}+)+")


def ngrams(words: list[bytes], order: int = ORDER):
    """For n = 1 ... order: (word number, n-gram, its context, its suffix, begins with a boundary, place) of each n-gram.

    N-grams are 64-bit hashes; context and suffix are hashes of order n - 1.
    """
    text = "\n" + "\n".join([w.decode("utf-8", "replace") for w in words]).lower() + "\n"
    codes = np.frombuffer(not_letters().sub(" ", text).encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = (codes == 32) | (codes == 10)
    owner = np.cumsum(codes == 10) - 1
    owner[codes == 10] -= 1  # the boundary that ends a word belongs to it
    codes[edge] = 0
    ok = np.ones(len(codes), bool)
    ok[0] = False
    ok[1:] &= ~(edge[1:] & edge[:-1])
    mixed = (codes + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    h, prev, keys_prev = mixed.copy(), None, None
    for n in range(1, order + 1):
        if n > 1:
            h = np.concatenate([[np.uint64(0)], prev[:-1]]) * np.uint64(0x100000001B3) + mixed
            ok = ok.copy()
            ok[: n - 1] = False
            if n > 2:  # letters only between the first and the last
                ok[n - 1:] &= ~edge[1:len(edge) - n + 2]
        keys = (h * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
        at = np.flatnonzero(ok)
        if n == 1:
            yield owner[at], keys[at], np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool), at
        else:
            yield owner[at], keys[at], keys_prev[at - 1], keys_prev[at], edge[at - n + 1], at
        prev, keys_prev = h, keys


def count_ngrams(docs: DataFrame, lang_col: str, id_col: str, text_col: str, order: int = ORDER) -> DataFrame:
    """(lang, n, gram, context, suffix, first, count) over all rows of ``docs``."""
    src = binary_texts(docs, id_col, text_col, [F.col(lang_col).cast("string").alias("lang")]).select("text", "lang")

    def rows(lang, counts):
        import pyarrow as pa

        weight = np.fromiter(counts.values(), np.int64, len(counts))
        for n, (own, gram, context, suffix, first, _) in enumerate(ngrams(list(counts), order), 1):
            if not len(gram):
                continue
            order_by = np.argsort(gram, kind="stable")
            ranked = gram[order_by]
            starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            pick = order_by[starts]
            total = np.add.reduceat(weight[own][order_by], starts)
            size = len(pick)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * size, pa.string()), pa.array(np.full(size, n, np.int32)), pa.array(gram[pick]),
                 pa.array(context[pick]), pa.array(suffix[pick]), pa.array(first[pick]), pa.array(total)],
                ["lang", "n", "gram", "context", "suffix", "first", "count"])

    def run(batches):
        seen: dict[str, Counter] = {}
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                counts = seen.setdefault(lang, Counter())
                for piece in text_pieces(text.as_py()):
                    counts.update(piece.lower().split())
                if len(counts) >= FLUSH_WORDS:
                    yield from rows(lang, seen.pop(lang))
        for lang, counts in seen.items():
            if counts:
                yield from rows(lang, counts)

    part = src.mapInArrow(run, "lang string, n int, gram long, context long, suffix long, first boolean, count long")
    # an n-gram has one context, one suffix and one beginning
    return part.groupBy("lang", "n", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"),
                                                 F.min("first").alias("first"), F.sum("count").alias("count"))


@dataclass
class Model:
    languages: list[str]
    order: int
    grams: dict = field(default_factory=dict)     # n -> (sorted hashes, log-probabilities by language)
    contexts: dict = field(default_factory=dict)  # n -> (sorted hashes of order n - 1, log back-off weights by language)
    floor: float = 0.0
    temperature: float = 1.0
    power: float = 1.0
    limits: np.ndarray | None = None

    def logs(self, words: list[bytes]) -> np.ndarray:
        """(words, languages + 1): summed log-probabilities of each word, and how many characters they cover."""
        out = np.zeros((len(words), len(self.languages) + 1))
        # each character is known by its longest n-gram: deeper orders overwrite or back off
        for n, (own, gram, context, _, _, at) in enumerate(ngrams(words, self.order), 1):
            if n == 1:
                owners, places, best = own, at, np.full((len(own), len(self.languages)), self.floor)
            place = np.searchsorted(places, at)
            found, rows = _find(self.grams[n][0], gram)
            known, weights = _find(self.contexts[n][0], context)
            known &= ~found
            best[place[known]] += self.contexts[n][1][weights[known]]
            best[place[found]] = self.grams[n][1][rows[found]]
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owners, weights=best[:, k], minlength=len(words))
        out[:, -1] = np.bincount(owners, minlength=len(words))
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are among the sorted ``keys``, and where."""
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, at


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, n, gram, context, suffix, share, gamma) of every counted n-gram: its discounted share of its context, and the
    weight with which that context backs off."""
    # how many characters an n-gram follows; one that starts a word follows nothing else
    follows = counts.where("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.col("suffix").alias("gram")).agg(
        F.count(F.lit(1)).alias("follows"))
    value = F.when(F.col("first") | F.col("follows").isNull(), F.col("count")).otherwise(F.col("follows"))
    v = stored(counts.join(follows, ["lang", "n", "gram"], "left").select(
        "lang", "n", "gram", "context", "suffix", value.alias("value")), "langid-values")
    n1, n2 = F.count_if(F.col("value") == 1), F.count_if(F.col("value") == 2)
    discounts = v.groupBy("lang", "n").agg(F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(0.5).alias("discount"))
    totals = v.groupBy("lang", "n", "context").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("kinds"))
    totals = totals.join(F.broadcast(discounts), ["lang", "n"])  # a row for each language and order
    return v.join(totals, ["lang", "n", "context"]).select(
        "lang", "n", "gram", "context", "suffix", ((F.col("value") - F.col("discount")) / F.col("total")).alias("share"),
        (F.col("discount") * F.col("kinds") / F.col("total")).alias("gamma"))


def _estimate(counts: DataFrame, order: int, languages: list[str]) -> Model:
    """Interpolated Kneser-Ney from the summed counts."""
    shares = stored(kneser_ney(counts), "langid-shares")
    lang = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1
    model, L = Model(languages, order), len(languages)
    for n in range(1, order + 1):
        got = shares.where(F.col("n") == n).select(lang.cast("int").alias("lang"), "gram", "context", "suffix", "share", "gamma").toArrow()
        lg, gram, context, suffix, share, gamma = (got.column(c).to_numpy() for c in got.column_names)
        keys, at, where = np.unique(gram, return_index=True, return_inverse=True)
        ckeys, cwhere = np.unique(context[at], return_inverse=True)
        weights = np.ones((len(ckeys), L))  # a context that a language does not have leaves all to the order below
        weights[cwhere[where], lg] = gamma
        if n == 1:
            alphabet = len(keys) + 1
            model.floor = -float(np.log(alphabet))
            base = np.full((len(keys), L), 1.0 / alphabet)  # order 0: uniform
        else:
            base = probs[np.searchsorted(lower, suffix[at])]  # every suffix is an n-gram of the order below
        probs = weights[cwhere] * base
        probs[where, lg] += share
        lower = keys
        # an n-gram that no language has is backed off from the order below, all the way to uniform
        model.grams[n] = keys, np.log(probs).astype(np.float32)
        model.contexts[n] = ckeys, np.log(np.maximum(weights, 1e-9)).astype(np.float32)
    return model


class WordTable(dict):
    """word -> row number; the rows of words new in a group of texts are worked out together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new = model, []
        self.rows = np.zeros((1024, len(model.languages) + 1))

    def __missing__(self, word):
        k = self[word] = len(self)
        self.new.append(word)
        return k

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages + 1): summed log-probabilities, and the number of characters they cover."""
        if len(self) > KNOWN_WORDS:
            self.clear()
        parts, owner = [], []
        for k, text in enumerate(texts):
            for piece in text_pieces(text):
                words = piece.lower().split()
                parts.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
                owner.append(k)
        if self.new:
            if len(self) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((len(self), self.rows.shape[1]))])
            for at in range(0, len(self.new), 20_000):
                part = self.new[at:at + 20_000]
                first = len(self) - len(self.new) + at
                self.rows[first:first + len(part)] = self.model.logs(part)
            self.new = []
        out = np.zeros((len(texts), self.rows.shape[1]))
        for k, ids in zip(owner, parts, strict=True):
            out[k] += self.rows[ids].sum(axis=0)
        return out


def measured(docs: DataFrame, model: Model, id_col: str, text_col: str, extra: tuple | list = ()) -> DataFrame:
    """(id, n_chars_scored, best, entropy, margins, *extra): cross-entropies per character, best first language's."""
    src = binary_texts(docs, id_col, text_col, extra)
    kinds = [(f.name, f.dataType.simpleString()) for f in src.schema if f.name != "text"]
    kinds[1:1] = [("scored", "long"), ("best", "int"), ("entropies", "array<double>")]
    key = "langid-" + str(zlib.crc32(b"".join(v.tobytes() for k, v in model.grams.values())))

    def run(batches):
        import pyarrow as pa

        store = worker_store(key)
        if "words" not in store:
            store["words"] = WordTable(model)
        words = store["words"]
        for b in batches:
            sums, held, size = [np.zeros((0, len(model.languages) + 1))], [], 0
            for t in b.column(1):
                held.append(t.as_py())
                size += len(held[-1])
                if size >= 1 << 20:
                    sums.append(words.totals(held))
                    held, size = [], 0
            sums = np.concatenate([*sums, words.totals(held)])
            n = sums[:, -1]
            h = -sums[:, :-1] / np.maximum(n, 1)[:, None]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n.astype(np.int64)), pa.array(h.argmin(axis=1).astype(np.int32)),
                 pa.array(list(h), pa.list_(pa.float64())), *b.columns[2:]], [k for k, _ in kinds])

    return src.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kinds))


def _halves(rows: DataFrame, id_col: str, text_col: str, lang_col: str, order: int) -> DataFrame:
    """``count_ngrams`` of the two halves of the rows, with ``half``; one reading."""
    half = F.pmod(F.xxhash64(F.lit("calibration"), F.col(id_col)), F.lit(2)).cast("string")
    counts = count_ngrams(rows.withColumn(lang_col, F.concat(half, F.col(lang_col).cast("string"))), lang_col, id_col, text_col, order)
    return stored(counts.withColumn("half", F.substring("lang", 1, 1).cast("int")).withColumn("lang", F.expr("substring(lang, 2)")), "langid-counts")


def calibration(m: DataFrame, languages: list[str], known: list[str]) -> DataFrame:
    """(k, v): what the ``measured`` rows (with ``_lang``) of languages the model knows add up to: the losses of ``SETTINGS``, then of each
    language the rows, cross-entropies and their squares."""
    width, size, first = len(languages), len(SETTINGS), {x: k for k, x in enumerate(languages)}

    def run(batches):
        import pyarrow as pa

        total = np.zeros(size + 3 * width)
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column(0).to_numpy().astype(float)
            h = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            true = np.array([first[x] for x in b.column(2).to_pylist()])
            own = h[np.arange(len(h)), true]
            for at, (power, t) in enumerate(SETTINGS):
                d = (own[:, None] - h) * (n ** power / t)[:, None]
                top = d.max(axis=1)
                loss = top + np.log(np.exp(d - top[:, None]).sum(axis=1))
                total[at] += np.minimum(loss, -np.log(1e-6)).sum()
            for k, w in enumerate((np.ones(len(own)), own, own * own)):
                total[size + k * width:size + (k + 1) * width] += np.bincount(true, weights=w, minlength=width)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

    rows = m.where((F.col("scored") > 0) & F.col("_lang").isin(known)).select("scored", "entropies", "_lang")
    return rows.mapInArrow(run, "k int, v double")


def train(docs: DataFrame, where: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          order: int = ORDER) -> Model | None:
    """The model of all rows where ``where`` holds and the language is known; None if there are none."""
    rows = docs.where(where & F.col(lang_col).isNotNull())
    halves = _halves(rows, id_col, text_col, lang_col, order)
    known: dict = {0: [], 1: []}
    for r in halves.select("half", "lang").distinct().collect():  # a row for each language
        known[r["half"]].append(r["lang"])
    languages = sorted({*known[0], *known[1]})
    if not languages:
        return None
    lang = F.col(lang_col).cast("string")
    per = {r["lang"]: r["count"] for r in rows.groupBy(lang.alias("lang")).count().collect()}
    fitted = [(rows, None)]
    if max(per[x] for x in languages) >= LEAST:
        half = F.pmod(F.xxhash64(F.lit("calibration"), F.col(id_col)), F.lit(2))
        fitted = [(rows.where(half == k), 1 - k) for k in (0, 1)]
    whole = halves.groupBy("lang", "n", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"),
                                                    F.min("first").alias("first"), F.sum("count").alias("count"))
    model, sums = None, np.zeros(len(SETTINGS) + 3 * len(languages))
    for part, other in fitted:
        if other is None:
            by = model = _estimate(stored(whole, "langid-whole"), order, languages)
        else:
            by = _estimate(halves.where(F.col("half") == other).drop("half"), order, languages)
        m = measured(part, by, id_col, text_col, [lang.alias("_lang")])
        for r in calibration(m, languages, languages if other is None else known[other]).groupBy("k").agg(F.sum("v").alias("v")).collect():
            sums[r["k"]] += r["v"]
    if model is None:
        model = _estimate(stored(whole, "langid-whole"), order, languages)
    n, total, squares = sums[len(SETTINGS):].reshape(3, -1)
    least = np.inf
    for loss, (power, t) in zip(sums[:len(SETTINGS)] / max(n.sum(), 1), SETTINGS, strict=True):
        if n.sum() and loss < least - 1e-4:  # of settings that do equally well the one with the more cautious probabilities
            least, model.temperature, model.power = loss, t, power
    mean = total / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(n, 1) - mean * mean, 0))
    enough = (n > 0) & np.array([fitted[0][1] is None or per[x] >= LEAST for x in languages])
    model.limits = np.where(enough, mean + 4 * spread + 0.25, np.inf)
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted, entropy), one row per document row."""
    if model is None:
        return docs.select(F.col(id_col).alias("id"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(False).alias("accepted"), F.lit(None).cast("double").alias("entropy"))
    m = measured(docs, model, id_col, text_col)
    names = F.array(*[F.lit(x) for x in model.languages])
    limits = F.array(*[F.lit(float(x)) for x in model.limits])
    at = F.col("best") + 1
    low = F.element_at("entropies", at)
    spread = F.aggregate("entropies", F.lit(0.0), lambda s, x: s + F.exp(
        (low - x) * F.pow(F.col("scored").cast("double"), F.lit(model.power)) / F.lit(model.temperature)))
    known = F.col("scored") > 0
    return m.select("id", F.when(known, F.element_at(names, at)).otherwise("und").alias("lang_pred"),
                    F.when(known, 1.0 / spread).otherwise(0.0).alias("score"),
                    (known & (low <= F.element_at(limits, at))).alias("accepted"), F.when(known, low).alias("entropy"))


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted): learnt from the rows whose id's checksum modulo 5 is not 0."""
    model = train(docs, crc_mod(id_col, 5) != 0, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(
        F.col("id").alias(id_col), (crc_mod("id", 5) == 0).alias("held_out"), "lang_pred", "score", "accepted")

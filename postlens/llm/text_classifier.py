"""What the two positive-unlabelled text classifiers share: features of whole texts, bounded fit, scoring.

Features are present or absent: each distinct word (lower-cased, outer punctuation
off), its prefixes, and binned measures of style (shares of capitals, symbols,
digits, blanks; repeated words; most frequent word; word length). Words hash into
``FEATURES`` numbers; a text is read in pieces, whole.

Fit: at most ``MAX_POSITIVE`` confirmed positives and ``MAX_UNLABELLED`` documents
(those with the smallest hash of the id), so the driver holds a bounded sample
whatever the corpus size; weights are numpy arrays. Scoring reads every document
once, inside Arrow batches, without a shuffle.

Features hash into ``FEATURES`` numbers, so rare words may share one, and at most ``SELECTED`` of them are kept:
those that the bounded sample tells apart best. Null, empty and blank texts score as texts without words. Rows
that repeat an id are one row of the sample and are scored one by one; null ids and null
labels teach nothing and are scored. Ties in the sample's hash go to the smaller id. Very long texts are read whole, in
pieces. Without positives or without documents (an empty table) every text scores a quarter. Only the named id,
text and label columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm import pu
from postlens.llm.common import Memo, binary_texts, lean, word_pieces, worker_store

FEATURES = 1 << 20
STYLE = 4096  # the first numbers are those of style
MAX_POSITIVE, MAX_UNLABELLED = 5000, 10000
SELECTED = 20000
PREFIXES = (4, 5, 6)
OUTER = b".,;:!?\"'()[]{}|*#$%&"


def word_features(word: bytes) -> tuple[int, ...]:
    """Numbers of a word and of its prefixes (in characters)."""
    w = word.strip(OUTER)
    if not w:
        return ()
    text = w.decode("utf-8", "replace")
    names = {b"w" + w} | {b"p" + text[:k].encode() for k in PREFIXES if len(text) > k}
    return tuple(STYLE + zlib.crc32(x) % (FEATURES - STYLE) for x in names)


RATIO_BINS = np.array([0.0, 0.001, 0.003, 0.01, 0.02, 0.04, 0.08, 0.15, 0.25, 0.4, 0.6, 0.8])
SYMBOLS = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-"])


def text_words(text: bytes) -> tuple[Counter, int, int]:
    """Counts of the words of a whole text, their number, and how many repeat the word before."""
    counts, n, same, last = Counter(), 0, 0, []
    for words in word_pieces(text):
        counts.update(words)
        n += len(words)
        words = last + words
        same += sum(map(eq, words, words[1:]))
        last = words[-1:]
    return counts, n, same


def style_features(text: bytes, counts: Counter, n: int, same: int) -> list[int]:
    size = max(len(text), 1)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    short = 0 if n < 8 else 1 if n < 32 else 2
    shares = (hist[65:91].sum() / size, hist[SYMBOLS].sum() / size, hist[48:58].sum() / size, hist[10] / size,
              hist[124] / size, hist[33] / size, same / max(n, 1), max(counts.values(), default=0) / max(n, 1),
              len(counts) / max(n, 1))
    out = []
    for k, x in enumerate(shares):
        out.append((k * 3 + short) * 16 + int(np.searchsorted(RATIO_BINS, x, "right")))
    out.append(600 + min(int(2 * size / max(n, 1)), 60))
    return out if n else [700]


@dataclass
class Model:
    new: np.ndarray      # feature number -> weight number or -1
    weights: np.ndarray  # the last is the bias
    prior: float

    def table(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Sorted numbers of the features in use, their weights, the bias."""
        used = np.flatnonzero(self.new >= 0)
        return used, self.weights[self.new[used]], float(self.weights[-1])


def _feature_rows(sample: DataFrame) -> tuple[pu.Rows, pu.Rows]:
    """Rows of the sample (text, positive, unlabelled) as feature sets on the driver: a bounded sample."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for t in b.column(0):
                text = t.as_py()
                counts, n, same = text_words(text)
                ids = set(style_features(text, counts, n, same))
                for w in counts:
                    ids.update(word_features(w))
                out.append(np.array(sorted(ids), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(out, pa.binary())],
                                             ["positive", "unlabelled", "ids"])

    got = sample.mapInArrow(lean(run), "positive boolean, unlabelled boolean, ids binary").toArrow()
    ids = [np.frombuffer(x, "<i4") for x in got.column("ids").to_pylist()]
    pos, unl = got.column("positive").to_pylist(), got.column("unlabelled").to_pylist()
    return (pu.Rows.of([x for x, y in zip(ids, pos, strict=True) if y]),
            pu.Rows.of([x for x, y in zip(ids, unl, strict=True) if y]))


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, id_col: str = "doc_id", text_col: str = "text",
        max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, strength_over: float = 3.0,
        style_always: bool = False, **optimiser) -> Model:
    """Positive-unlabelled fit on the rows where ``train`` (an expression over the id) holds.

    Positives: labelled 1, at most ``max_positive``. Unlabelled: documents whatever
    their label, at most ``max_unlabelled``. Null ids and null labels are left out.
    ``strength_over`` and ``style_always`` choose the features (``pu.informative``),
    ``optimiser`` goes to ``pu.fit``.
    """
    order = F.xxhash64("_id")
    own = F.col(id_col).alias("_id")
    pos = (labels.where(train & (F.col(label) == 1) & F.col(id_col).isNotNull()).select(own).distinct()
           .orderBy(order, "_id").limit(max_positive).withColumn("positive", F.lit(True)))
    unl = (docs.where(train & F.col(id_col).isNotNull()).select(own).distinct()
           .orderBy(order, "_id").limit(max_unlabelled).withColumn("unlabelled", F.lit(True)))
    chosen = pos.join(unl, "_id", "full_outer").withColumnRenamed("_id", "_chosen")
    texts = binary_texts(docs, id_col, text_col).join(F.broadcast(chosen), F.col("id") == F.col("_chosen"))
    p, u = _feature_rows(texts.select("text", F.coalesce("positive", F.lit(False)).alias("positive"),
                                      F.coalesce("unlabelled", F.lit(False)).alias("unlabelled")))
    if not len(p) or not len(u):  # nothing confirmed: every text scores a quarter, below either threshold
        return Model(np.full(FEATURES, -1, np.int64), np.log(np.ones(1) / 3), 0.25)
    new = pu.informative(p, u, FEATURES, SELECTED, strength_over=strength_over, always=STYLE if style_always else 0)
    p, u, size = p.renumbered(new), u.renumbered(new), int(new.max()) + 1
    prior = pu.estimate_prior(p, u, size)
    return Model(new, pu.fit(p, u, size, prior, **optimiser), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", extra: tuple | list = (),
          keep_text: str | None = None) -> DataFrame:
    """(id, score, *extra) of every whole text; null and empty texts are scored as having no words.

    ``keep_text`` names a column for the text itself, which then travels once.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *extra)
    used, weights, bias = model.table()
    kinds = [(f.name, f.dataType.simpleString()) for f in src.schema if f.name != "text"]
    kinds[1:1] = [("score", "double")] + ([(keep_text, "string")] if keep_text else [])
    key = f"text-classifier-{zlib.crc32(used.tobytes() + weights.tobytes()):08x}"

    def run(batches):
        import pyarrow as pa

        weight = dict(zip(used.tolist(), weights.tolist(), strict=True))
        cache = worker_store(key).setdefault("words", Memo(lambda w: tuple(i for i in word_features(w) if i in weight)))
        for b in batches:
            out = np.empty(b.num_rows)
            for k, t in enumerate(b.column(1)):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                counts, n, same = text_words(text)
                ids = {i for i in style_features(text, counts, n, same) if i in weight}
                ids.update(*filter(None, map(cache.__getitem__, counts)))
                out[k] = bias + sum(map(weight.__getitem__, sorted(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pu.sigmoid(out)), *b.columns[1 if keep_text else 2:]], [k for k, _ in kinds])

    return src.mapInArrow(lean(run, key), ", ".join(f"`{k}` {t}" for k, t in kinds))

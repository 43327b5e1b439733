"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

Tokens: lower-cased (A-Z) words ``[^\\x20\\x09-\\x0D]+`` and one end per text.

Counts of all training tokens are a Spark aggregate (c, N, V). The ``WORDS`` most
frequent tokens are classes of their own; every other word belongs to one of
``RARE`` classes by a checksum of its first and last two bytes. A token's probability
is that of its class given the two tokens before, times that of the word in its class:
absolute discounting over the class's known words, with the discounted mass spread
over the estimated number of its unseen words (Chao's estimate). So the
probabilities of all words, seen or not, add up to one.

The classes' model: each class has a context vector and a target vector; the
prediction is the sum of the two context vectors weighted by position, its product
with a target vector plus a bias is the class's score. It is fitted in numpy by
noise-contrastive estimation: a warm-up on a bounded sample (``WARM_UP`` texts), then
every task trains on all texts of its partition, and the tasks' weights are averaged in
blocks by Spark, so training reads the whole corpus and the driver gets one model.
Scoring normalises with batched matrix products over all classes, once per distinct
context and worker.

Workers know the counts of the ``HOT`` most frequent words; the others (a few per cent of
the tokens) are joined to the count table by Spark, so counts are exact for all words.

Null and empty texts are a single end token. Repeated rows are scored one by one; null
ids count as training rows (checksum of the empty text). Without training rows N and V are
0 and every token is unseen. Only the id and text columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlens.llm.common import Memo, binary_texts, crc_mod, lean, stored, word_pieces, worker_store

WORDS, RARE = 1792, 256
CLASSES = WORDS + RARE
DIM = 24
NOISE = 64
BATCH = 4096
WARM_UP, WARM_EPOCHS = 3000, 3
HOT = 200_000
FLUSH = 200_000
KEPT = 50_000  # words whose class a worker keeps at hand
BLOCKS = 32
END = b"\n"  # no word holds white space


def rare_class(word: bytes) -> int:
    return WORDS + zlib.crc32(word[:2] + word[-2:]) % RARE


def rare_class_column(word: Column) -> Column:
    """The same for a binary column, counted from 0 within the rare classes."""
    return (F.crc32(F.concat(F.substring(word, 1, 2), F.substring(word, -2, 2))) % RARE).cast("int")


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, c) over all ``texts(text)``: tasks count first, Spark adds up."""

    def run(batches):
        import pyarrow as pa

        def rows(counts):
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              ["word", "c"])

        counts = Counter()
        for b in batches:
            counts[END] += b.num_rows
            for t in b.column(0):
                for words in word_pieces(t.as_py()):
                    counts.update(words)
                if len(counts) >= FLUSH:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return texts.select("text").mapInArrow(lean(run), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Counts:
    table: DataFrame      # word, c
    tokens: int           # N
    types: int            # V
    hot: dict             # the most frequent words -> c
    classes: np.ndarray   # c of each class
    discount: float
    unseen: np.ndarray    # log10 probability of one unseen word in its rare class

    def rank(self) -> dict:
        """word -> class, for the words that are classes of their own."""
        return {w: k for k, w in enumerate(list(self.hot)[:WORDS])}


def gather(texts: DataFrame, hot: int = HOT) -> Counts:
    table = stored(count_tokens(texts), "token-counts")
    total = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = table.orderBy(F.desc("c"), "word").limit(hot).toArrow()  # a bounded list
    words = dict(zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True))
    if total[0]:  # the end is always a class of its own, the first
        words = {END: words[END] if END in words else table.where(F.col("word") == F.lit(END)).first()["c"], **words}
    names = list(words)[:WORDS]
    frequent = table.sparkSession.createDataFrame([(bytearray(w),) for w in names] or [(bytearray(b" "),)], "top binary")
    rare = table.join(F.broadcast(frequent), F.col("word") == F.col("top"), "left_anti")
    per = rare.groupBy(rare_class_column(F.col("word")).alias("r")).agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("types"), F.count_if(F.col("c") == 1).alias("n1"),
        F.count_if(F.col("c") == 2).alias("n2")).toArrow().to_pylist()
    n1, n2 = sum(p["n1"] for p in per), sum(p["n2"] for p in per)
    d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    classes = np.zeros(CLASSES)
    classes[:len(names)] = [words[w] for w in names]
    unseen = np.zeros(RARE)
    for p in per:
        classes[WORDS + p["r"]] = p["c"]
        missing = max(p["n1"] * (p["n1"] - 1) / (2.0 * (p["n2"] + 1)), 1.0)
        unseen[p["r"]] = np.log10(d * p["types"] / p["c"] / missing)
    return Counts(table, int(total[0]), int(total[1]), words, classes, d, unseen)


class Model:
    """Context vectors r, target vectors q, biases, weights of the two positions."""

    def __init__(self, r, q, bias, place):
        self.r, self.q, self.bias, self.place = r, q, bias, place

    @classmethod
    def start(cls, classes: np.ndarray) -> Model:
        rng = np.random.default_rng(7)
        p = (classes + 0.5) / (classes + 0.5).sum()
        return cls(rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32), rng.normal(0, 0.1, (CLASSES, DIM)).astype(np.float32),
                   np.log(p).astype(np.float32), np.full((2, DIM), 0.7, np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.r, self.q, self.bias, self.place)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Model:
        a, b = CLASSES * DIM, 2 * CLASSES * DIM
        return cls(flat[:a].reshape(CLASSES, DIM).copy(), flat[a:b].reshape(CLASSES, DIM).copy(),
                   flat[b:b + CLASSES].copy(), flat[b + CLASSES:].reshape(2, DIM).copy())

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.r[one] * self.place[0] + self.r[two] * self.place[1]

    def log_norms(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Natural log of the sum over all classes, for each context."""
        out = np.empty(len(one), np.float32)
        for at in range(0, len(one), 1024):
            s = self.predicted(one[at:at + 1024], two[at:at + 1024]) @ self.q.T
            s += self.bias
            top = s.max()
            s -= top
            np.exp(s, out=s)
            out[at:at + 1024] = np.log(s.sum(axis=1)) + top
        return out

    def raw(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", self.predicted(one, two), self.q[target]) + self.bias[target]


class Trainer:
    """Noise-contrastive estimation with noise shared by a batch, Adagrad steps."""

    def __init__(self, model: Model, classes: np.ndarray, rate: float, seed: int):
        self.m, self.rate, self.rng = model, rate, np.random.default_rng(seed)
        p = (classes + 0.5) / (classes + 0.5).sum()
        self.cum, self.log_noise = np.cumsum(p), (np.log(p) + np.log(NOISE)).astype(np.float32)
        self.sq = [np.full_like(x, 1e-2) for x in (model.r, model.q, model.bias, model.place)]

    @staticmethod
    def _scatter(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        into[rows[starts]] += np.add.reduceat(values[order], starts, axis=0)

    def step(self, one: np.ndarray, two: np.ndarray, target: np.ndarray) -> None:
        m, n = self.m, np.float32(len(target))
        noise = np.minimum(np.searchsorted(self.cum, self.rng.random(NOISE)), CLASSES - 1)
        x1, x2, qt, qn = m.r[one], m.r[two], m.q[target], m.q[noise]
        h = x1 * m.place[0] + x2 * m.place[1]
        pos = np.einsum("ij,ij->i", h, qt) + m.bias[target] - self.log_noise[target]
        neg = h @ qn.T
        neg += m.bias[noise] - self.log_noise[noise]
        dpos = (1 / (1 + np.exp(-pos)) - 1)[:, None]
        np.negative(neg, out=neg)
        np.exp(np.minimum(neg, 60, out=neg), out=neg)
        dneg = 1 / (1 + neg)
        dh = dpos * qt + dneg @ qn
        gr, gq, gb = np.zeros_like(m.r), np.zeros_like(m.q), np.zeros_like(m.bias)
        self._scatter(gr, one, dh * m.place[0])
        self._scatter(gr, two, dh * m.place[1])
        self._scatter(gq, target, dpos * h)
        np.add.at(gq, noise, dneg.T @ h)
        gb += np.bincount(target, weights=dpos[:, 0], minlength=CLASSES)
        np.add.at(gb, noise, dneg.sum(axis=0))
        gp = np.stack([np.einsum("ij,ij->j", dh, x1), np.einsum("ij,ij->j", dh, x2)])
        for x, g, s in zip((m.r, m.q, m.bias, m.place), (gr, gq, gb, gp), self.sq, strict=True):
            g /= n
            g *= 100.0  # keeps rare rows above the start value of the squares
            s += g * g
            x -= self.rate * g / np.sqrt(s)


class ClassMap:
    """Classes of the tokens of texts; the rare ones' checksums are kept while in use."""

    def __init__(self, rank: dict):
        self.known = Memo(lambda w: rank[w] if w in rank else rare_class(w), KEPT)
        self.end = rank.get(END, 0)

    def classes(self, text: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.known.__getitem__, words), np.int16, len(words)) for words in word_pieces(text)]
        return np.concatenate([*parts, np.array([self.end], np.int16)])


def contexts(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two before each token; a text begins after ends."""
    padded = np.concatenate([np.array([end, end], ids.dtype), ids])
    return padded[1:-1], padded[:-2]


def fit(texts: DataFrame, counts: Counts) -> Model:
    """Warm-up on a bounded sample, then one pass of all tasks over all texts and the mean of their weights."""
    rank, classes = counts.rank(), counts.classes
    start = Model.start(classes).flat()

    def trainer(weights, rate, epochs, spread):
        def run(batches):
            import pyarrow as pa
            from pyspark import TaskContext

            model = Model.of(weights)
            t = Trainer(model, classes, rate, TaskContext.get().partitionId())
            cmap, seen, held, size, order = ClassMap(rank), 0, [], 0, np.random.default_rng(1)

            def learn():
                nonlocal held, size, seen
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]  # 16-bit classes sort by radix
                for _ in range(epochs):
                    mix = order.permutation(size)
                    for at in range(0, size, BATCH):
                        t.step(*(c[mix[at:at + BATCH]] for c in cols))
                seen, held, size = seen + size, [], 0

            for b in batches:
                for x in b.column(0):
                    ids = cmap.classes(x.as_py())
                    held.append((*contexts(ids, cmap.end), ids))
                    size += len(ids)
                    if size >= 1 << 18:
                        learn()
            if size:
                learn()
            flat = model.flat().astype(np.float64) * seen
            parts = np.array_split(flat, BLOCKS if spread else 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([seen] * len(parts), pa.int64()),
                 pa.array([p.tobytes() for p in parts], pa.binary())], ["block", "tokens", "weights"])

        return lean(run)

    def add_up(batches):
        import pyarrow as pa

        sums: dict = {}
        for b in batches:
            for block, tokens, w in zip(*(c.to_pylist() for c in b.columns), strict=True):
                old = sums.get(block, (0, 0.0))
                sums[block] = old[0] + tokens, old[1] + np.frombuffer(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(sums, pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()),
             pa.array([np.asarray(s[1], np.float64).tobytes() for s in sums.values()], pa.binary())], ["block", "tokens", "weights"])

    def mean(df) -> np.ndarray | None:
        rows = sorted(df.toArrow().to_pylist(), key=lambda r: r["block"])
        if not rows or not rows[0]["tokens"]:
            return None
        return np.concatenate([np.frombuffer(r["weights"]) / r["tokens"] for r in rows]).astype(np.float32)

    kind = "block int, tokens long, weights binary"
    # ids first: every task offers WARM_UP numbers, not texts; rows that repeat an id are cut off at the end
    chosen = texts.select(F.col("id").alias("_chosen")).distinct().orderBy(F.xxhash64("_chosen"), "_chosen").limit(WARM_UP)
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("_chosen"), "left_semi").select("text").limit(WARM_UP).coalesce(1)
    warm = mean(sample.mapInArrow(trainer(start, 0.1, WARM_EPOCHS, False), kind))
    base = start if warm is None else warm
    parts = texts.select("text").mapInArrow(trainer(base, 0.03, 1, True), kind)
    full = mean(parts.repartition(BLOCKS, "block").mapInArrow(add_up, kind))
    return Model.of(base if full is None else full)


def score(docs: DataFrame, counts: Counts, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score), one row per document row."""
    n, v, d = counts.tokens, counts.types, counts.discount
    hot, rank, classes, unseen = counts.hot, counts.rank(), counts.classes, counts.unseen
    src = binary_texts(docs, id_col, text_col)
    id_type = src.schema["id"].dataType.simpleString()
    per_base = float(np.log10(n + v + 1)) if n else 0.0
    store_key = f"lbl-{zlib.crc32(model.flat().tobytes()):08x}"
    # number of a word: a class of its own or a hot rare word, in the order of ``hot``; the end, which holds the line break, apart
    names = [w for w in hot if w != END]
    if END in hot:
        names.insert(list(hot).index(END), b"")
    joined, some = b"\n".join(names), bool(names)
    cls = np.array([rank[w] if w in rank else rare_class(w) for w in hot] or [0], np.int32)
    base = np.log10(np.array(list(hot.values()) or [0], np.float64) + 1)
    inside = np.array([0.0 if w in rank else np.log10((c - d) / classes[rare_class(w)]) for w, c in hot.items()] or [0.0])

    def run(batches):
        import pyarrow as pa

        store = worker_store(store_key)
        if not store:
            number = {w or END: k for k, w in enumerate(joined.split(b"\n"))} if some else {}
            # a word of unknown count is its rare class, negative
            store.update(known=Memo(lambda w: number[w] if w in number else WORDS - 1 - rare_class(w), KEPT), end=number.get(END, -1),
                         norms=np.full(CLASSES * CLASSES, np.nan, np.float32))
        known, norms = store["known"], store["norms"]
        end = rank.get(END, 0)

        def group(texts):
            """Sizes, known tokens, base sums, log-probabilities and tails of some texts, worked out together."""
            nums, tails, sizes = [], [], []
            for t in texts:
                n, tail = 0, Counter()
                for words in word_pieces(t):
                    num = np.fromiter(map(known.__getitem__, words), np.int32, len(words))
                    nums.append(num)
                    n += len(words)
                    away = np.flatnonzero(num < 0)
                    if len(away):
                        tail.update([words[k] for k in away])
                nums.append(np.array([store["end"]], np.int32))
                tails.append([{"w": w, "k": k} for w, k in tail.items()])
                sizes.append(n + 1)
            num, sizes = np.concatenate(nums), np.array(sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            is_hot = num >= 0
            at = np.where(is_hot, num, 0)
            ids = np.where(is_hot, cls[at], WORDS - 1 - num)
            ids[starts + sizes - 1] = end
            one, two = contexts(ids, end)  # a text begins after ends
            two[starts] = end
            key = one * CLASSES + two
            norm = norms[key]
            missing = np.isnan(norm)
            if missing.any():
                new = np.unique(key[missing])
                norms[new] = model.log_norms(new // CLASSES, new % CLASSES)
                norm = norms[key]
            logs = np.concatenate([model.raw(one[k:k + 8192], two[k:k + 8192], ids[k:k + 8192]) for k in range(0, len(ids), 8192)])
            logs = (logs - norm) / np.float32(np.log(10)) + np.where(is_hot, inside[at], 0.0)
            total = lambda x: np.add.reduceat(x, starts)
            return sizes, total(is_hot.astype(np.int64)), total(np.where(is_hot, base[at], 0.0)), total(logs.astype(np.float64)), tails

        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            held, size = [], 0
            for k, t in enumerate(b.column(1)):
                held.append(t.as_py())
                size += len(held[-1])
                if size >= 1 << 19 or k == b.num_rows - 1:
                    for col, x in zip(cols, group(held), strict=True):
                        col.extend(x)
                    held, size = [], 0
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("w", pa.binary()), ("k", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             ["id", "n_tokens", "hits", "base", "logs", "tail"])

    kind = f"id {id_type}, n_tokens long, hits long, base double, logs double, tail array<struct<w: binary, k: bigint>>"
    part = src.mapInArrow(lean(run, store_key), kind).withColumn("row", F.monotonically_increasing_id())
    part = stored(part, "scored-texts")
    tail = part.select("row", F.explode("tail").alias("t")).select("row", F.col("t.w").alias("w"), F.col("t.k").alias("k"))
    joined = tail.join(counts.table, F.col("w") == F.col("word"), "left")
    r = rare_class_column(F.col("w"))
    mass = F.element_at(F.array(*[F.lit(float(x)) for x in classes[WORDS:]]), r + 1)
    none = F.element_at(F.array(*[F.lit(float(x)) for x in unseen]), r + 1)
    inner = F.when(F.col("c").isNull(), none).otherwise(F.log10((F.col("c") - F.lit(d)) / mass))
    sums = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("tail_hits"),
        F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("tail_base"),
        F.sum(F.col("k") * inner).alias("tail_logs"))
    zero = F.lit(0.0)
    return part.drop("tail").join(sums, "row", "left").select(
        "id", "n_tokens", (F.col("hits") + F.coalesce("tail_hits", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("tail_base", zero) - F.col("n_tokens") * F.lit(per_base)).alias("base_score"),
        (F.col("logs") + F.coalesce("tail_logs", zero)).alias("score"))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): learnt from ids whose checksum modulo 7 is not 2."""
    train = binary_texts(docs.where(crc_mod(id_col, 7) != 2), id_col, text_col)
    counts = gather(train)
    s = score(docs, counts, fit(train, counts), id_col, text_col)
    return s.select(F.col("id").alias(id_col), (crc_mod("id", 7) == 2).alias("held_out"), "n_tokens", "n_known",
                    F.lit(counts.tokens).cast("long").alias("train_tokens"), "base_score", "score")

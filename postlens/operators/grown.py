"""Random forests grown by Spark tasks: large nodes from summed histograms, small ones where their rows are dealt to.

Spark's own forest grows every tree level by level through the driver, which is slow once the trees have many leaves.
Here features become bins (``BINS``, as Spark's ``maxBins``) and rows of equal bins become one cell with its numbers of rows of each
class, so the work is in proportion to the cells, which are no more than the rows or ``BINS ** features``. Every tree draws how often a
cell's rows of a class are in its bootstrap as a Poisson count whose mean is their number: the sum of a Poisson count for each row.
A node with more than ``ROWS`` rows is split from histograms that tasks leave and Spark adds up, a pass for each level; rows
of a smaller node are dealt by (tree, node) and one task grows what is below it, down to pure leaves or the depth limit. Rows to be
scored are dealt the same way, so no forest is ever read into one place. Gini gain, ceil(sqrt(features)) features drawn for each
node, a split only where the gain is positive and both sides keep the leaf size: Spark's rules.

A task holds a cell as the bins of its features, five bits each, and one number for (rows, class 1).
Cells of a node lie side by side. Nodes of a few cells try every cell's bin as the cut, others add up a histogram of the drawn
features; both give the same split. Forests that differ only in leaf size share the draws, the nodes above and the dealt rows.
What a task leaves of the rows to be scored is packed by (block of rows, tree) and added up block by block.

All draws are hashes of the seed, the tree and the cell's bins or the node's place, so neither ``ROWS`` nor the order or partitions of
the rows change the forest. Training rows without a label or with a missing or infinite
feature are refused, as by Spark's forest; missing values of rows to be scored go right. Repeated rows are rows of their own.
A node of equal rows is not split or dealt, however large.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlens.operators.forests import Forest, Variant
from postlens.session import stored

BINS = 32
WORD = 12          # features of five bits in a word
ROWS = 1_000_000   # a node with more bootstrap rows is split by all tasks together
OPEN = 20_000      # such nodes in one pass
NODES = 512        # nodes looked at together below a dealt node
SMALL = (2, 4, 8)  # nodes of at most so many rows try every row's bin
ONE = 2.0**26      # a row of class 1 counts as 1 + ONE
FLUSH = 1 << 24    # bytes of dealt rows a task holds
BLOCK = 12         # rows to be scored are added up 2 ** BLOCK at a time
PART = 8           # Poisson counts are drawn for means of at most 2 ** PART

def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seeded(numbers: np.ndarray, seed: int) -> np.ndarray:
    return _mixed(numbers.astype(np.uint64) ^ np.uint64(seed % 2**64))


def _of_tree(seeded: np.ndarray, tree: int) -> np.ndarray:
    return _mixed(seeded + np.uint64(tree * 0x632BE59BD9B4E019 % 2**64))


def _cdf(bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Distribution of a Poisson count of mean 2 ** bit, and the count by the first 12 bits of a hash (-1 where they do not tell)."""
    mean = 2**bit
    ends = np.cumsum([math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) for k in range(mean + 16 + 12 * math.isqrt(mean))])
    low, high = (np.searchsorted(ends, np.arange(k, 4096 + k) / 4096 - k * 2.0**-53, side="right") for k in (0, 1))
    return ends, np.where(low == high, low, -1).astype(np.int16)


CDFS = [_cdf(bit) for bit in range(PART + 1)]


def _poisson(hashed: np.ndarray, bit: int) -> np.ndarray:
    ends, counts = CDFS[bit]
    out = counts[hashed >> np.uint64(52)]
    unsure = np.flatnonzero(out < 0)
    out[unsure] = np.searchsorted(ends, (hashed[unsure] >> np.uint64(11)) * 2.0**-53, side="right")
    return out


def bootstrap(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree's bootstrap: Poisson with mean 1."""
    return _poisson(_of_tree(_seeded(ids, seed), tree), 0)


class Draws:
    """Poisson counts for cells that stand for many rows: a count for each power of two in a number of rows."""

    def __init__(self, code: np.ndarray, counts: Sequence[np.ndarray], seed: int):
        cell = functools.reduce(lambda h, word: _seeded(_mixed(h) ^ word.astype(np.uint64), seed), code, np.zeros(code.shape[1], np.uint64))
        self.cells, self.parts = code.shape[1], []
        for label, n in enumerate(counts):
            for bit in range(PART + 1):
                times = n >> bit if bit == PART else n >> bit & 1
                at = np.flatnonzero(times)
                at = np.repeat(at, times[at])
                if len(at):
                    # which count of its cell it is: class, power of two, repetition
                    again = np.arange(len(at)) - np.searchsorted(at, at)
                    self.parts.append((label, bit, at, _mixed(cell[at] + (again * 64 + bit * 2 + label).astype(np.uint64))))

    def of(self, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows of class 0, of class 1) of each cell in the tree's bootstrap."""
        out = np.zeros((2, self.cells), np.int64)
        for label, bit, at, hashed in self.parts:
            n = _poisson(_of_tree(hashed, tree), bit)
            if bit < PART:
                out[label, at] += n
            else:
                out[label] += np.bincount(at, n, self.cells).astype(np.int64)
        return out


def drawn(paths: np.ndarray, tree: int, seed: int, features: int) -> np.ndarray:
    """(nodes, drawn features in order): the features by which each node may be split."""
    keys = _mixed(_of_tree(_seeded(paths, seed + 1), tree)[:, None] + np.arange(features, dtype=np.uint64))
    return np.sort(keys.argsort(axis=1)[:, :math.ceil(math.sqrt(features))], axis=1)


def coded(x: np.ndarray) -> np.ndarray:
    """(words, rows): the bins of each row, ``WORD`` features a word."""
    out = np.zeros((-(-x.shape[1] // WORD), len(x)), np.int64)
    for k in range(x.shape[1]):
        out[k // WORD] |= x[:, k].astype(np.int64) << (5 * (k % WORD))
    return out


def _bins(code: np.ndarray, feature: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bin of each row in its node's feature; rows of a node lie side by side."""
    c = code[0] if len(code) == 1 else code[np.repeat(feature // WORD, sizes), np.arange(code.shape[1])]
    return (c >> np.repeat(5 * (feature % WORD), sizes)) & (BINS - 1)


def _square(rows: np.ndarray, ones: np.ndarray) -> np.ndarray:
    out = rows - ones
    out *= out
    out += ones * ones
    out /= np.maximum(rows, 1)
    return out


def _purity(rows: np.ndarray, ones: np.ndarray, total: np.ndarray, total1: np.ndarray, leaf: int) -> np.ndarray:
    """What a split with these (rows, class 1) on the left is worth; -1 where a side is smaller than a leaf."""
    rest = total - rows
    out = _square(rows, ones)
    out += _square(rest, total1 - ones)
    np.copyto(out, -1.0, where=np.minimum(rows, rest) < leaf)
    return out


def _gains(best: np.ndarray, total: np.ndarray, total1: np.ndarray) -> np.ndarray:
    return best > _square(total, total1) * (1 + 1e-12)


def unpacked(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, class 1) of added up numbers."""
    ones = np.floor(sums * (1 / ONE))
    return sums - ones * ONE, ones


def _small_splits(code, w, starts, sizes, use, total, leaf) -> tuple:
    """(worth, place of the feature in ``use``, last bin on the left, sum of the left) for nodes of a few rows."""
    m = int(sizes.max())
    pos = np.minimum(starts[:, None] + np.arange(m), len(w) - 1)
    own = np.where(np.arange(m) < sizes[:, None], w[pos], 0.0)
    c = code[0][pos][:, None, :] if len(code) == 1 else code[(use // WORD)[:, :, None], pos[:, None, :]]
    x = (c >> (5 * (use % WORD))[:, :, None]).astype(np.uint8) & np.uint8(BINS - 1)
    left = np.zeros(x.shape)
    for k in range(m):
        left += (x[:, :, k:k + 1] <= x) * own[:, None, k:k + 1]
    worth = _purity(*unpacked(left), *unpacked(total[:, None, None]), leaf).reshape(len(x), -1)
    best, node = worth.max(axis=1), np.arange(len(x))
    key = (np.arange(use.shape[1], dtype=np.int32)[:, None] * BINS + x).reshape(len(x), -1)
    k = np.where(worth == best[:, None], key, use.shape[1] * BINS).argmin(axis=1)  # the first bin, whatever the rows' order
    return best, key[node, k] // BINS, key[node, k] % BINS, left.reshape(len(x), -1)[node, k]


def _large_splits(code, w, starts, sizes, use, total, leaf) -> tuple:
    """The same from histograms."""
    if sizes.sum() == starts[-1] + sizes[-1] - starts[0]:
        rows = slice(starts[0], starts[-1] + sizes[-1])
    else:
        rows = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
        rows += np.arange(len(rows))
    code, w = code[:, rows], w[rows]
    slot, hist = np.repeat(np.arange(len(sizes)) * BINS, sizes), np.empty((len(sizes), use.shape[1], BINS))
    for j in range(use.shape[1]):
        hist[:, j] = np.bincount(slot + _bins(code, use[:, j], sizes), w, len(sizes) * BINS).reshape(-1, BINS)
    left = hist.cumsum(axis=2)
    worth = _purity(*unpacked(left), *unpacked(total[:, None, None]), leaf).reshape(len(sizes), -1)
    k, node = worth.argmax(axis=1), np.arange(len(sizes))
    return worth[node, k], k // BINS, k % BINS, left.reshape(len(sizes), -1)[node, k]


def _merged(code: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(code[0]) if len(code) == 1 else np.lexsort(code)
    code = code[:, order]
    first = np.flatnonzero(np.concatenate([[True], (code[:, 1:] != code[:, :-1]).any(axis=0)]))
    return code[:, first], np.add.reduceat(w[order], first)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, path: int, depth: int, limit: int, leaf: int, seed: int) -> Forest:
    """One tree below a node, over bins, in place of thresholds the bin."""
    return _grown(*_merged(coded(x), w + (w * y.astype(float)) * ONE), x.shape[1], tree, path, depth, limit, leaf, seed)


def _grown(code: np.ndarray, w: np.ndarray, features: int, tree: int, path: int, depth: int, limit: int, leaf: int, seed: int) -> Forest:
    sizes, total = np.array([len(w)]), np.array([w.sum()])
    paths, parts, base = np.array([path], np.uint64), [], 0
    while True:
        rows, ones = unpacked(total)
        feature, cut = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64)
        is_open = (ones > 0) & (ones < rows) & (rows >= 2 * leaf) & (sizes > 1) & (depth < limit)
        number = np.flatnonzero(is_open)
        if len(number) < len(sizes):
            keep = np.flatnonzero(np.repeat(is_open, sizes))
            code, w = code[:, keep], w[keep]
        sz, tot = sizes[number], total[number]
        starts, lefts = np.cumsum(sz) - sz, np.zeros(len(number))
        use = drawn(paths[number], tree, seed, features)
        for lo, hi in zip((1, *SMALL), (*SMALL, math.inf)):
            find = _large_splits if hi == math.inf else _small_splits
            some = np.flatnonzero((sz > lo) & (sz <= hi))
            for s in (some[a:a + NODES] for a in range(0, len(some), NODES)):
                best, j, cut[number[s]], lefts[s] = find(code, w, starts[s], sz[s], use[s], tot[s], leaf)
                feature[number[s]] = np.where(_gains(best, *unpacked(tot[s])), use[s, j], -1)
        split = feature >= 0
        kid = np.where(split, base + len(sizes) + 2 * (np.cumsum(split) - 1), -1)
        parts.append((feature, cut, kid, np.where(split, kid + 1, -1), rows, ones / np.maximum(rows, 1)))
        if not split.any():
            break
        on = split[number]
        if not on.all():
            keep = np.flatnonzero(np.repeat(on, sz))
            code, w, sz, tot, lefts = code[:, keep], w[keep], sz[on], tot[on], lefts[on]
        right = _bins(code, feature[split], sz) > np.repeat(cut[split], sz)
        nright = np.add.reduceat(right.view(np.uint8), np.cumsum(sz) - sz, dtype=np.int64)
        nleft, order = sz - nright, np.empty(len(w), np.int64)
        # rows keep their order on each side
        for side, n, ahead in ((~right, nleft, np.cumsum(nright) - nright), (right, nright, np.cumsum(nleft))):
            at = np.flatnonzero(side)
            order[np.arange(len(at)) + np.repeat(ahead, n)] = at
        code, w = code[:, order], w[order]
        base, depth = base + len(sizes), depth + 1
        sizes, total = np.column_stack([nleft, nright]).ravel(), np.column_stack([lefts, tot - lefts]).ravel()
        paths = (paths[split][:, None] * np.uint64(2) + np.arange(2, dtype=np.uint64)).ravel()
    feature, cut, left, right, rows, share = (np.concatenate(c) for c in zip(*parts, strict=True))
    return Forest(np.zeros(1, np.int64), feature.astype(np.int32), cut.astype(float), left, right, rows.astype(np.int64), share)


def routes(feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """One number a node for ``descend``: left child (the right one is next to it), word, bin and shift; 0 for a leaf."""
    return np.where(feature >= 0, left.astype(np.int64) << 32 | (feature // WORD).astype(np.int64) << 16 | cut.astype(np.int64) << 8 | 5 * (feature % WORD), 0)


def descend(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    leaf, live, at = np.zeros(code.shape[1], np.int64), np.arange(code.shape[1]), np.zeros(code.shape[1], np.int64)
    while len(live):
        rec = table[at]
        go = rec != 0
        if np.count_nonzero(go) < 0.75 * len(go):
            leaf[live[~go]] = at[~go]
            live, at, rec, code, go = live[go], at[go], rec[go], code[:, go], None
        c = code[0] if len(code) == 1 else code[rec >> 16 & 0xFFFF, np.arange(code.shape[1])]
        step = (rec >> 32) + ((c >> (rec & 63) & (BINS - 1)) > (rec >> 8 & 63))
        at = step if go is None else np.where(go, step, at)
    return leaf


def stop_shares(forest: Forest, limits: Sequence[tuple]) -> np.ndarray:
    """(limits, nodes): share of class 1 where a row that comes to the node stops under each (depth, fewest rows) limit."""
    out, stopped = np.tile(forest.share, (len(limits), 1)), np.zeros((len(limits), len(forest.share)), bool)
    lo, hi, depth = 0, 1, 0
    while lo < hi:  # nodes lie level by level, children side by side
        for k, (deepest, fewest) in enumerate(limits):
            stopped[k, lo:hi] |= (forest.rows[lo:hi] < fewest) | (deepest is not None and depth >= deepest)
        parents = np.repeat(lo + np.flatnonzero(forest.feature[lo:hi] >= 0), 2)
        lo, hi, depth = hi, hi + len(parents), depth + 1
        stopped[:, lo:hi] = stopped[:, parents]
        out[:, lo:hi] = np.where(stopped[:, parents], out[:, parents], out[:, lo:hi])
    return out


def cells(batch, seed: int) -> tuple[np.ndarray, Draws]:
    """The bins and the draws of a batch of training cells."""
    *code, n0, n1 = (c.to_numpy() for c in batch.columns)
    return np.stack(code), Draws(np.stack(code), (n0, n1), seed)


class Top:
    """The nodes of one tree that all tasks know: feature, cut, left, right, rows, class 1, path, depth, parent, whether still to be split."""

    def __init__(self, large: bool):
        self.nodes = [[-1, 0, -1, -1, 0.0, 0.0, 1, 0, -1, large]]

    def column(self, k: int) -> np.ndarray:
        return np.array([n[k] for n in self.nodes])

    def routes(self) -> np.ndarray:
        return routes(*(self.column(k) for k in range(3)))

    def dealt(self) -> np.ndarray:
        """Nodes whose rows one task takes: leaves here that are small and of both classes (or the whole tree)."""
        f, rows, ones, is_open = (self.column(k) for k in (0, 4, 5, 9))
        return (f < 0) & ~is_open.astype(bool) & ((rows == 0) | ((rows <= ROWS) & (ones > 0) & (ones < rows)))

    def above(self, node: int, depth: int) -> int:
        while self.nodes[node][7] > depth:
            node = self.nodes[node][8]
        return node


def bin_edges(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Upper ends of all bins but the last: between the values where there are few, quantiles otherwise."""

    def few(batches):
        import pyarrow as pa

        seen = [np.zeros(0) for _ in features]
        for b in batches:
            for k, v in enumerate(seen):
                if len(v) <= BINS:
                    new = b.column(k).drop_null().to_numpy(zero_copy_only=False)
                    seen[k] = np.unique(np.concatenate([v, new[~np.isnan(new)]]))[:BINS + 1]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(seen)), pa.int32()), pa.array([v.tolist() for v in seen], pa.list_(pa.float64()))], ["k", "v"])

    found: list[set] = [set() for _ in features]
    for r in df.select(*features).mapInArrow(few, "k int, v array<double>").collect():
        found[r.k] |= set(r.v)
    out = []
    quantiles = df.approxQuantile(list(features), [k / BINS for k in range(1, BINS)], 0.001)
    for v, q in zip(map(sorted, found), quantiles, strict=True):
        between = [(a + b) / 2 if math.isfinite(a) and math.isfinite(b) else a for a, b in zip(v, v[1:])]
        out.append(np.array(between if len(v) <= BINS else sorted(set(q))))
    return out


class GrownForest:
    """A training set in bins; ``scores`` grows a forest over it and scores other rows as it grows."""

    def __init__(self, train: DataFrame, features: Sequence[str], label_col: str, seed: int):
        plain = stored(train.select(*[F.col(f"`{f}`").cast("double").alias(f"f{k}") for k, f in enumerate(features)],
                                    (F.col(f"`{label_col}`") == 1).cast("tinyint").alias("y")), "forest-rows")
        fit = [F.col("y").isNotNull(), *[F.coalesce(F.abs(f"f{k}") < F.lit(math.inf), F.lit(False)) for k in range(len(features))]]
        count, bad = plain.agg(F.count(F.lit(1)), F.count_if(~functools.reduce(lambda a, b: a & b, fit))).first()
        if bad:
            raise ValueError(f"{bad} training rows without a label or with a missing or infinite feature")
        self.features, self.seed, self.count = list(features), seed, count
        self.edges = bin_edges(plain, [f"f{k}" for k in range(len(features))])
        self.rows = stored(self._cells(plain), "forest-cells")
        self.parallel = train.sparkSession.sparkContext.defaultParallelism

    def _binned(self):
        edges = self.edges

        def matrix(batch) -> np.ndarray:
            # missing values sort last
            return coded(np.column_stack([np.searchsorted(e, batch.column(k).to_numpy(zero_copy_only=False).astype(float)) for k, e in enumerate(edges)]))

        return matrix

    def _cells(self, plain: DataFrame) -> DataFrame:
        """(c0, ... words of the bins, n0, n1 rows of each class)."""
        matrix, width = self._binned(), len(self.features)
        words = [f"c{k}" for k in range(-(-width // WORD))]

        def run(batches):
            import pyarrow as pa

            for b in batches:
                if b.num_rows:
                    y = b.column(width).to_numpy().astype(np.int64)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in matrix(b)), pa.array(1 - y), pa.array(y)], [*words, "n0", "n1"])

        rows = plain.mapInArrow(run, ", ".join(f"{c} long" for c in [*words, "n0", "n1"]))
        return rows.groupBy(*words).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))

    def _split_large(self, trees: int, limit: int, leaf: int) -> list[Top]:
        """The nodes above those that fit a task, a pass over the rows for each level."""
        tops = [Top(self.count > ROWS) for _ in range(trees)]
        seed, width = self.seed, len(self.features)

        def sums(todo):
            tables, places = {t: tops[t].routes() for t in todo}, {}
            for tree, nodes in todo.items():
                places[tree] = np.full(len(tops[tree].nodes), -1)
                places[tree][nodes] = np.arange(len(nodes))
            uses = {t: drawn(tops[t].column(6).astype(np.uint64)[nodes], t, seed, width) for t, nodes in todo.items()}

            def run(batches):
                import pyarrow as pa

                total: dict = {}
                for b in batches:
                    if not b.num_rows:
                        continue
                    code, draws = cells(b, seed)
                    for tree, use in uses.items():
                        zeros, ones = draws.of(tree)
                        on = np.flatnonzero(zeros + ones)
                        slot = places[tree][descend(tables[tree], code[:, on])]
                        if (slot < 0).any():
                            on, slot = on[slot >= 0], slot[slot >= 0]
                        own, h = code[:, on], np.empty((2, len(use), use.shape[1], BINS))
                        for j in range(use.shape[1]):
                            f = use[slot, j]
                            c = own[0] if len(own) == 1 else own[f // WORD, np.arange(len(f))]
                            at = slot * BINS + (c >> 5 * (f % WORD) & (BINS - 1))
                            h[1, :, j] = np.bincount(at, ones[on], len(use) * BINS).reshape(-1, BINS)
                            h[0, :, j] = np.bincount(at, zeros[on], len(use) * BINS).reshape(-1, BINS) + h[1, :, j]
                        if tree in total:
                            total[tree] += h
                        else:
                            total[tree] = h
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([h.tobytes() for h in total.values()], pa.binary())], ["tree", "h"])

            def choose(batches):
                import pyarrow as pa

                total: dict = {}
                for b in batches:
                    for tree, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        h = np.frombuffer(h)
                        total[tree] = total[tree] + h if tree in total else h
                for tree, h in total.items():
                    use = uses[tree]
                    rows, ones = left = h.reshape(2, len(use), -1, BINS).cumsum(axis=3)
                    whole = left[:, :, 0, -1]
                    worth = _purity(rows, ones, *whole[:, :, None, None], leaf).reshape(len(use), -1)
                    k, node = worth.argmax(axis=1), np.arange(len(use))
                    f = np.where(_gains(worth[node, k], *whole), use[node, k // BINS], -1)
                    cols = [np.full(len(f), tree), np.array(todo[tree]), f, k % BINS, *left.reshape(2, len(use), -1)[:, node, k], *whole]
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.float64)) for c in cols], list("abcdefgh"))

            return run, choose

        while True:
            todo: dict = {}
            for tree, top in enumerate(tops):
                room = OPEN - sum(map(len, todo.values()))
                if nodes := [k for k, n in enumerate(top.nodes) if n[9]][:room]:
                    todo[tree] = nodes
            if not todo:
                return tops
            run, choose = sums(todo)
            found = (self.rows.mapInArrow(run, "tree int, h binary").repartition(min(trees, 4 * self.parallel), "tree")
                     .mapInArrow(choose, ", ".join(f"{c} double" for c in "abcdefgh")).collect())
            for tree, node, f, cut, l0, l1, t0, t1 in sorted(map(tuple, found)):
                nodes = tops[int(tree)].nodes
                n = nodes[int(node)]
                n[4], n[5], n[9] = t0, t1, False
                if f < 0 or n[7] >= limit or t1 in (0, t0):
                    continue
                n[0], n[1], n[2], n[3] = int(f), int(cut), len(nodes), len(nodes) + 1
                for side, (r0, r1) in enumerate([(l0, l1), (t0 - l0, t1 - l1)]):
                    nodes.append([-1, 0, -1, -1, r0, r1, 2 * n[6] + side, n[7] + 1, int(node), r0 > ROWS and 0 < r1 < r0 and n[7] + 1 < limit])

    def scores(self, test: DataFrame, variants: Sequence[Variant], limit: int, leaf: int | Sequence[int]) -> DataFrame:
        """``test`` with ``_p``: share of class 1 for each variant, of a forest of the most trees of all variants.

        With several leaf sizes there is a forest for each, and ``_p`` has the variants of the first, then those of the next.
        """
        leaves = [max(x, 1) for x in ([leaf] if isinstance(leaf, int) else leaf)]
        if max(v[2] for v in variants) > ROWS:
            raise ValueError(f"a node of fewer than {ROWS} rows must be splittable")
        row = "_row" + "_" * max(map(len, test.columns))
        test = stored(test.withColumn(row, F.monotonically_increasing_id()), "forest-test")
        held_out = test.select(*[F.col(f"`{f}`").cast("double") for f in self.features], F.lit(0).cast("tinyint"), F.col(row))
        tops = self._split_large(max(v[0] for v in variants), limit, min(leaves))
        if len(leaves) == 1 or min(n[4] for t in tops for n in t.nodes[1:] or [[max(leaves)] * 5]) >= max(leaves):
            total = self._summed(held_out, tops, variants, limit, leaves)
        else:  # a large node's split leaves a side that the larger leaf size forbids
            parts = [self._summed(held_out, self._split_large(len(tops), limit, x), variants, limit, [x]).withColumnRenamed("p", f"p{k}") for k, x in enumerate(leaves)]
            total = functools.reduce(lambda a, b: a.join(b, "row"), parts).select("row", F.concat(*[f"p{k}" for k in range(len(parts))]).alias("p"))
        return test.join(total.select(F.col("row").alias(row), F.transform("p", lambda v: F.round(v, 12)).alias("_p")), row).drop(row)

    def _summed(self, held_out: DataFrame, tops: list[Top], variants: Sequence[Variant], limit: int, leaves: Sequence[int]) -> DataFrame:
        """(row, p): mean shares of class 1 for every leaf size and variant."""
        matrix, seed, width, trees = self._binned(), self.seed, len(self.features), len(tops)
        limits = sorted({v[1:] for v in variants}, key=str)
        steps = sorted({v[0] for v in variants})  # numbers of trees
        wide = -(-5 * min(width, WORD) // 8) if width <= WORD else 8 * -(-width // WORD)  # bytes of a row's bins

        def deal(training):
            def run(batches):
                import pyarrow as pa
                from pyspark import TaskContext

                held: dict = {}
                part, size = TaskContext.get().partitionId(), 0
                small, tables = [t.dealt() for t in tops], [t.routes() for t in tops]

                def out():
                    keys = list(held)
                    cols = [pa.array([k[j] for k in keys], pa.int32()) for j in range(3)]
                    return pa.RecordBatch.from_arrays([*cols, pa.array([training] * len(keys)), pa.array([b"".join(held[k]) for k in keys], pa.binary())],
                                                      ["tree", "node", "salt", "training", "rows"])

                for b in batches:
                    if not b.num_rows:
                        continue
                    code, draws = cells(b, seed) if training else (matrix(b), None)
                    bins = np.ascontiguousarray(code.T).view(np.uint8)[:, :wide]
                    if not training:
                        packed = np.column_stack([b.column(width + 1).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), bins])
                    for tree, table in enumerate(tables):
                        if training:
                            counts = draws.of(tree)
                            on = np.flatnonzero(counts.any(axis=0))
                            rows = np.column_stack([np.ascontiguousarray(counts[:, on].T, "<u4").view(np.uint8), bins[on]])
                        else:
                            on, rows = slice(None), packed
                        if len(table) == 1:
                            nodes, starts = np.zeros(1, np.int64), np.zeros(1, np.int64)
                        else:
                            at = descend(table, code[:, on])
                            if training and not small[tree][at].all():
                                rows, at = rows[small[tree][at]], at[small[tree][at]]
                            order = np.argsort(at.astype(np.uint16) if len(table) < 1 << 16 else at, kind="stable")
                            rows = rows[order]
                            nodes, starts = np.unique(at[order], return_index=True)
                        for node, some in zip(nodes.tolist(), np.split(rows, starts[1:]), strict=True):
                            if len(some):
                                # rows that only pass a closed node need not meet in one task
                                held.setdefault((tree, node, -1 if small[tree][node] else part), []).append(some.tobytes())
                        size += rows.size
                    if size >= FLUSH:
                        yield out()
                        held, size = {}, 0
                if held:
                    yield out()

            return run

        def words(rows: np.ndarray) -> np.ndarray:
            out = np.zeros((len(rows), 8 * -(-width // WORD)), np.uint8)
            out[:, :wide] = rows
            return np.ascontiguousarray(out.view("<i8").T)

        def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            tree, node, _ = (int(k) for k in key)
            top = tops[tree]
            n = top.nodes[node]
            read = lambda t, columns: np.frombuffer(b"".join(pdf.rows[pdf.training == t]), np.uint8).reshape(-1, columns)
            fit, rest = read(True, wide + 8), read(False, wide + 8)
            number = np.ascontiguousarray(rest[:, :8]).view("<i8").ravel()
            order = np.argsort(number)
            number, code = number[order], words(rest[order, 8:])
            if not len(number):
                return pd.DataFrame({"block": [], "tree": [], "part": []})
            share = np.empty((len(leaves), len(limits), len(number)))
            below = [k for k, (d, _) in enumerate(limits) if d is None or d >= n[7]]
            for k, (d, _) in enumerate(limits):
                if k not in below:
                    a = top.nodes[top.above(node, d)]
                    share[:, k] = a[5] / a[4]
            if below and len(fit):
                under = [(None if limits[k][0] is None else limits[k][0] - n[7], limits[k][1]) for k in below]
                counts = np.ascontiguousarray(fit[:, :8]).view("<u4").astype(float)
                rows, w = words(fit[:, 8:]), counts.sum(axis=1) + counts[:, 1] * ONE
                for k, leaf in enumerate(leaves):
                    forest = _grown(rows, w, width, tree, n[6], n[7], limit, leaf, seed)
                    share[k, below] = stop_shares(forest, under)[:, descend(routes(forest.feature, forest.threshold, forest.left), code)]
            elif below:
                share[:, below] = n[5] / max(n[4], 1)
            block, starts = np.unique(number >> BLOCK, return_index=True)
            ends, place = [*starts[1:].tolist(), len(number)], (number & ((1 << BLOCK) - 1)).astype("<u2")
            part = [place[a:b].tobytes() + share[:, :, a:b].tobytes() for a, b in zip(starts.tolist(), ends, strict=True)]
            return pd.DataFrame({"block": block, "tree": np.int32(tree), "part": part})

        def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            columns, total = len(leaves) * len(limits), np.zeros((len(steps), len(leaves) * len(limits), 1 << BLOCK))
            seen = np.zeros(1 << BLOCK, bool)
            for step, part in zip(np.searchsorted(steps, pdf.tree, side="right").tolist(), pdf.part, strict=True):
                rows = len(part) // (2 + 8 * columns)
                place = np.frombuffer(part, "<u2", rows)
                total[step][:, place] += np.frombuffer(part, np.float64, offset=2 * rows).reshape(columns, rows) if rows else 0
                seen[place] = True
            total = total.cumsum(axis=0).reshape(len(steps), len(leaves), len(limits), -1)[..., seen]
            p = np.stack([total[steps.index(v[0]), k, limits.index(v[1:])] / v[0] for k in range(len(leaves)) for v in variants])
            return pd.DataFrame({"row": (int(key[0]) << BLOCK) + np.flatnonzero(seen), "p": pd.Series(list(p.T), dtype=object)})

        kind = "tree int, node int, salt int, training boolean, rows binary"
        groups = sum(int(t.dealt().sum()) for t in tops)
        tasks = max(3 * self.parallel, min(groups, self.count * trees // 100_000))
        rows = self.rows.mapInArrow(deal(True), kind).unionByName(held_out.mapInArrow(deal(False), kind)).repartition(tasks, "tree", "node", "salt")
        parts = rows.groupBy("tree", "node", "salt").applyInPandas(finish, "block long, tree int, part binary")
        return parts.groupBy("block").applyInPandas(add, "row long, p array<double>")

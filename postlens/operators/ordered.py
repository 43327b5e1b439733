"""Ordered, skew-safe building blocks: running sums, row positions, hashed ranks.

A plain ``Window.partitionBy(user).orderBy(...)`` puts every row of a user into one
task, so one user holding a third of the data would sort a third of the data in a
single task. ``running_sums`` is a prefix scan over partitions instead: rows are dealt
out once by ranges of (keys, order) and sorted there, each partition adds up its own
rows in one pass, and only its first and its last key can go on beyond it. Those two
sums of every partition, the carry, are one small table; it is scanned by key and
broadcast (two rows a partition at most, whatever the data holds) and adds to each
partition's first key what came before. A hot key is spread over as many partitions
as its rows fill, nothing reaches the driver, and no job runs before the action.

The rows' branch and the carry's branch read one and the same exchange (Spark reuses
it), so the source is read once. Should a session switch that reuse off, the two could
be cut at different bounds: every partition is named by its first row, and a name that
the carry lacks fails the job instead of giving a wrong sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _partitions(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _changes(columns) -> np.ndarray:
    """Whether each row but the first differs from the one before in any of the Arrow ``columns`` (null equals null)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(columns[0]) if columns else 0
    out = np.zeros(max(n - 1, 0), bool)
    for c in columns if n > 1 else []:
        if pa.types.is_nested(c.type):
            v = c.to_pylist()
            out |= np.array([x != y for x, y in zip(v, v[1:])], bool)
            continue
        a, b = c[1:], c[:-1]
        out |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= pc.not_equal(pc.is_null(a), pc.is_null(b)).to_numpy(zero_copy_only=False)
    return out


def _name(batch, columns: Sequence[int]) -> tuple[list, int, int]:
    """The values of a partition's first row in ``columns``, and 128 bits that name the partition."""
    first = [batch.column(c)[0].as_py() for c in columns]
    digest = hashlib.md5(repr(first).encode()).digest()
    return first, int.from_bytes(digest[:8], "big", signed=True), int.from_bytes(digest[8:], "big", signed=True)


class _Scan:
    """Running sums over the sorted batches of one partition; a key's number grows from 0 in order of appearance."""

    def __init__(self, keys: Sequence[int], values: Sequence[int]):
        self.keys, self.values = keys, values
        self.number, self.last, self.carry = -1, None, [0] * len(values)

    def add(self, batch) -> tuple[np.ndarray, list[np.ndarray]]:
        """(number of each row's key, running sum of each value)."""
        import pandas as pd

        cols = [batch.column(k) for k in self.keys]
        now = [c[0].as_py() for c in cols]
        goes_on = self.number >= 0 and now == self.last
        start = self.number if goes_on else self.number + 1
        changed = _changes(cols)
        at = start + np.concatenate([[0], np.cumsum(changed)]).astype(np.int64) if cols else np.zeros(batch.num_rows, np.int64)
        sums = []
        for k, v in enumerate(self.values):
            s = pd.Series(batch.column(v).to_numpy(zero_copy_only=False)).groupby(at).cumsum().to_numpy(copy=True)
            if goes_on:
                s[at == start] += self.carry[k]
            self.carry[k] = s[-1]
            sums.append(s)
        self.number, self.last = int(at[-1]), [c[-1].as_py() for c in cols]
        return at, sums


def _rows_with_sums(keys, named, values, totals: bool, schema):
    """What ``mapInArrow`` runs for the rows: local running sums, the partition's name, whose key may go on."""

    def run(batches):
        import pyarrow as pa

        scan, name, held, ends = _Scan(keys, values), None, [], {}
        names = [f.name for f in schema.fields]

        def out(batch, at, sums, last):
            extra = [pa.array(np.full(len(at), name[1])), pa.array(np.full(len(at), name[2])), pa.array(at == 0), *map(pa.array, sums)]
            if totals:
                extra += [pa.array(np.full(len(at), False) if last is None else at == last)]
                extra += [pa.array(np.array([ends[x][k] for x in range(at[0], at[-1] + 1)])[at - at[0]]) for k in range(len(values))]
            return pa.RecordBatch.from_arrays([*batch.columns, *extra], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            name = name or _name(batch, named)
            at, sums = scan.add(batch)
            if not totals:
                yield out(batch, at, sums, None)
                continue
            for k in np.append(np.flatnonzero(np.diff(at)), len(at) - 1):
                ends[int(at[k])] = [s[k] for s in sums]
            # a batch waits until its last key has ended: only then are that key's totals known
            if held and at[-1] > held[-1][1][-1]:
                for h in held:
                    yield out(*h, None)
                held, ends = [], {x: v for x, v in ends.items() if x >= at[0]}
            held.append((batch, at, sums))
        for h in held:
            yield out(*h, scan.number)

    return run


def _carries(keys, named, values, schema):
    """What ``mapInArrow`` runs for the carry: the sums of a partition's first and last key."""

    def run(batches):
        import pyarrow as pa

        scan, name, first, first_key = _Scan(keys, values), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if name is None:
                name, first_key = _name(batch, named), [batch.column(k)[0].as_py() for k in keys]
            at, sums = scan.add(batch)
            if at[0] == 0:
                k = int(np.searchsorted(at, 0, "right")) - 1
                first = [s[k] for s in sums]
        if name is None:
            return
        rows = [(first_key, True, first)] + ([(scan.last, False, scan.carry)] if scan.number else [])
        columns = list(zip(*[(name[1], name[2], is_first, *name[0], *key, *[x.item() for x in sums]) for key, is_first, sums in rows]))
        from pyspark.sql.pandas.types import to_arrow_schema

        fields = to_arrow_schema(schema)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields)], schema=fields)

    return run


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict,
                 key_totals: bool = False, num_partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of several values (``{out: column}``) over ``order`` within ``keys``.

    ``order`` must be column names forming a total order within a key (add a
    tie-break column). Integers are added up as 64-bit integers, other numbers as
    doubles; null values count as 0; rows with a null key are a key of their own. With
    ``key_totals`` every ``out`` also gets ``out + '_total'``, the key's grand total (a
    task then holds the rows of one key that its partition has).
    """
    keys, order = list(keys), list(order)
    col = lambda c: F.col(f"`{c}`")
    base = df.select("*", *[F.col(v).alias(f"_pl_v{i}") if isinstance(v, str) else v.alias(f"_pl_v{i}") for i, v in enumerate(values.values())])
    vals = [f"_pl_v{i}" for i in range(len(values))]
    kinds = [T.LongType() if isinstance(base.schema[v].dataType, T.IntegralType) else T.DoubleType() for v in vals]
    base = base.withColumns({v: F.coalesce(F.col(v).cast(k), F.lit(0).cast(k)) for v, k in zip(vals, kinds, strict=True)})
    by = list(dict.fromkeys([*keys, *order]))
    dealt = base.repartitionByRange(_partitions(df, num_partitions), *map(col, by)).sortWithinPartitions(*map(col, by))
    at = lambda names: [base.columns.index(c) for c in names]
    flag, name = [T.StructField(f"_pl_{x}", T.BooleanType()) for x in ("in", "out")], [T.StructField(x, T.LongType()) for x in ("_pl_a", "_pl_b")]
    sums = [T.StructField(f"_pl_s{i}", k) for i, k in enumerate(kinds)]
    ends = [T.StructField(f"_pl_t{i}", k) for i, k in enumerate(kinds)]
    rows_schema = T.StructType([*base.schema.fields, *name, flag[0], *sums, *([flag[1], *ends] if key_totals else [])])
    rows = dealt.mapInArrow(_rows_with_sums(at(keys), at(by), at(vals), key_totals, rows_schema), rows_schema)

    own = lambda names, p: [T.StructField(f"_pl_{p}{i}", base.schema[c].dataType) for i, c in enumerate(names)]
    carry_schema = T.StructType([*name, flag[0], *own(by, "f"), *own(keys, "k"), *sums])
    carry = dealt.mapInArrow(_carries(at(keys), at(by), at(vals), carry_schema), carry_schema)
    same = Window.partitionBy(*[f"_pl_k{i}" for i in range(len(keys))])
    before = same.orderBy(*[f"_pl_f{i}" for i in range(len(by))]).rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumns({f"_pl_o{i}": F.coalesce(F.sum(f"_pl_s{i}").over(before), F.lit(0)) for i in range(len(vals))}
                              | {f"_pl_all{i}": F.sum(f"_pl_s{i}").over(same) for i in range(len(vals))})
    pick = lambda c, first: F.max(F.when(F.col("_pl_in") if first else ~F.col("_pl_in"), F.col(c)))
    carry = carry.groupBy("_pl_a", "_pl_b").agg(
        *[pick(f"_pl_o{i}", True).alias(f"_pl_o{i}") for i in range(len(vals))],
        *[pick(f"_pl_all{i}", True).alias(f"_pl_first{i}") for i in range(len(vals))],
        *[pick(f"_pl_all{i}", False).alias(f"_pl_last{i}") for i in range(len(vals))])
    found = rows.join(F.broadcast(carry), ["_pl_a", "_pl_b"], "left")
    lost = F.raise_error(F.lit("running sums: rows and carry were dealt out differently; spark.sql.exchange.reuse must be on"))
    new = {}
    for i, out in enumerate(values):
        offset = F.when(F.col("_pl_o0").isNull(), lost.cast(kinds[i])).when(F.col("_pl_in"), F.col(f"_pl_o{i}")).otherwise(F.lit(0))
        new[out] = F.col(f"_pl_s{i}") + offset
        if key_totals:
            new[out + "_total"] = F.when(F.col("_pl_in"), F.col(f"_pl_first{i}")).when(F.col("_pl_out"), F.col(f"_pl_last{i}")).otherwise(F.col(f"_pl_t{i}"))
    return found.select(*[col(c) for c in df.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value, out: str,
                key_total: str | None = None, exclusive: bool = False,
                num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = running sum of ``value`` over ``order`` within ``keys`` (see ``running_sums``).

    ``key_total`` optionally adds the key's grand total; ``exclusive`` gives the
    sum of the rows strictly before.
    """
    val = F.col(value) if isinstance(value, str) else value
    res = running_sums(df.withColumn("_pl_own", val), keys, order, {out: "_pl_own"},
                       key_totals=bool(key_total), num_partitions=num_partitions)
    if exclusive:
        res = res.withColumn(out, F.col(out) - F.coalesce(F.col("_pl_own"), F.lit(0)))
    res = res.withColumn(out, F.col(out).cast("long"))
    if key_total:
        res = res.withColumn(key_total, F.col(out + "_total").cast("long")).drop(out + "_total")
    return res.drop("_pl_own")


def row_position(df: DataFrame, order: Sequence, out: str = "row_pos", keys: Sequence[str] = (),
                 key_total: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """1-based position of each row in ``order`` (within ``keys`` if given); distributed."""
    return running_sum(df, keys, order, F.lit(1), out, key_total=key_total, num_partitions=num_partitions)


def md5_rank_key(seed, *cols) -> Column:
    """Seeded pseudo-random 32-bit key, identical in DuckDB.

    Spark: conv(substr(md5(seed|c1|c2...),1,8),16,10); DuckDB:
    ('0x'||substr(md5(...),1,8))::BIGINT. Ties are broken by the caller.
    """
    s = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str)
                                             else F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")


def md5_rank_key_sql(seed, *exprs: str) -> str:
    """DuckDB form of ``md5_rank_key``."""
    parts = " || '|' || ".join([f"'{seed}'"] + [f"coalesce(CAST({e} AS VARCHAR), '')" for e in exprs])
    return f"CAST(('0x' || substr(md5({parts}), 1, 8)) AS BIGINT)"


def first_by_order(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str] | None = None,
                   descending: Sequence[bool] | None = None) -> DataFrame:
    """One row per key: the row that sorts first by ``order``.

    A hash aggregate of ``min(struct(order..., payload...))`` with partial
    aggregation, so a hot key is pre-reduced in every map task (no window, no
    single-task sort of a large group).
    """
    keys = list(keys)
    payload = [c for c in (cols or df.columns) if c not in keys]
    ords = []
    for i, o in enumerate(order):
        c = F.col(o) if isinstance(o, str) else o
        if descending and descending[i]:
            c = -c
        ords.append(c.alias(f"_o{i}"))
    packed = F.struct(*ords, F.struct(*[F.col(c) for c in payload]).alias("_p"))
    agg = df.groupBy(*keys).agg(F.min(packed).alias("_m"))
    return agg.select(*keys, *[F.col(f"_m._p.{c}").alias(c) for c in payload])

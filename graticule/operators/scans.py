"""Prefix sums, positions, stable partition, gather and scatter.

A plain window over one group sorts that group in one task. Here the rows are dealt out by
ranges of (group, whole order), so a group, and a value of the first order column, with a
third of all rows is spread over many tasks. Each task runs its sums along its sorted
rows in one streamed pass, whose rows are written to the shared folder. What a run of
equal group lacks when it began in an earlier task follows from two small rows per task,
and is added by the task's number. The rows are shuffled once, whatever their source.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.session import written

# Rows of a run that wait in a task for the run's total; longer runs are looked up.
LONG_RUN = 65_536


def range_edges(df: DataFrame, columns: Sequence[str], ranges: int, rows: int) -> list[list[float]]:
    """Inner edges that cut each column into ``ranges`` parts of similar size.

    Edges only balance work, results do not depend on them; they are therefore
    estimated from at most about two million rows.
    """
    if ranges < 2:
        return [[] for _ in columns]
    source = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    if rows > 2_000_000:
        source = source.sample(fraction=2_000_000 / rows, seed=11)
    probabilities = [i / ranges for i in range(1, ranges)]
    quantiles = source.approxQuantile(list(columns), probabilities, 1.0 / (4 * ranges))
    return [sorted(set(q)) for q in quantiles]


def _sum_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return T.LongType()
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return T.DoubleType()
    if isinstance(kind, T.DecimalType):
        return T.DecimalType(min(38, kind.precision + 10), kind.scale)
    raise TypeError(f"cannot sum {kind.simpleString()}")


def _numbers(column: pa.Array, kind: T.DataType) -> np.ndarray:
    """Values to sum; a null adds nothing."""
    if isinstance(kind, T.DecimalType):
        return np.array([Decimal(0) if v is None else v for v in column.to_pylist()], object)
    target = pa.int64() if isinstance(kind, T.LongType) else pa.float64()
    return column.cast(target).fill_null(0).to_numpy(zero_copy_only=False)


def _key(batch: pa.RecordBatch, columns: Sequence[str], at: int) -> tuple:
    values = [batch.column(c)[at].as_py() for c in columns]
    return tuple("nan" if v != v else v for v in values)


def _starts(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Where a row's group differs from the row before it; never at the first row."""
    new = np.zeros(batch.num_rows, bool)
    for c in columns:
        column = batch.column(c)
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            new[1:] |= [a != b for a, b in zip(values[1:], values)]
        else:
            codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _along(values: np.ndarray, starts: np.ndarray, carried) -> tuple[np.ndarray, list]:
    """Running sums of each run of a batch, and each run's sum so far; the first run goes on from ``carried``."""
    edges = [0, *starts.tolist(), len(values)]
    if values.dtype == np.int64:
        out = np.cumsum(values)
        base = out[edges[:-1]] - values[edges[:-1]]
        base[0] = -carried
        out = out - np.repeat(base, np.diff(edges))
    else:
        out = values.copy()
        out[0] = out[0] + carried
        for a, b in zip(edges, edges[1:]):
            out[a:b] = np.cumsum(out[a:b])
    return out, [out[b - 1] for b in edges[1:]]


class _Scan:
    """One task's pass over its sorted rows: runs of equal group, numbered from 0."""

    def __init__(self, group: Sequence[str], sums: dict[str, T.DataType]):
        self.group, self.sums = group, sums
        self.run, self.rows, self.key = -1, 0, None  # the run of the last row, its rows so far, its group
        self.carried = {c: _zero(kind) for c, kind in sums.items()}

    def step(self, batch: pa.RecordBatch) -> tuple[int, bool, list[int], dict[str, np.ndarray], dict[str, list]]:
        """``(run of the first row, whether it goes on, edges of the runs, running sums, sum at each run's end)``."""
        going = self.run >= 0 and _key(batch, self.group, 0) == self.key
        if not going:
            self.run, self.rows = self.run + 1, 0
            self.carried = {c: _zero(kind) for c, kind in self.sums.items()}
        first, starts = self.run, _starts(batch, self.group)
        along, ends = {}, {}
        for c, kind in self.sums.items():
            along[c], ends[c] = _along(_numbers(batch.column(c), kind), starts, self.carried[c])
        edges = [0, *starts.tolist(), batch.num_rows]
        self.run += len(starts)
        self.rows = edges[-1] - edges[-2] + (0 if len(starts) else self.rows)
        self.carried = {c: e[-1] for c, e in ends.items()}
        self.key = _key(batch, self.group, batch.num_rows - 1)
        return first, going, edges, along, ends


def _zero(kind: T.DataType):
    return Decimal(0) if isinstance(kind, T.DecimalType) else 0 if isinstance(kind, T.LongType) else 0.0


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    return pa.int64() if isinstance(kind, T.LongType) else pa.float64()


def _local(group: Sequence[str], sums: dict[str, T.DataType], totals: bool, long_run: int):
    """Rows with their running sums inside the task; ``_run`` names a run whose sums are corrected later.

    Between them stand marks (``_mark``): one for the first, the last and every long run, with its group and sums.
    """
    kinds = {c: _arrow(kind) for c, kind in sums.items()}
    names = ["_run", "_mark", "_first", "_last", *[f"_along_{c}" for c in sums], *[f"_whole_{c}" for c in sums if totals]]

    def made(rows: pa.RecordBatch, along: dict, run: int | None, whole: dict | None = None, mark: tuple[bool, bool] | None = None) -> pa.RecordBatch:
        n = rows.num_rows
        arrays = [pa.array(np.full(n, run), pa.int64()) if run is not None else pa.nulls(n, pa.int64())]
        first, last = mark or (False, False)
        arrays += [pa.array(np.full(n, v)) for v in (mark is not None, first, last)]
        arrays += [pa.array(along[c], kinds[c]) for c in sums]
        if totals:
            arrays += [pa.array(whole[c], kinds[c]) if whole else pa.nulls(n, kinds[c]) for c in sums]
        return pa.RecordBatch.from_arrays([*rows.columns, *arrays], names=[*rows.schema.names, *names])

    def mark_of(row: pa.RecordBatch, run: int, ends: dict, last: bool) -> pa.RecordBatch:
        """A mark of the run of ``row``: its group and task, other columns null."""
        bare = [row.column(i) if c in group or c == "_part" else pa.nulls(1, row.schema.field(i).type) for i, c in enumerate(row.schema.names)]
        bare = pa.RecordBatch.from_arrays(bare, names=row.schema.names)
        return made(bare, {c: [e.item() if isinstance(e, np.generic) else e] for c, e in ends.items()}, run, None, (run == 0, last))

    def cut(along: dict, a: int, b: int) -> dict:
        return {c: v[a:b] for c, v in along.items()}

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, held, row = _Scan(group, sums), [], None

        def settled(ends: dict) -> Iterator[pa.RecordBatch]:
            for rows, along in held:
                yield made(rows, along, None, {c: np.repeat(np.array([e], object if isinstance(e, Decimal) else None), rows.num_rows) for c, e in ends.items()})
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            before, rows_before, run_before, row_before = scan.carried, scan.rows, scan.run, row
            first, going, edges, along, ends = scan.step(batch)
            last = len(edges) - 2
            row = batch.slice(edges[last], 1)
            if row_before is not None and not going and (run_before == 0 or rows_before > long_run):
                yield mark_of(row_before, run_before, before, False)
            for i in range(last):
                if first + i == 0 or edges[i + 1] - edges[i] + (rows_before if going and i == 0 else 0) > long_run:
                    yield mark_of(batch.slice(edges[i], 1), first + i, {c: e[i] for c, e in ends.items()}, False)
            if not totals:
                n = edges[1] if first == 0 else 0
                if n:
                    yield made(batch.slice(0, n), cut(along, 0, n), 0)
                if n < batch.num_rows:
                    yield made(batch.slice(n), cut(along, n, batch.num_rows), None)
                continue
            if held and not going:
                yield from settled(before)
            for i in sorted({0, last}):
                a, b = edges[i], edges[i + 1]
                waiting = sum(r.num_rows for r, _ in held)
                rows, part = batch.slice(a, b - a), cut(along, a, b)
                if first + i == 0 or (going and i == 0 and not held) or waiting + b - a > long_run:
                    for r, x in held:
                        yield made(r, x, first + i)
                    held.clear()
                    yield made(rows, part, first + i)
                else:
                    held.append((rows, part))
                if i == 0 and last:
                    yield from settled({c: e[0] for c, e in ends.items()})
            if last > 1:  # runs that begin and end in this batch
                a, b = edges[1], edges[last]
                sizes = np.diff(edges[1 : last + 1])
                whole = {c: np.repeat(np.array(e[1:last], object if isinstance(e[0], Decimal) else None), sizes) for c, e in ends.items()}
                yield made(batch.slice(a, b - a), cut(along, a, b), None, whole)
        for rows, along in held:  # the task's last run may go on in the next one
            yield made(rows, along, scan.run)
        if row is not None:
            yield mark_of(row, scan.run, scan.carried, True)

    return run_


def _carried(group: Sequence[str], sums: dict[str, T.DataType]):
    """What the first run of each task has before it, and the total of every group that crosses tasks."""
    kinds = {c: _arrow(kind) for c, kind in sums.items()}
    schema = pa.schema([
        ("_part", pa.int32()), ("_run", pa.int64()), *[x for c, kind in kinds.items() for x in ((f"_before_{c}", kind), (f"_total_{c}", kind))]
    ])

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names} for r in rows], schema)

    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            inside = []
            for r in batch.to_pylist():
                if r["_first"] or r["_last"]:
                    rows.append(r)
                else:
                    inside.append(r | {x: v for c, kind in sums.items() for x, v in ((f"_before_{c}", _zero(kind)), (f"_total_{c}", r[f"_along_{c}"]))})
            if inside:
                yield made(inside)
        rows.sort(key=lambda r: (r["_part"], r["_run"]))
        key = lambda r: tuple("nan" if r[c] != r[c] else r[c] for c in group)
        chains: list[list[dict]] = []
        for r in rows:
            # A first run goes on from the last run of the task before; a last one of its own task starts afresh.
            before = chains[-1][-1] if chains else None
            if before and r["_first"] and before["_last"] and key(r) == key(before):
                chains[-1].append(r)
            else:
                chains.append([r])
        for chain in chains:
            for c, kind in sums.items():
                so_far = _zero(kind)
                for r in chain:
                    r[f"_before_{c}"] = so_far
                    so_far += r[f"_along_{c}"]
                for r in chain:
                    r[f"_total_{c}"] = so_far
        if rows:
            yield made(rows)

    return run_


def running_sums(
    df: DataFrame,
    values: dict[str, str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    totals: dict[str, str] | None = None,
    ranges: int | None = None,
    long_run: int = LONG_RUN,
) -> DataFrame:
    """Inclusive prefix sums.

    ``values`` maps an output name to the summed column; ``totals`` optionally maps an output name
    to a column whose total over the whole group is added. ``order_by`` are any orderable
    columns; end it with a key, as rows equal in all of them meet in one task. ``ranges``
    is the number of tasks (``spark.sql.shuffle.partitions``). A null adds nothing; a null
    group is a group. Integers add up to bigint, floats to double, decimals to decimals.

    The corrections that are broadcast are at most two rows per task, and with ``totals`` one more per ``long_run`` rows.
    """
    totals = totals or {}
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = list(partition_by)
    sums = {c: _sum_type(df.schema[c].dataType) for c in dict.fromkeys([*values.values(), *totals.values()])}
    keys = [*group, *order_by]
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    kind_of = T.StructType([T.StructField(f.name, f.dataType, True) for f in ranged.schema.fields]).add("_run", T.LongType())
    for flag in ("_mark", "_first", "_last"):
        kind_of = kind_of.add(flag, T.BooleanType())
    fix_type = T.StructType([T.StructField("_part", T.IntegerType()), T.StructField("_run", T.LongType())])
    for c, kind in sums.items():
        kind_of = kind_of.add(f"_along_{c}", kind)
        fix_type = fix_type.add(f"_before_{c}", kind).add(f"_total_{c}", kind)
    for c, kind in sums.items() if totals else ():
        kind_of = kind_of.add(f"_whole_{c}", kind)
    # Written once: ranges are drawn anew whenever a plan is run, so rows and marks must come from one run.
    local = written(ranged.mapInArrow(_local(group, sums, bool(totals), long_run if totals else 1 << 62), kind_of), "scan")
    # At most two marks per task are put in order of their tasks in one task; marks of long runs stream through it.
    marks = local.where("_mark").select("_part", "_run", "_first", "_last", *group, *[f"_along_{c}" for c in sums])
    fixes = marks.repartition(1).mapInArrow(_carried(group, sums), fix_type)
    local = local.where("not _mark")
    zero = lambda c: F.coalesce(F.col(f"_before_{c}"), F.lit(0).cast(sums[c]))
    return local.join(F.broadcast(fixes), ["_part", "_run"], "left").select(
        *df.columns,
        *[(F.col(f"_along_{c}") + zero(c)).cast(sums[c]).alias(name) for name, c in values.items()],
        *[F.coalesce(f"_total_{c}", f"_whole_{c}").alias(name) for name, c in totals.items()],
    )


def positions(
    df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), output: str = "pos",
    ranges: int | None = None,
) -> DataFrame:
    """Zero-based position of each row within its group; ``order_by`` as for ``running_sums``."""
    counted = running_sums(
        df.withColumn("_one", F.lit(1).cast("bigint")), {output: "_one"}, order_by, partition_by, ranges=ranges
    )
    return counted.withColumn(output, F.col(output) - 1).drop("_one")


def stable_partition(
    df: DataFrame, goes_right: str, order_by: Sequence[str], partition_by: Sequence[str] = (),
    output: str = "new_pos", ranges: int | None = None,
) -> DataFrame:
    """New position of each row when false rows move before true rows, order kept."""
    flagged = df.withColumn("_right", F.when(F.col(goes_right), 1).otherwise(0).cast("bigint")).withColumn(
        "_left", 1 - F.col("_right")
    )
    counted = running_sums(
        flagged,
        {"_left_so_far": "_left", "_right_so_far": "_right"},
        order_by,
        partition_by,
        totals={"_all_left": "_left"},
        ranges=ranges,
    )
    place = F.when(F.col("_right") == 1, F.col("_all_left") + F.col("_right_so_far") - 1).otherwise(
        F.col("_left_so_far") - 1
    )
    return counted.withColumn(output, place).select(*df.columns, output)


def gather(index: DataFrame, source: DataFrame, keys: Sequence[str], at: str, position: str, value: str) -> DataFrame:
    """``out[row, c] = source[row, index[row, c]]``: fetch ``value`` stored at position ``at``."""
    picked = source.select(*keys, F.col(position).alias(at), value)
    return index.join(picked, [*keys, at])


def scatter(source: DataFrame, index: DataFrame, keys: Sequence[str], position: str, to: str, value: str) -> DataFrame:
    """``out[row, index[row, c]] = source[row, c]``: re-key ``value`` by its target position."""
    moved = source.join(index.select(*keys, position, to), [*keys, position])
    return moved.select(*keys, F.col(to).alias(position), value)


def mark_members(df: DataFrame, members: DataFrame, key: str, output: str = "flag") -> DataFrame:
    """False for rows whose key is in ``members``, true for all others."""
    marked = members.select(key).distinct().withColumn("_member", F.lit(True))
    return df.join(marked, key, "left").withColumn(output, F.col("_member").isNull()).drop("_member")

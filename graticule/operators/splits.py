"""Exact best split of many tree nodes at once.

Every midpoint between consecutive distinct values of every feature is a
candidate. Open nodes are numbered by ``slot``; the driver knows each slot's row
count and target sum from its parent. Small nodes are searched outright:
aggregate to distinct values, run sums along them, take the smallest criterion.
Large nodes are searched in two passes that give the same answer with far less
data moved:

1. A histogram over value ranges (combined inside each task, at most one row per
   slot, feature and range) yields the exact criterion at every range boundary
   and a lower bound for all candidates inside each range. The weighted impurity
   is concave in (rows, target sum), so over the reachable region of a range, a
   parallelogram, its minimum lies at one of four corners.
2. Only ranges whose bound does not exceed the best boundary are expanded to
   distinct values.

No window ever spans more than one range of one feature of one node.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.functions.dense import FlatTrees, matrix, members
from graticule.functions.impurity import criterion
from graticule.session import check_model_size, small_side

RANGE = ["slot", "feature", "range"]
LINE = ["line", "feature", "range"]

# The lower bound may exceed the true value by rounding; widen it by this much.
_SLACK = 1e-9

# Up to this many histogram cells a task keeps arrays, beyond it reports each block.
_DENSE_CELLS = 500_000

# Rows times trees that a task works on at once: arrays of a feature take about a hundred bytes each.
_BLOCK = 200_000

# Entries whose cuts a task judges together before it looks at each.
_CUT_BLOCK = 64

# Trees whose nodes share entries; a range's entries of so many nodes meet in one task.
WIDEST_LINE = 16


@dataclass(frozen=True)
class Level:
    """What a task needs to turn rows into the open nodes' feature entries.

    Rows are (at, features, y). ``at`` lists where the row stands in each tree it trains: the
    tree's id, or the index of a node once ``placed``.
    """

    trees: FlatTrees  # all nodes so far
    slot: np.ndarray  # node index -> slot, -1 for closed nodes
    shift: np.ndarray  # slot -> how many bits of the range number are dropped
    edges: Sequence[np.ndarray]  # per feature, sorted inner edges of the ranges
    width: int
    bits: int
    placed: bool = False
    # Slots that share entries, a line each: at most one of a tree, all of one shift, -1 for none. Without it every slot has a line.
    together: np.ndarray | None = None

    def lines(self) -> np.ndarray:
        return np.arange(len(self.shift))[:, None] if self.together is None else self.together

    def bins(self) -> np.ndarray:
        return np.left_shift(1, np.maximum(self.bits - self.shift, 0))

    def base(self) -> np.ndarray:
        """First cell of each slot; a slot owns width x bins consecutive cells."""
        return np.concatenate([[0], np.cumsum(self.bins() * self.width)])

    def cell_of(self, slot: np.ndarray, feature: np.ndarray | int, number: np.ndarray) -> np.ndarray:
        return self.base()[slot] + feature * self.bins()[slot] + number

    def stops(self, x: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Node that each entry of ``at`` has come to by now."""
        return self.trees.descend(x, at.astype(np.int64) if self.placed else self.trees.start(at), rows=row)

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """``(x, y, row, slot)`` of the rows in open nodes; a row is listed once for each tree where it is."""
        held, size = [], 0
        for batch in batches:
            x = matrix(batch.column(1), self.width)
            y = batch.column(2).to_numpy(zero_copy_only=False)
            row, at = members(batch.column(0))
            stop = self.stops(x, row, at)
            slot = np.where(stop >= 0, self.slot[stop], -1)
            keep = slot >= 0
            if not keep.any():
                continue
            row, slot = row[keep], slot[keep]
            live = np.zeros(len(x), bool)
            live[row] = True
            if not live.all():
                x, y, row = x[live], y[live], (np.cumsum(live) - 1)[row]
            held.append((x, y, row, slot))
            size += len(slot)
            if size >= _BLOCK:
                yield _joined(held)
                held, size = [], 0
        if held:
            yield _joined(held)

    def entries(self, batches: Iterator[pa.RecordBatch], open_cells: np.ndarray | None = None):
        """``(slot, feature, range, value, rows, target sum)`` of the distinct values of each block, in order of slot and value.

        Only those of open cells (a packed bitmap) where it is given.
        """
        for x, y, row, slot in self.blocks(batches):
            for f in range(self.width):
                values, code = np.unique(x[:, f], return_inverse=True)
                number = np.searchsorted(self.edges[f], values, side="right") if self.bits else np.zeros(len(values), np.int64)
                s, c, yy = slot, code[row], y[row]
                if open_cells is not None:
                    cell = self.cell_of(s, f, number[c] >> self.shift[s])
                    keep = (open_cells[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                    s, c, yy = s[keep], c[keep], yy[keep]
                seen, m, q = _added(s * len(values) + c, yy, len(self.shift) * len(values))
                if len(seen):
                    s, c = np.divmod(seen, len(values))
                    yield s, f, number[c] >> self.shift[s], values[c], m, q

    def shared_entries(self, batches: Iterator[pa.RecordBatch], open_cells: np.ndarray | None = None):
        """``(line, mask, feature, range, value, rows, target sum)``: ``entries`` with one for all slots of a line where its rows stand.

        Bit ``b`` of ``mask`` says that the entry counts for the slot at place ``b`` of its line. In order of line, mask and value.
        """
        lines = self.lines()
        line_of, place_of = np.zeros(len(self.shift), np.int64), np.zeros(len(self.shift), np.int64)
        at_line, at_place = np.nonzero(lines >= 0)
        line_of[lines[at_line, at_place]], place_of[lines[at_line, at_place]] = at_line, at_place
        shift = self.shift[lines.max(axis=1)]
        alone = len(self.shift) == len(lines)
        for x, y, row, slot in self.blocks(batches):
            if alone:
                kinds, kind = np.arange(len(lines)) << WIDEST_LINE | np.int64(1) << place_of[np.argsort(line_of)], line_of[slot]
            else:
                row, kinds, kind = _kinds(row, line_of[slot], np.int64(1) << place_of[slot], len(lines))
            yy = y[row]
            for f in range(self.width):
                values, code = np.unique(x[:, f], return_inverse=True)
                number = np.searchsorted(self.edges[f], values, side="right") if self.bits else np.zeros(len(values), np.int64)
                seen, m, q = _added(kind * len(values) + code[row], yy, len(kinds) * len(values))
                k, c = np.divmod(seen, len(values))
                line, some = kinds[k] >> WIDEST_LINE, kinds[k] & (1 << WIDEST_LINE) - 1
                ranges, v = number[c] >> shift[line], values[c]
                if open_cells is not None:
                    still = np.zeros_like(some)
                    for b in range(lines.shape[1]):
                        on = np.flatnonzero(some >> b & 1)
                        cell = self.cell_of(lines[line[on], b], f, ranges[on])
                        still[on] |= (open_cells[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(np.int64) << b
                    keep = still > 0
                    line, some, ranges, v, m, q = line[keep], still[keep], ranges[keep], v[keep], m[keep], q[keep]
                if len(line):
                    yield line, some, f, ranges, v, m, q


def _kinds(row: np.ndarray, line: np.ndarray, bit: np.ndarray, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and kind of each line where a row stands; a kind is a line and the mask of its slots."""
    key = row * lines + line
    if (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, row, line, bit = key[order], row[order], line[order], bit[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    mask, size = np.add.reduceat(bit, start), np.diff(np.append(start, len(key)))
    if (np.bitwise_count(mask) != size).any():  # a row that trains one tree twice counts twice
        start, mask = np.arange(len(key)), bit
    return row[start], *np.unique(line[start] << WIDEST_LINE | mask, return_inverse=True)


def _added(key: np.ndarray, y: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys below ``cells`` in order, with the rows and the target sum of each."""
    if cells <= 4 * len(key):
        m = np.bincount(key, minlength=cells)
        seen = np.flatnonzero(m)
        return seen, m[seen], np.bincount(key, weights=y, minlength=cells)[seen]
    order = np.argsort(key)
    key, y = key[order], y[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    return key[at], np.diff(np.append(at, len(key))), np.add.reduceat(y, at) if len(at) else y[:0]


def lines_together(tree_ids: np.ndarray, places: np.ndarray, shift: np.ndarray, bits: int) -> np.ndarray:
    """Lines of slots for ``Level.together``: nodes at one place of up to ``WIDEST_LINE`` trees, searched by ranges of one width.

    Nodes searched outright keep a line each, as all entries of a line and range meet in one task.
    """
    alone = np.where(shift >= bits, 1 + np.arange(len(shift)), 0)
    keys = np.stack([alone, tree_ids // WIDEST_LINE, places, shift], axis=1)
    line = np.unique(keys, axis=0, return_inverse=True)[1].ravel()
    lines = np.full((int(line.max()) + 1, WIDEST_LINE), -1, np.int64)
    lines[line, tree_ids % WIDEST_LINE] = np.arange(len(shift))
    return lines


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if len(held) == 1:
        return held[0]
    base = np.cumsum([0, *[len(h[0]) for h in held]])
    rows = [h[2] + b for h, b in zip(held, base)]
    return np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate(rows), np.concatenate([h[3] for h in held])


def range_counts(rows: DataFrame, level: Level) -> DataFrame:
    """(slot, feature, range, m, q, lo, hi): rows, target sum, smallest and largest value."""
    cells = int(level.base()[-1])
    names = [*RANGE, "m", "q", "lo", "hi"]

    def batch_of(cell, m, q, lo, hi) -> pa.RecordBatch:
        base = level.base()
        slot = np.searchsorted(base, cell, side="right") - 1
        feature, number = np.divmod(cell - base[slot], level.bins()[slot])
        keys = [pa.array(k, pa.int32()) for k in (slot, feature, number)]
        return pa.RecordBatch.from_arrays([*keys, pa.array(m, pa.int64()), pa.array(q), pa.array(lo), pa.array(hi)], names)

    def summed(batches: Iterator[pa.RecordBatch]):
        lines = level.lines()
        for line, mask, f, number, value, m, q in level.shared_entries(batches):
            first = np.ones(len(line), bool)
            first[1:] = (line[1:] != line[:-1]) | (mask[1:] != mask[:-1]) | (number[1:] != number[:-1])
            at = np.flatnonzero(first)
            last = np.append(at[1:], len(line)) - 1
            line, mask, number, lo, hi = line[at], mask[at], number[at], value[at], value[last]
            m, q = np.add.reduceat(m, at), np.add.reduceat(q, at)
            for b in range(lines.shape[1]):
                on = np.flatnonzero(mask >> b & 1)
                if not len(on):
                    continue
                cell = level.cell_of(lines[line[on], b], f, number[on])
                on, cell = on[order := np.argsort(cell, kind="stable")], cell[order]
                at = np.flatnonzero(np.diff(cell, prepend=-1))
                yield cell[at], np.add.reduceat(m[on], at), np.add.reduceat(q[on], at), np.minimum.reduceat(lo[on], at), np.maximum.reduceat(hi[on], at)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, q = np.zeros(cells, np.int64), np.zeros(cells)
        lo, hi = np.full(cells, np.inf), np.full(cells, -np.inf)
        for cell, m_, q_, lo_, hi_ in summed(batches):
            m[cell] += m_
            q[cell] += q_
            lo[cell] = np.minimum(lo[cell], lo_)
            hi[cell] = np.maximum(hi[cell], hi_)
        seen = np.flatnonzero(m)
        yield batch_of(seen, m[seen], q[seen], lo[seen], hi[seen])

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in summed(batches):
            yield batch_of(*found)

    found = rows.mapInArrow(
        dense if cells <= _DENSE_CELLS else sparse,
        "slot int, feature int, range int, m bigint, q double, lo double, hi double",
    )
    return found.groupBy(*RANGE).agg(
        F.sum("m").alias("m"), F.sum("q").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )


def value_counts(rows: DataFrame, level: Level, open_cells: np.ndarray | None = None) -> DataFrame:
    """(slot, feature, range, value, m, q) of the open cells, a packed bitmap (all when None).

    Copies of a value are collapsed per block and again before the shuffle, so a
    value shared by a third of all rows costs a few rows per task.
    """
    return value_entries(rows, level, open_cells).groupBy(*RANGE, "value").agg(F.sum("m").alias("m"), F.sum("q").alias("q"))


def value_entries(rows: DataFrame, level: Level, open_cells: np.ndarray | None = None) -> DataFrame:
    """``value_counts`` before its parts are added up: a value stands once per block that has it."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, f, number, value, m, q in level.entries(batches, open_cells):
            keys = [pa.array(slot, pa.int32()), pa.array(np.full(len(slot), f), pa.int32()), pa.array(number, pa.int32())]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(value), pa.array(m, pa.int64()), pa.array(q)], [*RANGE, "value", "m", "q"])

    return rows.mapInArrow(entries, "slot int, feature int, range int, value double, m bigint, q double")


def scored_ranges(counts: DataFrame, totals: DataFrame, kind: str, y_min: float, y_max: float) -> DataFrame:
    """Per range: exact criterion of the cut behind it, lower bound of the cuts inside it.

    ``totals`` holds (slot, n, s). One window per slot and feature, over at most its ranges.
    """
    line = "partition by slot, feature order by range"
    upto = f"over ({line} rows between unbounded preceding and current row)"
    cells = counts.join(totals, "slot").selectExpr(
        "*", f"sum(m) {upto} as n_left", f"sum(q) {upto} as s_left", f"lead(lo) over ({line}) as next_value"
    )
    cells = cells.selectExpr("*", "n_left - m as before_n", "s_left - q as before_s")
    if y_max > y_min:
        high_first = f"((q - m * {y_min!r}D) / {y_max - y_min!r}D)"
    else:
        high_first = "0D"
    low_first = f"(m - {high_first})" if y_max > y_min else "0D"
    corners = [
        criterion(kind, "before_n", "before_s"),
        criterion(kind, "n_left", "s_left"),
        criterion(kind, f"(before_n + {high_first})", f"(before_s + {high_first} * {y_max!r}D)"),
        criterion(kind, f"(before_n + {low_first})", f"(before_s + {low_first} * {y_min!r}D)"),
    ]
    return cells.selectExpr(
        *RANGE,
        f"case when next_value is not null then {criterion(kind, 'n_left', 's_left')} end as criterion",
        "hi as value",
        "next_value",
        "n_left",
        "s_left",
        "before_n",
        "before_s",
        f"case when lo < hi then least({', '.join(corners)}) end as bound",
    )


def kept_ranges(scored: DataFrame) -> DataFrame:
    """The best boundary cuts of each slot and the ranges that may hold a better cut."""
    best = scored.groupBy("slot").agg(F.min("criterion").alias("best"))
    return scored.join(best, "slot").selectExpr(
        "*",
        "coalesce(criterion = best, false) as at_boundary",
        f"bound is not null and (best is null or bound <= best + abs(best) * {_SLACK}D + {_SLACK}D) as inside",
    ).where("at_boundary or inside")


def candidates(counts: DataFrame, totals: DataFrame, kind: str, before: DataFrame | None = None) -> DataFrame:
    """Every cut between consecutive values of a range, with side counts and criterion.

    ``before`` holds (slot, feature, range, before_n, before_s), what lies left of a
    range; without it every feature is one range.
    """
    line = f"partition by {', '.join(RANGE)} order by value"
    upto = f"over ({line} rows between unbounded preceding and current row)"
    cuts = counts.selectExpr(
        *RANGE,
        "value",
        f"sum(m) {upto} as n_left",
        f"sum(q) {upto} as s_left",
        f"lead(value) over ({line}) as next_value",
    ).where("next_value is not null")
    if before is not None:
        cuts = cuts.join(before, RANGE).selectExpr(
            *RANGE, "value", "next_value", "before_n + n_left as n_left", "before_s + s_left as s_left"
        )
    return cuts.join(totals, "slot").selectExpr(
        *RANGE,
        "value",
        "next_value",
        "case when (value + next_value) / 2 < next_value then (value + next_value) / 2 else value end as threshold",
        "n_left",
        "s_left",
        "n - n_left as n_right",
        "s - s_left as s_right",
        f"{criterion(kind, 'n_left', 's_left')} as criterion",
    )


_CUT = ["criterion", "feature", "value", "next_value", "n_left", "s_left"]


def best_cuts(cuts: DataFrame) -> DataFrame:
    """Smallest (criterion, feature, value) of each slot.

    The first grouping follows the window's own partitioning and order, so it
    streams; only one row per range is exchanged for the second.
    """
    per_range = cuts.groupBy(*RANGE).agg(F.min(F.struct(*_CUT)).alias("b"))
    return per_range.groupBy("slot").agg(F.min("b").alias("b")).select("slot", "b.*")


def _cuts_of(table: pa.Table) -> dict[int, tuple]:
    """Slot -> its smallest cut, from a table of at most a few cuts per slot."""
    best: dict[int, tuple] = {}
    for slot, *cut in zip(*(table.column(c).to_pylist() for c in ["slot", *_CUT])):
        if slot not in best or tuple(cut) < best[slot]:
            best[slot] = tuple(cut)
    return best


def side_of(kind: str, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """``functions.impurity.side`` over arrays: weighted impurity of a side of ``n`` rows and target sum ``s``."""
    some = np.maximum(n, 1e-300)
    if kind == "gini":
        out = s * (n - s) / some
    elif kind == "entropy":
        xlogx = lambda part: np.where(part > 0, part * np.log(np.where(part > 0, part, 1.0) / some), 0.0)
        out = -(xlogx(s) + xlogx(n - s))
    elif kind == "variance":
        out = -(s * s / some)
    else:
        raise ValueError(f"unknown impurity {kind!r}")
    return np.where(n > 0, out, 0.0)


def criterion_of(kind: str, n_left: np.ndarray, s_left: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
    n_left, n = n_left.astype(np.float64), n.astype(np.float64)
    return side_of(kind, n_left, s_left) + side_of(kind, n - n_left, s - s_left)


def _reached(best: dict[int, tuple], slots: int) -> np.ndarray:
    """Criterion of each slot's best cut so far."""
    return np.array([best[i][0] if i in best else np.inf for i in range(slots)])


def _first_least(slot: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Of rows in order of slot, feature and value: the first of the least score of each slot."""
    starts = np.flatnonzero(np.diff(slot, prepend=-1))
    least = np.repeat(np.minimum.reduceat(score, starts), np.diff(np.append(starts, len(slot))))
    at = np.flatnonzero(score == least)
    return at[np.flatnonzero(np.diff(slot[at], prepend=-1))]


def lower_bound(kind: str, n0, s0, n1, s1, n: np.ndarray, s: np.ndarray, y_min: float, y_max: float) -> np.ndarray:
    """Least criterion that any cut between two known ones, of ``n0`` and ``n1`` rows to the left, can have."""
    m, q, span = n1 - n0, s1 - s0, y_max - y_min
    high = (q - m * y_min) / span if span > 0 else np.zeros(len(m))
    low = m - high if span > 0 else np.zeros(len(m))
    corners = [(n0, s0), (n1, s1), (n0 + high, s0 + high * y_max), (n0 + low, s0 + low * y_min)]
    return np.min([criterion_of(kind, a, b, n, s) for a, b in corners], axis=0)


_CUTS_DDL = "slot int, criterion double, feature int, value double, next_value double, n_left bigint, s_left double"


def best_values(
    rows: DataFrame, level: Level, n: np.ndarray, s: np.ndarray, kind: str,
    open_cells: np.ndarray | None = None, before: tuple[np.ndarray, np.ndarray] | None = None,
    limit: np.ndarray | None = None, y_range: tuple[float, float] = (0.0, 1.0),
) -> dict[int, tuple]:
    """Best cut of each slot between values of one range, of the open cells (all when None).

    ``n`` and ``s`` are the slots' rows and target sums, ``before`` what lies left of each cell, ``limit`` a criterion
    that each slot is known to reach (with the range of targets): what cannot be as good need not be found.
    An entry of several slots is shuffled once for all of them. The entries of a line's range come to one
    task, sorted; a task holds one range at a time at most.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    lines = level.lines()

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line, mask, f, number, value, m, q in level.shared_entries(batches, open_cells):
            keys = [pa.array(line, pa.int32()), pa.array(np.full(len(line), f), pa.int32()), pa.array(number, pa.int32())]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(value), pa.array(mask, pa.int32()), pa.array(m, pa.int64()), pa.array(q)], [*LINE, "value", "mask", "m", "q"])

    def of_slots(table: pa.Table) -> Iterator[pa.RecordBatch]:
        line, feature, number, mask = (table.column(c).to_numpy().astype(np.int64) for c in (*LINE, "mask"))
        value, m, q = (table.column(c).to_numpy() for c in ("value", "m", "q"))
        group = np.cumsum((np.diff(line, prepend=-1) != 0) | (np.diff(feature, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0))
        for b in range(lines.shape[1]):
            on = np.flatnonzero(mask >> b & 1)
            if not len(on):
                continue
            start = np.flatnonzero(np.diff(group[on], prepend=-1))
            of = on[start]
            found = cuts(start, lines[line[of], b], feature[of], number[of], value[on], m[on], q[on])
            if found:
                yield found

    def cuts(start, slot, feature, number, value, m, q) -> pa.RecordBatch | None:
        """Best cuts of slots from entries in ranges that begin at ``start``; blocks of entries that cannot hold one are passed over."""
        n_left, s_left = np.cumsum(m), np.cumsum(q)
        n_before, s_before = n_left[start] - m[start], np.append(0.0, s_left[start[1:] - 1])
        if before is not None:
            cell = level.cell_of(slot, feature, number)
            n_before, s_before = n_before - before[0][cell], s_before - before[1][cell]
        first = np.union1d(np.arange(0, len(m), _CUT_BLOCK), start)
        last = np.append(first[1:], len(m)) - 1
        at = np.searchsorted(start, first, side="right") - 1
        if limit is not None:
            n0, s0 = n_left[first] - m[first] - n_before[at], np.append(0.0, s_left[first[1:] - 1]) - s_before[at]
            bound = lower_bound(kind, n0, s0, n_left[last] - n_before[at], s_left[last] - s_before[at], n[slot[at]], s[slot[at]], *y_range)
            most = limit[slot[at]]
            keep = bound <= most + np.abs(most) * _SLACK + _SLACK
            first, last, at = first[keep], last[keep], at[keep]
        size = last - first + 1
        i = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at = np.repeat(at, size)
        ends = np.append(start[1:], len(m)) - 1
        cut = i != ends[at]
        i, at = i[cut], at[cut]
        cut = value[i] != value[i + 1]
        i, at = i[cut], at[cut]
        if not len(i):
            return None
        m, q, of = n_left[i] - n_before[at], s_left[i] - s_before[at], slot[at]
        score = criterion_of(kind, m, q, n[of], s[of])
        best = _first_least(of, score)
        low = i[best]
        columns = [pa.array(of[best], pa.int32()), pa.array(score[best]), pa.array(feature[at[best]], pa.int32()), pa.array(value[low]), pa.array(value[low + 1])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(m[best], pa.int64()), pa.array(q[best])], ["slot", *_CUT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # Ranges end where the keys change; the last one of a batch may go on.
            keys = [batch.column(c).to_numpy() for c in LINE]
            changes = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            other = bool(held) and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in LINE)
            end = int(changes[-1]) if len(changes) else 0
            if (end or other) and rows + end >= 50_000:
                yield from of_slots(pa.Table.from_batches([*held, batch.slice(0, end)]))
                held, rows = [], 0
                batch = batch.slice(end)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from of_slots(pa.Table.from_batches(held))

    found = rows.mapInArrow(entries, "line int, feature int, range int, value double, mask int, m bigint, q double")
    dealt = found.repartition(parts, *LINE).sortWithinPartitions(*LINE, "value").mapInArrow(run, _CUTS_DDL)
    per_slot = dealt.groupBy("slot").agg(F.min(F.struct(*_CUT)).alias("b")).select("slot", "b.*")
    return _cuts_of(per_slot.toArrow())


def outright_splits(rows: DataFrame, level: Level, n: np.ndarray, s: np.ndarray, kind: str) -> dict[int, tuple]:
    return best_values(rows, level, n, s, kind)


def boundary_splits(rows: DataFrame, level: Level, totals: DataFrame, kind: str, y_min: float, y_max: float) -> dict[int, tuple]:
    """Best cut among range boundaries only: the discretised, approximate search."""
    scored = scored_ranges(range_counts(rows, level), totals, kind, y_min, y_max)
    return _cuts_of(best_cuts(scored.where("criterion is not null")).toArrow())


def _driver_ranges(counts: pa.Table, level: Level, n: np.ndarray, s: np.ndarray, kind: str, y_min: float, y_max: float):
    """``scored_ranges`` and ``kept_ranges`` of a histogram that fits the driver: best boundary cuts, open cells and what lies left of each cell."""
    order = np.lexsort([counts.column(c).to_numpy() for c in reversed(RANGE)])
    slot, feature, number, m, q, lo, hi = (counts.column(c).to_numpy()[order] for c in [*RANGE, "m", "q", "lo", "hi"])
    slot, feature, number = (k.astype(np.int64) for k in (slot, feature, number))
    line = np.ones(len(slot), bool)
    line[1:] = (slot[1:] != slot[:-1]) | (feature[1:] != feature[:-1])
    start = np.flatnonzero(line)
    sizes = np.diff(np.append(start, len(slot)))
    n_left, s_left = np.cumsum(m), np.cumsum(q)
    n_left = n_left - np.repeat(np.append(0, n_left[start[1:] - 1]), sizes)
    s_left = s_left - np.repeat(np.append(0.0, s_left[start[1:] - 1]), sizes)
    before_n, before_s = n_left - m, s_left - q
    best: dict[int, tuple] = {}
    cut = np.flatnonzero(~np.append(line[1:], True))
    if len(cut):
        score = criterion_of(kind, n_left[cut], s_left[cut], n[slot[cut]], s[slot[cut]])
        for i, j in zip(_first_least(slot[cut], score), cut[_first_least(slot[cut], score)]):
            best[int(slot[j])] = (float(score[i]), int(feature[j]), float(hi[j]), float(lo[j + 1]), int(n_left[j]), float(s_left[j]))
    bound = lower_bound(kind, before_n, before_s, n_left, s_left, n[slot], s[slot], y_min, y_max)
    limit = _reached(best, len(n))[slot]
    inside = (lo < hi) & (bound <= limit + np.abs(limit) * _SLACK + _SLACK)
    cells = int(level.base()[-1])
    cell = level.cell_of(slot, feature, number)
    bits = np.zeros(8 * (cells // 8 + 1), bool)
    bits[cell[inside]] = True
    left_n, left_s = np.zeros(cells, np.int64), np.zeros(cells)
    left_n[cell], left_s[cell] = before_n, before_s
    return best, np.packbits(bits, bitorder="little"), (left_n, left_s), int(inside.sum())


def bounded_splits(
    rows: DataFrame, level: Level, totals: DataFrame, n: np.ndarray, s: np.ndarray, kind: str, y_min: float, y_max: float, limit: int
) -> dict[int, tuple]:
    """Best cut of each slot, expanding only the ranges that can hold it, whatever their number.

    Tasks are told the open ranges as a bitmap, one bit per histogram cell. A histogram of at most
    ``limit`` cells is judged on the driver; of a larger one only the bitmap comes there.
    """
    if int(level.base()[-1]) <= limit:
        best, open_cells, before, open_ = _driver_ranges(range_counts(rows, level).toArrow(), level, n, s, kind, y_min, y_max)
        found = best_values(rows, level, n, s, kind, open_cells, before, _reached(best, len(n)), (y_min, y_max)) if open_ else {}
        for slot, cut in found.items():
            best[slot] = min(cut, best.get(slot, cut))
        return best
    kept = kept_ranges(scored_ranges(range_counts(rows, level), totals, kind, y_min, y_max)).persist()
    try:
        best = _cuts_of(best_cuts(kept.where("at_boundary")).toArrow())
        inside = kept.where("inside").select(*RANGE, "before_n", "before_s")
        open_cells, open_ = _bitmap(inside, level)
        if open_:
            found = best_cuts(candidates(value_counts(rows, level, open_cells), totals, kind, small_side(inside, open_)))
            for slot, cut in _cuts_of(found.toArrow()).items():
                best[slot] = min(cut, best.get(slot, cut))
        return best
    finally:
        kept.unpersist()


def _bitmap(ranges: DataFrame, level: Level) -> tuple[np.ndarray, int]:
    """Packed bits of the cells of ``ranges``, and how many there are; tasks send bytes of it."""
    cells = int(level.base()[-1])
    check_model_size(cells // 64 + 1, "bitmap of the open ranges")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, feature, number = (batch.column(c).to_numpy().astype(np.int64) for c in RANGE)
            cell = level.cell_of(slot, feature, number)
            at, inverse = np.unique(cell >> 3, return_inverse=True)
            out = np.zeros(len(at), np.int64)
            np.bitwise_or.at(out, inverse, np.int64(1) << (cell & 7))
            count = np.bincount(inverse, minlength=len(at))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out), pa.array(count, pa.int64())], ["at", "bits", "n"])

    found = ranges.select(*RANGE).mapInArrow(bits, "at long, bits long, n long").groupBy("at").agg(
        F.bit_or("bits").alias("bits"), F.sum("n").alias("n")
    ).toArrow()
    packed = np.zeros(cells // 8 + 1, np.uint8)
    packed[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint8)
    return packed, int(found.column("n").to_numpy().sum())

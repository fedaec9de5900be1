"""Packing token sequences by linear grouping: rounded sizes, few configurations, real lengths, best fit.

Lengths are whole numbers up to the sequence length, so a histogram of at most that many
cells describes any corpus. The plan is made on the histogram and its size does not
depend on the number of documents:

1. Lengths above ``small`` are put in order and cut into ``groups`` groups of equal
   cardinality (full pieces need no partner). Within a group every length counts as
   the group's largest.
2. Configurations, that is how many members of which groups share a sequence, are chosen
   on the few rounded sizes: a knapsack finds the fullest one that the remaining groups
   allow, and it is used as often as they last. Configurations emptier than ``fill``
   are not used.
3. Real lengths take the places of rounded ones, runs of equal lengths at once.
4. What is left, small lengths above all, goes by best fit in decreasing order into the
   room left over, again runs of equal lengths into runs of equally filled sequences.

The plan says: the pieces of length L with ranks a .. b go to sequences s .. s + b - a at
one offset. Each piece finds its rank among equal lengths by a two-level count (blocks of
bounded size, then places inside the block), so a length that a third of all pieces share
is dealt over many tasks.

Rows, one per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
``sequence_id``, ``offset``. A null or empty text is one piece holding the closing id.
Equal rows are packed separately. An empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm import words as W
from graticule.llm.encoding import WordEncoder, tokenizer_path
from graticule.session import written

CAPACITY = 2048
GROUPS = 256
SMALL = 640
FILL = 0.98
BLOCK_ROWS = 20_000
CLOSING_ID = 0


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = WordEncoder(path), np.array([CLOSING_ID], "<u4").tobytes()
        for batch in W.chunks(batches):
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            all_ids, bounds = encoder.columns(batch.column("text"))
            for row, (begin, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                ids = all_ids[begin:end].tobytes() + closing
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    rows.append(row)
                    numbers.append(number)
                    starts.append(at // 4)
                    lengths.append(len(cut) // 4)
                    sums.append(zlib.crc32(cut))
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "text_hash", "piece", "start", "length", "ids_crc32"],
            )

    return run


def grouped(lengths: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Runs ``[length, count]`` in decreasing order, cut into groups of equal cardinality."""
    total = sum(lengths.values())
    out, current, room = [], [], 0
    size = -(-total // groups) if total else 0
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            if not room:
                current, room = [], size
                out.append(current)
            take = min(left, room)
            current.append([length, take])
            left -= take
            room -= take
    return out


def fullest(sizes: list[int], held: list[int], capacity: int) -> list[int]:
    """How many of each size fill ``capacity`` best, no more than ``held`` of each."""
    best = np.full(capacity + 1, -1, np.int64)
    best[0] = 0
    used: list[tuple[int, np.ndarray]] = []
    for j, size in enumerate(sizes):
        for _ in range(min(held[j], capacity // size)):
            before = best[:-size] if size <= capacity else best[:0]
            newly = np.zeros(capacity + 1, bool)
            newly[size:] = (best[size:] < 0) & (before >= 0)
            if not newly.any():
                break
            used.append((j, newly.copy()))
            best[newly] = len(used)
    at = int(np.flatnonzero(best >= 0)[-1])
    count = [0] * len(sizes)
    while at:
        j = used[best[at] - 1][0]
        count[j] += 1
        at -= sizes[j]
    return count


def plan(
    histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL, fill: float = FILL
) -> np.ndarray:
    """Rows ``(length, rank, count, first sequence, offset)``: runs of pieces into runs of sequences."""
    rows: list[tuple[int, int, int, int, int]] = []
    ranks = dict.fromkeys(histogram, 0)
    free: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # runs [first sequence, count] by room
    sequences = 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, ranks[length], count, first, offset))
        ranks[length] += count

    left = {k: n for k, n in histogram.items() if n}
    if full := left.pop(capacity, 0):
        put(capacity, full, 0, 0)
        sequences = full
    queues = grouped({k: n for k, n in left.items() if k > small}, groups)
    sizes = [q[0][0] for q in queues]
    held = [sum(n for _, n in q) for q in queues]
    while any(held):
        count = fullest(sizes, held, capacity)
        if sum(s * c for s, c in zip(sizes, count)) < fill * capacity:
            break
        times = min(h // c for h, c in zip(held, count) if c)
        runs = [[sequences, times, 0]]
        sequences += times
        for j, c in enumerate(count):
            held[j] -= c * times
            for _ in range(c):
                cut = []
                for first, n, used in runs:
                    while n:
                        length, ready = queues[j][0]
                        take = min(n, ready)
                        put(length, take, first, used)
                        left[length] -= take
                        cut.append([first, take, used + length])
                        first, n = first + take, n - take
                        queues[j][0][1] -= take
                        if not queues[j][0][1]:
                            queues[j].pop(0)
                runs = cut
        for first, n, used in runs:
            free[capacity - used].append([first, n])
    for length in sorted(left, reverse=True):
        count, room = left[length], length
        while count:
            while room <= capacity and not free[room]:
                room += 1
            if room > capacity:
                each = capacity // length
                some, rest = divmod(count, each)
                for times, items in ((some, each), (1 if rest else 0, rest)):
                    if times:
                        for i in range(items):
                            put(length, times, sequences, i * length)
                        free[capacity - items * length].append([sequences, times])
                        sequences += times
                break
            first, n = free[room][-1]
            take = min(n, count)
            put(length, take, first, capacity - room)
            if take == n:
                free[room].pop()
            else:
                free[room][-1] = [first + take, n - take]
            free[room - length].append([first, take])
            count -= take
            room = length
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(layout: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, first, offset = layout.T
        keys = [(int(k), int(r)) for k, r in zip(length, rank)]
        starts: dict[int, int] = {}
        for i, (k, _) in enumerate(keys):
            starts.setdefault(k, i)
        ends = {k: i + 1 for i, (k, _) in enumerate(keys)}
        for batch in batches:
            ls, rs = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            at = np.zeros(len(ls), np.int64)
            for k in np.unique(ls).tolist():
                mine = ls == k
                a, b = starts[k], ends[k]
                at[mine] = a + np.searchsorted(rank[a:b], rs[mine], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "text_hash", "piece", "start", "length", "ids_crc32")]
                + [pa.array(first[at] + rs - rank[at]), pa.array(offset[at])],
                names=["doc_id", "text_hash", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """Place of every piece of every row of ``docs`` (see the module's notes)."""
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    pieces = written(
        keyed.mapInArrow(
            _pieces(path or tokenizer_path(), capacity),
            "doc_id long, text_hash long, piece int, start long, length long, ids_crc32 long",
        ), "pieces",
    )
    blocks = max(1, -(-pieces.count() // BLOCK_ROWS))
    placed = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "text_hash", "piece"), F.lit(blocks)))
    cells = placed.groupBy("length", "block").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "block").orderBy("doc_id", "text_hash", "piece")
    ranked = placed.withColumn("k", F.row_number().over(inside) - 1).join(offsets, ["length", "block"]).select(
        "doc_id", "text_hash", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank")
    )
    layout = plan(histogram, capacity, groups, small)
    return ranked.mapInArrow(
        _place(layout),
        "doc_id long, text_hash long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    ).drop("text_hash")

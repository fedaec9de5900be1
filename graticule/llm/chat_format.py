"""Minimum-cost role repair of conversations, and their rendering.

Legal turns are an optional system turn, then user and assistant in alternation, ending
with the assistant. Each input turn keeps or changes its role, and either opens an output
turn or merges into the one before; empty turns may be inserted. With prices for
changes, merges and insertions, the cheapest repair is a path through the automaton
whose states are the last output role. One turn is a matrix of the cheapest moves between
states, and a stretch of turns the (min, +) product of its turns, so a conversation is
cut into stretches of bounded length and solved in passes over them:

1. The matrix of each stretch.
2. Along each conversation, the cheapest cost of every state at each stretch's start.
3. In each stretch, where each end state comes from.
4. Back along each conversation, the end state of each stretch.
5. In each stretch, the turns' moves.

Only passes 2 and 4 hold a conversation together, as one small row per stretch. So a
conversation with a third of all turns is dealt out like any other rows. Of equally cheap
repairs the one with the smallest last states wins (none, system, user, assistant).

Rows, one per input turn: ``conv_id``, ``turn``, ``role``, ``new_role``, ``action`` (keep, relabel,
merge, relabel+merge), ``inserted`` (empty turns before it, comma-joined), ``seq`` (order
within the conversation) and ``rendered``: the pieces in order of ``seq`` are the rendered
conversation. ``<|`` inside a text is written ``< |``, so texts cannot open turns.

Turns are ordered by (turn, role, text), nulls first; turns of equal number keep that
order. A null or unknown role may become any role at a price; a null text is empty; null
conversation ids form one conversation. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.session import written

STRETCH = 4096
# Turns of one number and role are dealt out by so many characters of their texts, and ordered by whole texts.
TIED = 256
STATES = ("none", "system", "user", "assistant")
PRICES = {"relabel": 2, "unknown": 1, "merge": 1, "insert": 3}
_NEVER = 1 << 40
_NEXT = {"none": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


def moves(prices: dict[str, int] | None = None):
    """``(cost, how)`` by role, from and to: the cheapest cost matrix of each role and the move that reaches it; and end costs."""
    prices = PRICES | (prices or {})
    # Shortest chains of empty turns from a state up to, not including, the turn that follows.
    chains: dict[tuple[str, str], list[str]] = {}
    for s in STATES:
        frontier = [(s, [])]
        while frontier:
            at, chain = frontier.pop(0)
            for o in _NEXT[at]:
                if (s, o) not in chains:
                    chains[s, o] = chain
                    frontier.append((o, [*chain, o]))
    cost, how = {}, {}
    for role in (*STATES[1:], None):
        m = np.full((4, 4), _NEVER, np.int64)
        for i, s in enumerate(STATES):
            for j, o in enumerate(STATES):
                if o == "none":
                    continue
                change = 0 if o == role else prices["relabel" if role else "unknown"]
                ways = []
                if s == o:
                    ways.append((change + prices["merge"], True, []))
                if (s, o) in chains:
                    ways.append((change + prices["insert"] * len(chains[s, o]), False, chains[s, o]))
                if ways:
                    best = min(ways, key=lambda w: (w[0], not w[1]))
                    m[i, j] = best[0]
                    how[role, i, j] = best[1:]
        cost[role] = m
    tails = {s: [] if s == "assistant" else [*chains[s, "assistant"], "assistant"] for s in STATES}
    return cost, how, tails, np.array([prices["insert"] * len(tails[s]) for s in STATES], np.int64)


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], by: tuple[str, ...]):
    """Rows of sorted batches, run by run of equal ``by``."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            now = tuple(row[columns.index(c)] for c in by)
            if held and now != key:
                yield key, held
                held = []
            key = now
            held.append(row)
    if held:
        yield key, held


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_LONGS = pa.list_(pa.int64())


def _stretch_matrices(prices):
    cost, _, _, _ = moves(prices)
    schema = pa.schema([("conv", pa.string()), ("stretch", pa.int64()), ("m", _LONGS)])

    def made(batches):
        for (stretch, conv), rows in _runs(batches, ("stretch", "conv", "role"), ("stretch", "conv")):
            m = cost[rows[0][2]]
            for row in rows[1:]:
                m = np.minimum((m[:, :, None] + cost[row[2]][None, :, :]).min(1), _NEVER)
            yield conv, stretch, m.ravel().tolist()

    return lambda batches: _batches(made(batches), schema)


def _start_costs():
    schema = pa.schema([("conv", pa.string()), ("stretch", pa.int64()), ("start", _LONGS)])

    def made(batches):
        conv, f = object(), None
        for batch in batches:
            for c, stretch, m in zip(*(batch.column(x).to_pylist() for x in ("conv", "stretch", "m"))):
                if c != conv:
                    conv, f = c, np.array([0, _NEVER, _NEVER, _NEVER], np.int64)
                yield c, stretch, f.tolist()
                f = np.minimum((f[:, None] + np.array(m).reshape(4, 4)).min(0), _NEVER)

    return lambda batches: _batches(made(batches), schema)


def _walk(cost, start: list[int], roles: list) -> list[np.ndarray]:
    """Cheapest predecessor (smallest of equals) of each state after each turn."""
    f, back = np.array(start, np.int64), []
    for role in roles:
        all_ = f[:, None] + cost[role]
        back.append(all_.argmin(0))
        f = np.minimum(all_.min(0), _NEVER)
    back.append(f)
    return back


def _origins(prices):
    cost, _, _, _ = moves(prices)
    schema = pa.schema([("conv", pa.string()), ("stretch", pa.int64()), ("came", _LONGS), ("end", _LONGS)])

    def made(batches):
        for (stretch, conv), rows in _runs(batches, ("stretch", "conv", "role", "start"), ("stretch", "conv")):
            *back, f = _walk(cost, rows[0][3], [r[2] for r in rows])
            came = np.arange(4)
            for b in reversed(back):
                came = b[came]
            yield conv, stretch, came.tolist(), f.tolist()

    return lambda batches: _batches(made(batches), schema)


def _end_states(prices):
    _, _, _, last = moves(prices)
    schema = pa.schema([("conv", pa.string()), ("stretch", pa.int64()), ("state", pa.int64()), ("final", pa.bool_())])

    def made(batches):
        conv, state = object(), 0
        for batch in batches:
            for c, stretch, came, end in zip(*(batch.column(x).to_pylist() for x in ("conv", "stretch", "came", "end"))):
                final = c != conv
                if final:
                    conv, state = c, int((np.array(end) + last).argmin())
                yield c, stretch, state, final
                state = came[state]

    return lambda batches: _batches(made(batches), schema)


def _decisions(prices):
    cost, how, tails, _ = moves(prices)
    schema = pa.schema([
        ("uid", pa.int64()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.string()), ("opens", pa.bool_()),
        ("first", pa.bool_()), ("tail", pa.string()),
    ])

    def made(batches):
        for _, rows in _runs(batches, ("stretch", "conv", "role", "start", "state", "final", "uid"), ("stretch", "conv")):
            *back, _ = _walk(cost, rows[0][3], [r[2] for r in rows])
            states = [rows[0][4]]
            for b in reversed(back):
                states.append(int(b[states[-1]]))
            states.reverse()
            for at, row in enumerate(rows):
                s, o, role = states[at], states[at + 1], row[2]
                merge, chain = how[role, s, o]
                changed = "relabel" if STATES[o] != role else ""
                action = "+".join(x for x in (changed, "merge" if merge else "") if x) or "keep"
                tail = ",".join(["", *tails[STATES[o]]]) if row[5] and at == len(rows) - 1 else None
                yield row[6], STATES[o], action, ",".join(chain), not merge, s == 0, tail

    return lambda batches: _batches(made(batches), schema)


def repair(turns: DataFrame, prices: dict[str, int] | None = None) -> DataFrame:
    """Repaired role and rendered piece of every row of ``turns(conv_id, turn, role, text)`` (see the module's notes)."""
    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    role = F.when(F.col("role").isin(*STATES[1:]), F.col("role"))
    ordered = turns.select(
        "conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn", F.col("role").alias("given"),
        role.alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    keys = ["conv", "turn", "given", "text"]
    ordered = ordered.repartitionByRange(n, "conv", "turn", "given", F.substring("text", 1, TIED)).sortWithinPartitions(*keys)
    # Numbers rise with the order; they are fixed by being written, as is the cut into stretches.
    held = written(
        ordered.withColumn("uid", F.monotonically_increasing_id()).withColumn("stretch", F.expr(f"uid div {STRETCH}")), "chat-turns"
    )
    light = held.select("stretch", "conv", "uid", "role")
    by_stretch = lambda df, *more: df.repartition(n, "stretch").sortWithinPartitions("stretch", "conv", "uid").select(
        "stretch", "conv", "role", "uid", *more
    )
    stretches = by_stretch(light).mapInArrow(_stretch_matrices(prices), "conv string, stretch long, m array<long>")
    starts = written(
        stretches.repartition(n, "conv").sortWithinPartitions("conv", "stretch")
        .mapInArrow(_start_costs(), "conv string, stretch long, start array<long>"), "chat-starts",
    )
    started = light.join(starts, ["stretch", "conv"])
    origins = by_stretch(started, "start").mapInArrow(_origins(prices), "conv string, stretch long, came array<long>, end array<long>")
    ends = written(
        origins.repartition(n, "conv").sortWithinPartitions("conv", F.col("stretch").desc())
        .mapInArrow(_end_states(prices), "conv string, stretch long, state long, final boolean"), "chat-ends",
    )
    ended = started.join(ends, ["stretch", "conv"])
    decided = by_stretch(ended, "start", "state", "final").mapInArrow(
        _decisions(prices), "uid long, new_role string, action string, inserted string, opens boolean, first boolean, tail string"
    )
    empty = lambda names: F.aggregate(
        F.filter(F.split(names, ","), lambda x: x != ""), F.lit(""), lambda a, x: F.concat(a, F.lit("<|"), x, F.lit("|>\n<|end|>\n"))
    )
    body = F.replace("text", F.lit("<|"), F.lit("< |"))
    opening = F.concat(
        F.when(F.col("first"), F.lit("")).otherwise(F.lit("<|end|>\n")), empty(F.col("inserted")), F.lit("<|"), F.col("new_role"), F.lit("|>\n")
    )
    closing = F.when(F.col("tail").isNull(), F.lit("")).otherwise(F.concat(F.lit("<|end|>\n"), empty(F.col("tail"))))
    return held.join(decided, "uid").select(
        "conv_id", "turn", F.col("given").alias("role"), "new_role", "action", "inserted", F.col("uid").alias("seq"),
        F.concat(F.when(F.col("opens"), opening).otherwise(F.lit("\n")), body, closing).alias("rendered"),
    )

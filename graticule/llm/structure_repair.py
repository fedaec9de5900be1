"""Faults of conversations and their cheapest repair, by iterative-deepening A*.

A repair is a string of edits over a conversation's rows in order: D deletes a row, I inserts an
empty user or assistant turn, K keeps a row, R gives it the role of user or assistant. The
role initials that result must read ``(s?(ua)+)?``. Blank rows and rows seen before must be
deleted; keeping a truncated row costs extra. Of the cheapest repairs the one
whose edits are least in ASCII order is taken: depth-first search tries edits in
that order under a cost bound, and raises the bound to the least cost it had to turn away
until a path is accepted. A table keeps, for every (row, automaton state) that failed, the
least cost to go that failing has proved, so no failed state is searched again within it.

1. Equal rows of a turn collapse to one row with a number; the first turn of each (role,
   text) of a conversation is found by partial sums.
2. Rows are sorted over all tasks by (conversation, turn, role, text). A conversation of up
   to ``STRETCH`` rows inside one task is solved there. Longer ones, and those at the edge
   of a task, are cut into stretches: each gives the cheapest cost between all entry and
   exit states (16 searches), so one conversation with a third of all rows is dealt out too.
3. Back along the stretches of a conversation, one small row each, run the costs to go;
   with them each stretch is searched once per entry state.
4. Forward along the stretches the entry state follows, and with it the edits.

``audit`` gives one row per conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
``illegal``, ``cost``, ``audit`` (the edits) and ``repaired_sha256`` (repaired ``role:text`` lines).
``repair`` gives the repaired turns: ``conv_id``, ``part`` (order of a conversation's pieces),
``edits`` and ``turns`` (array of role and text).

Turns are ordered by number (nulls first), role and text. A null role or text is one space,
hence an unknown role and a blank row; null conversation ids form one conversation.
Repeated rows of a turn are duplicates. A conversation without rows, given by
``conversations`` only, has zeros, no edits and the hash of the empty string. Very long texts
are carried, not compared letter by letter; equality is that of SHA-256. An empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.session import written

STRETCH = 64
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
NEVER = 1 << 40
# Automaton states: nothing yet, after system, after user, after assistant.
TURN = (2, 2, 3, 2)  # state after the user or assistant turn that may come next
KEPT = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
LAST = (0, 2 * INSERT, INSERT, 0)  # cost of the turns still missing at the end
LEGAL = {"su", "ua", "au"}
ROLES = {2: "user", 3: "assistant"}


def lower_bounds(rows: list[tuple[str, bool]]) -> list[int]:
    """Cost that the rows from each place on cannot go below.

    Every row costs what keeping it at best costs; of the neighbours whose roles cannot
    follow each other, disjoint pairs cost one more change each.
    """
    least = [min(DELETE, (0 if initial in "sua" and initial else REROLE) + (TRUNCATED if cut else 0)) for initial, cut in rows]
    out = [0] * (len(rows) + 2)
    for i in range(len(rows) - 1, -1, -1):
        out[i] = out[i + 1] + least[i]
        if i + 1 < len(rows):
            x, y = rows[i][0], rows[i + 1][0]
            if x and y and x in "sua" and y in "sua" and x + y not in LEGAL:
                more = min(INSERT, REROLE, DELETE - least[i], DELETE - least[i + 1])
                out[i] = max(out[i], out[i + 2] + least[i] + least[i + 1] + max(0, more))
    return out


def search(rows: list[tuple[str, bool]], state: int, end: tuple[int, ...] | list[int]) -> tuple[int, str, int]:
    """``(cost, edits, exit state)`` of the cheapest, then ASCII-least repair of ``rows`` (initial, truncated).

    ``end`` is the cost from each exit state on; no turn is inserted after the last row.
    """
    n, below = len(rows), lower_bounds(rows)
    # Nothing leads back to a state before user and assistant, and only a kept system turn to the one behind it.
    reached = ({0, 1, 2, 3} if any(initial == "s" for initial, _ in rows) else {0, 2, 3}, {1, 2, 3}, {2, 3}, {2, 3})
    floor = [min(end[r] for r in reached[q]) for q in range(4)]
    if n == 0 or floor[state] >= NEVER:
        return (end[state], "", state) if n == 0 else (NEVER, "", -1)
    failed: dict[tuple[int, int], int] = {}

    def edits(i: int, q: int):
        """Edits in ASCII order: letter, cost, next row, next state."""
        initial, cut = rows[i]
        extra = TRUNCATED if cut else 0
        yield "D", DELETE, i + 1, q
        yield "I", INSERT, i, TURN[q]
        kept = KEPT.get((initial, q))
        if kept is not None:
            yield "K", extra, i + 1, kept
        yield "R", REROLE + extra, i + 1, TURN[q]

    def to_go(i: int, q: int) -> int:
        return end[q] if i == n else max(below[i] + floor[q], failed.get((i, q), 0))

    bound = to_go(0, state)
    while bound < NEVER:
        # Frames: row, state, cost so far, edits left, least cost to go turned away; letters of the path.
        stack, path = [[0, state, 0, edits(0, state), NEVER]], []
        while stack:
            frame = stack[-1]
            i, q, spent, left, turned = frame
            for letter, cost, j, r in left:
                need = cost + to_go(j, r)
                if spent + need > bound:
                    frame[4] = min(frame[4], need)
                    continue
                path.append(letter)
                if j == n:
                    return spent + cost + end[r], "".join(path), r
                stack.append([j, r, spent + cost, edits(j, r), NEVER])
                break
            else:
                failed[i, q] = max(failed.get((i, q), 0), frame[4])
                stack.pop()
                if stack:
                    path.pop()
                    above = stack[-1]
                    above[4] = min(above[4], spent - above[2] + failed[i, q])
        bound = max(bound + 1, failed[0, state])
    return NEVER, "", -1


class Stretch:
    """Rows of one conversation that follow each other: those that must go are only counted."""

    def __init__(self):
        self.live: list[tuple[str, bool]] = []  # initial, truncated
        self.turns: list[tuple[str, str]] = []
        self.gone = [0]  # rows to delete before the first live row and after each
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.first_turn = self.last_turn = None
        self.first_role = self.last_role = None

    def add(self, turn: int | None, role: str, text: str, copies: int, seen: bool) -> None:
        if self.last_role is None:
            self.first_role = role[:1]
        else:
            self.illegal += self.last_role + role[:1] not in LEGAL
        self.illegal += copies - 1
        self.last_role = role[:1]
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = turn
            self.distinct += turn != self.last_turn
            self.last_turn = turn
        shown = text.rstrip(" \t\n\x0b\x0c\r")
        if not shown:
            self.blank += copies
            self.gone[-1] += copies
        elif seen:
            self.duplicate += copies
            self.gone[-1] += copies
        else:
            cut = shown[-1] not in ".!?"
            self.truncated += cut
            self.duplicate += copies - 1
            self.live.append((role[:1], cut))
            self.turns.append((role, text))
            self.gone.append(copies - 1)

    def repaired(self, edits: str, state: int) -> tuple[str, list[tuple[str, str]]]:
        """All edits, forced deletions first wherever they can stand, and the repaired turns."""
        out, turns, at = ["D" * self.gone[0]], [], 0
        for letter in edits:
            out.append(letter)
            if letter == "I":
                state = TURN[state]
                turns.append((ROLES[state], ""))
                continue
            if letter == "K":
                state = KEPT[self.live[at][0], state]
                turns.append(self.turns[at])
            elif letter == "R":
                state = TURN[state]
                turns.append((ROLES[state], self.turns[at][1]))
            out.append("D" * self.gone[at + 1])
            at += 1
        return "".join(out), turns

    def summary(self) -> list[int | None]:
        return [self.blank, self.duplicate, self.truncated, self.illegal, self.distinct, self.first_turn, self.last_turn]


def ending(state: int) -> tuple[str, list[tuple[str, str]]]:
    """Edits and turns still missing at the end of a conversation."""
    missing = {0: [], 1: [2, 3], 2: [3], 3: []}[state]
    return "I" * len(missing), [(ROLES[s], "") for s in missing]


def gaps(first: int | None, last: int | None, distinct: int) -> int:
    return 0 if first is None else last - first + 1 - distinct


def rendered(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in turns).encode()


_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
_SOLVED = pa.schema([
    ("conv", pa.string()), ("task", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), ("summary", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
    ("gone", pa.list_(pa.int64())), ("cuts", pa.list_(pa.bool_())), ("matrix", pa.list_(pa.int64())), ("cost", pa.int64()), ("edits", pa.string()),
    ("turns", _TURNS), ("sha", pa.string()),
])
_SOLVED_DDL = (
    "conv string, task long, seq long, whole boolean, summary array<long>, roles array<string>, gone array<long>, cuts array<boolean>, "
    "matrix array<long>, cost long, edits string, turns array<struct<role:string,text:string>>, sha string"
)


def _dicts(turns: list[tuple[str, str]]) -> list[dict]:
    return [{"role": r, "text": t} for r, t in turns]


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _solve(stretch_rows: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def whole(conv: str, seq: int, s: Stretch) -> tuple:
            cost, edits, state = search(s.live, 0, LAST)
            edits, turns = s.repaired(edits, 0)
            more, added = ending(state)
            turns += added
            sha = hashlib.sha256(rendered(turns)).hexdigest()
            shown = _dicts(turns) if texts else None
            return conv, task, seq, True, s.summary(), None, None, None, None, cost + DELETE * sum(s.gone), edits + more, shown, sha

        def part(conv: str, seq: int, s: Stretch) -> tuple:
            matrix = []
            for entry in range(4):
                for exit_ in range(4):
                    matrix.append(search(s.live, entry, [0 if q == exit_ else NEVER for q in range(4)])[0])
            cuts = [cut for _, cut in s.live]
            return conv, task, seq, False, s.summary(), [s.first_role, s.last_role], s.gone, cuts, matrix, None, None, _dicts(s.turns), None

        def made() -> Iterator[tuple]:
            conv, s, seq, first, cut = None, None, 0, True, False
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("conv", "known", "at", "role", "text", "copies", "seen")]
                for c, known, at, role, text, copies, seen in zip(*columns):
                    if c != conv or s is None:
                        if s is not None:
                            # Neither the first nor the last conversation of this task, so all of it is here.
                            yield part(conv, seq, s) if first or cut else whole(conv, seq, s)
                            first, seq = False, seq + 1
                        conv, s, cut = c, Stretch(), False
                    elif len(s.live) == stretch_rows:
                        yield part(conv, seq, s)
                        s, seq, cut = Stretch(), seq + 1, True
                    s.add(at if known else None, role, text, copies, seen)
            if s is not None:
                yield part(conv, seq, s)

        return _batches(made(), _SOLVED)

    return run


def _costs_to_go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost from each state on behind every stretch; rows come sorted by conversation, last stretch first."""
    conv, end = None, list(LAST)
    for batch in batches:
        convs, tasks, seqs, out = (batch.column(c).to_pylist() for c in ("conv", "task", "seq", "matrix"))
        ends = []
        for c, m in zip(convs, out):
            if c != conv:
                conv, end = c, list(LAST)
            ends.append(end)
            end = [min(NEVER, min(m[4 * q + r] + end[r] for r in range(4))) for q in range(4)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(convs, pa.string()), pa.array(tasks, pa.int64()), pa.array(seqs, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["conv", "task", "seq", "end"]
        )


_PATHS_DDL = (
    "conv string, task long, seq long, summary array<long>, roles array<string>, gone array<long>, cuts array<boolean>, "
    "turns array<struct<role:string,text:string>>, end array<long>, final boolean, edits array<string>, exits array<long>, costs array<long>"
)
_PATHS = pa.schema([("edits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64())), ("costs", pa.list_(pa.int64()))])


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits, exit state and cost of each stretch from every entry state."""
    for batch in batches:
        rows = []
        for turns, cuts, end in zip(*(batch.column(c).to_pylist() for c in ("turns", "cuts", "end"))):
            live = [(t["role"][:1], cut) for t, cut in zip(turns, cuts)]
            found = [search(live, q, end) for q in range(4)]
            rows.append(([f[1] for f in found], [f[2] for f in found], [f[0] - end[f[2]] for f in found]))
        for name, column, kind in zip(_PATHS.names, zip(*rows), _PATHS.types):
            batch = batch.append_column(name, pa.array(list(column), kind))
        yield batch


def _followed(texts: bool):
    """Along the stretches of each conversation, the path taken: pieces, or one row with the digest."""
    schema = pa.schema([
        ("conv", pa.string()), ("task", pa.int64()), ("seq", pa.int64()), ("summary", pa.list_(pa.int64())), ("cost", pa.int64()), ("edits", pa.string()),
        ("turns", _TURNS), ("sha", pa.string()),
    ])
    names = ["conv", "task", "seq", "summary", "roles", "gone", "cuts", "turns", "edits", "exits", "costs", "final"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, state, sums = None, 0, None
        for batch in batches:
            for c, task, seq, summary, roles, gone, cuts, turns, edits, exits, costs, final in zip(*(batch.column(n).to_pylist() for n in names)):
                if c != conv or sums is None:
                    conv, state, role, cost, audit = c, 0, None, 0, []
                    digest, sums, any_turn = hashlib.sha256(), [0, 0, 0, 0, 0, None, None], False
                s = Stretch()
                s.turns = [(t["role"], t["text"]) for t in turns]
                s.live = [(r[:1], cut) for (r, _), cut in zip(s.turns, cuts)]
                s.gone = gone
                letters, shown = s.repaired(edits[state], state)
                cost += costs[state] + DELETE * sum(gone)
                state = exits[state]
                if final:
                    more, added = ending(state)
                    letters, shown, cost = letters + more, shown + added, cost + INSERT * len(added)
                for i in range(5):
                    sums[i] += summary[i]
                if role is not None and role + roles[0] not in LEGAL:
                    sums[3] += 1
                role = roles[1]
                if summary[5] is not None:
                    if sums[5] is None:
                        sums[5] = summary[5]
                    elif sums[6] == summary[5]:
                        sums[4] -= 1
                    sums[6] = summary[6]
                if texts:
                    yield c, task, seq, None, None, letters, _dicts(shown), None
                else:
                    audit.append(letters)
                    if shown:
                        digest.update((b"\n" if any_turn else b"") + rendered(shown))
                        any_turn = True
                    if final:
                        yield c, task, seq, sums, cost, "".join(audit), None, digest.hexdigest()

    return lambda batches: _batches(made(batches), schema)


def _conv(column: str | Column) -> Column:
    """The conversation as a string; null is a conversation of its own."""
    return F.coalesce(F.concat(F.lit("="), (F.col(column) if isinstance(column, str) else column).cast("string")), F.lit(""))


def _solved(turns: DataFrame, stretch: int, texts: bool) -> DataFrame:
    """One row per conversation, or per piece of one, by conversation string."""
    spark = turns.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select(
        _conv("conv_id").alias("conv"), F.col("turn").isNotNull().cast("int").alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"),
        F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)).alias("h"), role.alias("role"), text.alias("text"),
    )
    turn = ["conv", "known", "at", "h"]
    distinct = rows.groupBy(*turn).agg(F.count(F.lit(1)).alias("copies"), F.first("role").alias("role"), F.first("text").alias("text"))
    # The first turn of each (role, text); a join on the turn as well, so that no text meets in one task.
    firsts = rows.groupBy("conv", "h").agg(F.min(F.struct("known", "at")).alias("first")).select("conv", "first.*", "h", F.lit(False).alias("seen"))
    flagged = distinct.join(firsts, turn, "left").select(
        "conv", "known", "at", "role", "text", "copies", F.coalesce("seen", F.lit(True)).alias("seen")
    )
    order = ["conv", "known", "at", "role"]
    ordered = flagged.repartitionByRange(n, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    pieces = written(ordered.mapInArrow(_solve(stretch, texts), _SOLVED_DDL), "repair-pieces")
    parts = pieces.where("not whole")
    place = ["conv", "task", "seq"]
    back = parts.select(*place, "matrix").repartition(n, "conv").sortWithinPartitions("conv", F.desc("task"), F.desc("seq"))
    ends = back.mapInArrow(_costs_to_go, "conv string, task long, seq long, end array<long>")
    last = parts.groupBy("conv").agg(F.max(F.struct("task", "seq")).alias("last")).select("conv", "last.*", F.lit(True).alias("final"))
    known = parts.select(*place, "summary", "roles", "gone", "cuts", "turns").join(ends, place).join(last, place, "left")
    known = known.select(*place, "summary", "roles", "gone", "cuts", "turns", "end", F.coalesce("final", F.lit(False)).alias("final"))
    paths = written(known.mapInArrow(_paths, _PATHS_DDL), "repair-paths")
    followed = paths.repartition(n, "conv").sortWithinPartitions(*place).mapInArrow(
        _followed(texts), "conv string, task long, seq long, summary array<long>, cost long, edits string, turns array<struct<role:string,text:string>>, sha string"
    )
    return pieces.where("whole").select(followed.columns).unionByName(followed)


def audit(conversations: DataFrame, turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """Faults, cheapest repair and its hash of every ``conv_id`` of ``conversations``, from the rows of ``turns``."""
    found = _solved(turns, stretch, texts=False)
    ids = conversations.select("conv_id").distinct().withColumn("conv", _conv("conv_id"))
    at = lambda i: F.coalesce(F.get("summary", F.lit(i)), F.lit(0).cast("long"))
    gap = F.get("summary", F.lit(6)) - F.get("summary", F.lit(5)) + 1 - F.get("summary", F.lit(4))
    return ids.join(found, "conv", "left").select(
        "conv_id", F.coalesce(gap, F.lit(0).cast("long")).alias("gaps"), at(0).alias("blank"), at(1).alias("duplicate"), at(2).alias("truncated"),
        at(3).alias("illegal"), F.coalesce("cost", F.lit(0).cast("long")).alias("cost"), F.coalesce("edits", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def repair(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """The repaired turns of every conversation, in pieces of about ``stretch`` turns."""
    found = _solved(turns, stretch, texts=True)
    ids = turns.select("conv_id").distinct().withColumn("conv", _conv("conv_id"))
    return found.join(ids, "conv").select("conv_id", F.struct("task", "seq").alias("part"), "edits", "turns")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by ``crc32(conv_id:turn) % 20``, for tests of a repair: dropped, emptied, without ends, doubled, made user."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, v = F.coalesce("text", space), F.crc32(key) % 20
    return conversations.where(v != 0).select(
        "conv_id", "turn", F.when(v == 4, F.lit("user")).otherwise(F.coalesce("role", space)).alias("role"),
        F.when(v == 1, F.lit("")).when(v == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(v == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")

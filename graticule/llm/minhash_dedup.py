"""Near-duplicate texts by bottom-k sketches of one hash function.

A text's set is its distinct 5-word shingles, hashed once to 63 bits. The ``k`` least
values are its sketch. If two sets have Jaccard similarity 0.75, the shared part of the
least ``k`` values of their union lies in both sketches, so about three quarters of the
retained values agree. Steps:

1. One pass over the texts: set size, 128-bit key of the whole set, sketch. Texts with
   equal sets form a class; from here on classes are compared, copies only follow.
2. Inverted lists of retained values. Values are ordered by how many classes retain
   them; a class enters only the lists of its ``k_eff - need + 1`` rarest values, where
   ``need`` is the overlap every true partner reaches (certain for sets that fit into
   the sketch, missed with a chance near 1e-8 otherwise). A class that shares too few
   values with anyone enters no list, and passages that many texts quote are not used
   while rarer values remain.
3. Each list links its members to a leader. The union sketch estimates each pair's
   similarity; pairs 5.5 deviations below the threshold go, the others are verified on
   full sets. So a large group costs one pair per member instead of all pairs.
   A list whose members are still in several components is open. For the members of open
   lists the same inverted lists are made of full sets, where the overlap needed is
   certain and the rarest quarter of the values suffices. Open lists are dealt out in pairs
   of blocks and compared inside tasks by bitmaps of the sets, whose differing bits never
   outnumber differing members. A task first gives a forest of the likeliest pairs that
   span its components, at most one a member, and these are verified on full sets; once few
   of them are links, every pair that the bitmaps allow between the components left is
   verified. No link that could join two components is left out.
4. Components of the links.

Rows: ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable), ``kept``.
Fewer than five words make one shingle of the whole sequence; no words, or a null text,
make an empty set that links with nothing. Null ids are passed over when the smallest is
taken and are not kept where another id leads; rows with one id and different texts are
compared as texts of their own. Repeated rows share a class. An empty table gives an
empty result, further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graticule.llm import words as W
from graticule.llm.components import components
from graticule.session import small_side, written

SHINGLE = 5
SIMILARITY_PERCENT = 75
SKETCH = 64
DEVIATIONS = 5.5
BITMAP_BITS = 2048
BITMAP_MEMBERS = 512
BLOCK_MEMBERS = 512
PAIRS_AT_ONCE = 1 << 16
PAIRS_HELD = 1 << 18


def _sets(width: int):
    """Sorted distinct shingle values of each text of a chunk."""

    def of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offs = W.texts_of(batch.column("text"))
        _, _, hashes, first = W.words_in(data, offs, lower=True)
        shingles = W.runs_hashed(hashes, width, 5) >> np.uint64(1)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(shingles[a : b - width + 1])
            elif b > a:
                yield W.runs_hashed(hashes[a:b], b - a, 100 + b - a) >> np.uint64(1)
            else:
                yield np.zeros(0, np.uint64)

    return of


def _sketches(width: int, k: int):
    sets = _sets(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            sizes, keys, kept = [], [], []
            for values in sets(batch):
                sizes.append(len(values))
                keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                kept.append(values[:k])
            flat = np.concatenate(kept).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                    W.lists(pa.array(flat), np.array([len(v) for v in kept])),
                ],
                names=["doc_id", "text_hash", "n", "key", "sketch"],
            )

    return run


def _level(n: int) -> int:
    """How often a set is halved before it fits its bitmap."""
    return max(0, int(np.ceil(np.log2(n / BITMAP_MEMBERS)))) if n else 0


def _bitmap(values: np.ndarray, level: int) -> np.ndarray:
    """Bits of the members that the hash keeps in ``level`` halvings."""
    some = values[(values >> np.uint64(20)) & np.uint64((1 << level) - 1) == 0]
    out = np.zeros(BITMAP_BITS, np.uint8)
    out[(some % np.uint64(BITMAP_BITS)).astype(np.int64)] = 1
    return np.packbits(out).view(np.int64)


def _fixed(column: pa.Array) -> np.ndarray:
    """128-bit keys as a numpy array."""
    column = column.cast(pa.binary(16))
    return np.frombuffer(column.buffers()[1], "S16")[column.offset : column.offset + len(column)]


def _forest(parts_x: np.ndarray, parts_y: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Pairs, best first, that join two parts not joined by earlier ones."""
    low, high = np.minimum(parts_x, parts_y)[order], np.maximum(parts_x, parts_y)[order]
    _, first = np.unique(low * (int(high.max()) + 1) + high, return_index=True)
    first.sort()
    above: dict[int, int] = {}

    def root(n: int) -> int:
        while (up := above.get(n, n)) != n:
            above[n] = n = above.get(up, up)
        return n

    taken = []
    for at, x, y in zip(first.tolist(), low[first].tolist(), high[first].tolist()):
        x, y = root(x), root(y)
        if x != y:
            above[y] = x
            taken.append(at)
    return order[taken]


def _compared(percent: int, forest: bool):
    """Pairs of one list, or of two of its blocks, that lie in different components and may be similar.

    Similar sets differ in at most ``(1 - s) / (1 + s)`` of both sizes; for halved sets that
    bound gets its deviations. Rows come in order of (value, i, j). ``forest`` gives only as
    many of a batch's pairs as span what they connect, those with the most similar bitmaps first.
    """

    def near(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of each pair, and the share of the allowed difference that its bitmaps show."""
        parts = np.unique(_fixed(batch.column("component")), return_inverse=True)[1]
        side, held, rest = (batch.column(c).to_numpy() for c in ("mine", "held", "rest"))
        alone = np.asarray(batch.column("i")) == np.asarray(batch.column("j"))
        level = np.maximum(0, np.ceil(np.log2(held / BITMAP_MEMBERS))).astype(np.int64)
        maps = np.stack([
            batch.column(c).flatten().to_numpy().reshape(len(held), -1).view(np.uint64) for c in ("bits", "half")
        ])
        partners = ends - np.arange(len(ends)) - 1
        total = np.cumsum(partners)
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            some = partners[at:to]
            x = np.repeat(np.arange(at, to), some)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some)
            fits = (
                (parts[y] != parts[x]) & (alone[x] | (side[y] != side[x]))
                & (np.minimum(held[x], held[y]) * 100 >= np.maximum(held[x], held[y]) * percent)
                & (np.minimum(rest[x], rest[y]) * (100 + percent) >= (held[x] + held[y]) * percent)
            )
            x, y = x[fits], y[fits]
            both = np.maximum(level[x], level[y])
            differ = np.bitwise_count(maps[both - level[x], x] ^ maps[both - level[y], y]).sum(1, dtype=np.int64)
            most = (held[x] + held[y]) * ((100 - percent) / (100 + percent)) / 2.0**both
            most += np.where(both > 0, np.sqrt(most) * DEVIATIONS + DEVIATIONS, 1e-9)
            fits = differ <= most
            yield x[fits], y[fits], (differ[fits] / most[fits]), parts
            at = to

    def found(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(ends):
            return
        keys, code = np.unique(_fixed(batch.column("key")), return_inverse=True)
        first = np.zeros(len(keys), np.int64)
        first[code] = np.arange(len(code))
        column = batch.column("key")

        def named(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            low, high = np.minimum(code[x], code[y]), np.maximum(code[x], code[y])
            pair = np.unique(low * len(keys) + high)
            return pa.RecordBatch.from_arrays(
                [column.take(pa.array(first[pair // len(keys)])), column.take(pa.array(first[pair % len(keys)]))], names=["a", "b"]
            )

        held, size = [], 0
        for *pairs, parts in near(batch, ends):
            held.append(pairs)
            size += len(pairs[0])
            if size < PAIRS_HELD:
                continue
            # A forest of a forest and further pairs is the forest of all of them; other pairs may go at once.
            x, y, share = (np.concatenate([p[n] for p in held]) for n in range(3))
            if forest:
                some = np.sort(_forest(parts[x], parts[y], np.argsort(share, kind="stable")))
                held, size = [[x[some], y[some], share[some]]], 0
            else:
                yield named(x, y)
                held, size = [], 0
        if not sum(len(p[0]) for p in held):
            return
        x, y, share = (np.concatenate([p[n] for p in held]) for n in range(3))
        if forest:
            some = _forest(parts[x], parts[y], np.argsort(share, kind="stable"))
            x, y = x[some], y[some]
        yield named(x, y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.concat_batches([*left, batch])
            value, i, j = (both.column(c).to_numpy() for c in ("value", "i", "j"))
            cuts = np.flatnonzero((value[1:] != value[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            whole = int(cuts[-1]) if len(cuts) else 0
            yield from found(both.slice(0, whole), np.repeat(cuts, np.diff(cuts, prepend=0)))
            left = [both.slice(whole)]
        for batch in left:
            yield from found(batch, np.full(batch.num_rows, batch.num_rows))

    return run


def _full_sets(width: int):
    sets = _sets(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            found = list(sets(batch))
            flat = np.concatenate(found).view(np.int64)
            maps = [np.concatenate([_bitmap(v, _level(len(v)) + half) for v in found]) for half in (0, 1)]
            words = np.full(len(found), BITMAP_BITS // 64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), W.lists(pa.array(flat), np.array([len(v) for v in found])),
                    *(W.lists(pa.array(m), words) for m in maps),
                ],
                names=["key", "members", "bits", "half"],
            )

    return run


def overlap_needed(k: int, percent: int) -> int:
    """Retained values that partners share at least, by the binomial's deviation below its mean."""
    p = percent / 100
    return max(1, int(k * p - DEVIATIONS * (k * p * (1 - p)) ** 0.5))


def _links(pairs: DataFrame, classes: DataFrame, sets_of, k: int, percent: int, name: str) -> DataFrame:
    """Pairs ``(a, b)`` that are confirmed; ``sets_of`` gives full sets of the classes asked for."""
    floor = max(0.0, percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / k) ** 0.5)
    side = classes.select("key", "n", "sketch")
    both = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    judged = both.where(
        (F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb"))
    ).select("a", "b", "na", "nb", "sa", "sb", union.alias("u"))
    shared = F.size(F.array_intersect("u", F.array_intersect("sa", "sb")))
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    meet = F.size(F.array_intersect("sa", "sb"))
    exact = meet * 100 >= (F.col("na") + F.col("nb") - meet) * percent
    judged = written(
        judged.select("a", "b", whole.alias("whole"), F.when(whole, exact).otherwise(shared >= F.size("u") * F.lit(floor)).alias("ok"))
        .where("ok"), name,
    )
    sure, open_ = judged.where("whole").select("a", "b"), judged.where("not whole").select("a", "b")
    asked = open_.select(F.col("a").alias("key")).union(open_.select("b")).distinct()
    sets = sets_of(asked)
    return written(sure.union(_verified(open_, sets, percent)), f"{name}-links")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets are similar enough."""
    members = sets.select("key", "members")
    both = pairs.join(members.toDF("a", "ma"), "a").join(members.toDF("b", "mb"), "b")
    meet = F.size(F.array_intersect("ma", "mb"))
    return both.where(meet * 100 >= (F.size("ma") + F.size("mb") - meet) * percent).select("a", "b")


def _rarest(posted: DataFrame) -> DataFrame:
    """Inverted lists ``value, key, held, need, rest`` of each set's ``held - need + 1`` rarest values.

    ``rest`` counts the values from this one on. Values that only one set holds are the
    rarest; they take their places but enter no list.
    """
    often = posted.groupBy("value").agg(F.count("*").alias("f")).where("f > 1")
    shared = posted.join(often, "value").groupBy("key", "held", "need").agg(
        F.array_sort(F.collect_list(F.struct("f", "value"))).alias("v")
    )
    alone = F.col("held") - F.size("v")
    entered = shared.select("key", "held", "need", alone.alias("alone"), (F.col("held") - F.col("need") + 1 - alone).alias("take"), "v")
    return entered.where("take > 0").select(
        "key", "held", "need", "alone", F.posexplode(F.slice("v", F.lit(1), F.col("take").cast("int"))).alias("i", "p")
    ).select(F.col("p.value").alias("value"), "key", "held", "need", (F.col("held") - F.col("alone") - F.col("i")).alias("rest"))


def _joined_further(lists: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """``label(node, component)`` after all links inside ``lists`` that join two of its components.

    Lists with several components are dealt out in pairs of blocks. Rounds that verify a forest of
    likely pairs go on while a quarter of these are links; then all pairs that the bitmaps
    allow between the components left are verified.
    """
    bitmaps = sets.select("key", "bits", "half")
    forest = True
    while True:
        placed = lists.join(label.withColumnRenamed("node", "key"), "key")
        heads = placed.groupBy("value").agg(
            F.min("component").alias("c0"), F.max("component").alias("c1"), F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks")
        ).where("c0 != c1").select("value", "blocks")
        seen = Observation()
        opened = written(placed.join(written(heads, "open-values"), "value").observe(seen, F.count("*").alias("n")), "open-lists")
        if not seen.get["n"]:
            return label
        dealt = opened.withColumn("mine", F.pmod(F.xxhash64("key"), "blocks").cast("int")).withColumn(
            "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        ).select(
            "value", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "key", "component", "held", "rest"
        ).join(bitmaps, "key")
        near = dealt.repartition("value", "i", "j").sortWithinPartitions("value", "i", "j").mapInArrow(
            _compared(percent, forest), "a binary, b binary"
        )
        near, of_near = written(near.distinct(), "near-pairs"), Observation()
        links = written(_verified(near, sets, percent).observe(of_near, F.count("*").alias("n")), "block-links")
        found, proposed = of_near.get["n"], near.count()
        if found:
            label = _merged(label, links)
        if not forest or not proposed:
            return label
        forest = found * 4 >= proposed
        lists = opened.select(lists.columns)


def _merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between nodes."""
    of = label.withColumnRenamed("component", "c")
    ends = links.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(written(ends.distinct(), "component-pairs")).toDF("c", "to")
    return written(of.join(joined, "c", "left").select("node", F.coalesce("to", "c").alias("component")), "labels")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = SIMILARITY_PERCENT, k: int = SKETCH) -> DataFrame:
    """Component of every row (see the module's notes); also ``text_hash``, which tells rows of one id apart."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    rows = written(
        keyed.mapInArrow(_sketches(width, k), "doc_id long, text_hash long, n long, key binary, sketch array<long>"), "sketches"
    )
    filled = rows.where("n > 0")
    classes = filled.groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("speaker"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch"),
    )
    classes = written(classes, "shingle-classes")

    need_large = overlap_needed(k, percent)
    held = F.least(F.col("n"), F.lit(k))
    # A set whose partners all fit into the sketch needs the exact overlap.
    need = F.when(F.col("n") * 100 <= k * percent, F.ceil(F.col("n") * percent / 100)).otherwise(
        F.least(F.lit(need_large), F.ceil(F.col("n") * percent / 100))
    )
    posted = classes.select("key", held.alias("held"), need.cast("long").alias("need"), F.explode("sketch").alias("value"))
    lists = written(_rarest(posted), "sketch-lists")

    speakers = classes.select("key", "speaker")

    def sets_of(asked: DataFrame) -> DataFrame:
        who = asked.join(speakers, "key").select(
            "key", F.col("speaker.doc_id").alias("s_id"), F.col("speaker.text_hash").alias("s_hash")
        )
        who = written(who, "set-speakers")
        who = small_side(who, who.count())
        texts = keyed.join(who, keyed["doc_id"].eqNullSafe(who["s_id"]) & (keyed["text_hash"] == who["s_hash"])).select("key", "text")
        return written(
            texts.mapInArrow(_full_sets(width), "key binary, members array<long>, bits array<long>, half array<long>")
            .dropDuplicates(["key"]), "full-sets",
        )

    leaders = lists.groupBy("value").agg(F.min_by("key", F.struct(F.xxhash64("key"), "key")).alias("leader"), F.count("*").alias("m"))
    # Written, so that the join shuffles both sides and a long list can be split.
    leaders = written(leaders.where("m > 1").select("value", "leader"), "list-leaders")
    led = lists.join(leaders, "value").where("key != leader").select("value", "key", "leader")
    star = led.select(F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")).distinct()
    links = _links(star, classes, sets_of, k, percent, "star-pairs")
    label = components(links).withColumnRenamed("node", "key")
    placed = led.join(label, "key", "left").select("value", "key", F.coalesce("component", "key").alias("c"))
    opened = placed.groupBy("value").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("value")
    asked = placed.join(written(opened, "open-lists"), "value").select("key", "c").distinct()
    asked = written(asked, "open-classes")

    sets = sets_of(asked.select("key"))
    size = F.size("members").cast("long")
    posted = sets.select("key", size.alias("held"), F.ceil(size * percent / 100).alias("need"), F.explode("members").alias("value"))
    label = written(label.union(asked).distinct().toDF("node", "component"), "labels")
    label = _joined_further(written(_rarest(posted), "full-lists"), sets, label, percent)

    joined = classes.select("key", "least_id").join(label.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "least_id", F.coalesce("component", "key").alias("group")
    )
    least = joined.groupBy("group").agg(F.min("least_id").alias("component_id"))
    named = joined.join(least, "group").select("key", "component_id", "group")
    out = filled.join(named, "key").select("doc_id", "text_hash", "n", "component_id", "group")
    out = out.unionByName(rows.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("group")))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "text_hash", "group",
    )

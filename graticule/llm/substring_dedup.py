"""Exact removal of repeated passages: super-k-mer partitioning over word windows.

A window is ``window`` consecutive words of one text. Its minimiser is the least
hash among its runs of ``gram`` words, so windows with equal words always share it,
and consecutive windows mostly share one. Such a run of windows travels as one
packed string (its words joined by spaces) to the bucket of its minimiser; there all
windows are sorted and equal neighbours compared word for word. A word goes if a
window over it has the words of a window that starts anywhere else.

Steps, all of them shuffles on evenly spread keys:

1. One pass over the texts finds each text's runs (minimiser, start, windows).
   Texts with the same words as another one are settled here: every word goes, and
   one of them speaks for all.
2. Minimisers are counted. A run whose minimiser occurs once cannot repeat.
3. Only texts with a surviving run are cut into packed strings. A minimiser with more
   than ``split_above`` runs has each of its windows dealt by its own hash instead,
   so a passage shared by a third of all texts spreads over many tasks; equal strings
   collapse within the task before they travel. Both ways count the same windows.
4. Flags return to the texts that hold the strings.

Rows: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by one
space). A null text has no words. Equal rows are occurrences of their own: both lose
every word if long enough. Null or repeated ids are kept apart by their texts. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm import words as W
from graticule.session import small_side, written

WINDOW = 35
GRAM = 8
SPLIT_ABOVE = 64

_SPANS = (
    "doc_id long, text_hash long, n_words long, sha string, whole binary, minis array<long>, spans array<long>"
)


def _find_runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            data, offs = W.texts_of(batch.column("text"))
            _, _, hashes, first = W.words_in(data, offs)
            minis, at, length, per_text = _runs(hashes, first, window, gram)
            raw, shas, whole = data.tobytes(), [], []
            for i in range(len(offs) - 1):
                joined = b" ".join(raw[offs[i] : offs[i + 1]].split())
                shas.append(hashlib.sha256(joined).hexdigest())
                whole.append(xxhash.xxh3_128_digest(joined))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(first), pa.int64()),
                    pa.array(shas), pa.array(whole, pa.binary()), W.lists(pa.array(minis.view(np.int64)), per_text),
                    W.lists(pa.array(at.astype(np.int64) * window + length - 1), per_text),
                ],
                names=["doc_id", "text_hash", "n_words", "sha", "whole", "minis", "spans"],
            )

    return run


def _runs(hashes: np.ndarray, first: np.ndarray, window: int, gram: int):
    """Runs of windows of one minimiser: (minimiser, first window, windows), and the number of runs per text."""
    texts = len(first) - 1
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return np.zeros(0, np.uint64), none, none, np.zeros(texts, np.int64)
    least, place = W.least_of_runs(W.runs_hashed(hashes, gram, 7), window - gram + 1)
    owner = np.repeat(np.arange(texts), np.diff(first))
    valid = np.flatnonzero(owner[: len(least)] == owner[window - 1 :])
    if not len(valid):
        return np.zeros(0, np.uint64), none, none, np.zeros(texts, np.int64)
    mine, where = least[valid], place[valid]
    # A run ends where the leftmost minimiser moves, so two equal windows never share a run.
    breaks = np.flatnonzero(np.append(True, (np.diff(valid) != 1) | (where[1:] != where[:-1])))
    starts, who = valid[breaks], owner[valid[breaks]]
    return mine[breaks], starts - first[who], np.diff(np.append(breaks, len(valid))), np.bincount(who, minlength=texts)


def _cut(window: int, split_above: int, pack: bool):
    """Packed strings of the surviving runs: with their number when ``pack``, else where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            data, offs = W.texts_of(batch.column("text"))
            starts, ends, hashes, first = W.words_in(data, offs)
            whole_hash = W.runs_hashed(hashes, window, 11)
            raw = data.tobytes()
            ids, copied = batch.column("uid"), batch.column("copied").to_pylist()
            seen: dict[bytes, list] = {}
            out: list[tuple] = []
            for row, runs in enumerate(batch.column("runs").to_pylist()):
                ws, we = starts[first[row] : first[row + 1]], ends[first[row] : first[row + 1]]
                plain = [raw[a:b] for a, b in zip(ws.tolist(), we.tolist())]
                weight = 2 if copied[row] else 1
                for r in runs:
                    hot = r["n"] > split_above
                    start, windows = divmod(r["span"], window)
                    pieces = [(start + k, 1) for k in range(windows + 1)] if hot else [(start, windows + 1)]
                    for at, count in pieces:
                        packed = b" ".join(plain[at : at + count + window - 1])
                        key = xxhash.xxh3_128_digest(packed)
                        if not pack:
                            out.append((row, at, key))
                            continue
                        held = seen.get(key)
                        if held is None:
                            spread = int(whole_hash[first[row] + at]) if hot else 0
                            seen[key] = [((r["mini"] ^ spread) + (1 << 63)) % (1 << 64) - (1 << 63), packed, weight]
                        else:
                            held[2] += weight
            if pack:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([v[0] for v in seen.values()], pa.int64()), pa.array(list(seen), pa.binary()),
                        pa.array([v[1] for v in seen.values()], pa.binary()), pa.array([v[2] for v in seen.values()], pa.int64()),
                    ],
                    names=["bucket", "key", "packed", "n"],
                )
            else:
                rows = pa.array([o[0] for o in out], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
                    names=["uid", "start", "key"],
                )

    return run


def _count(window: int):
    """Which windows of each packed string occur twice or more within its bucket; buckets arrive sorted."""

    def judged(buckets: np.ndarray, packed: list[bytes], keys: list[bytes], weights: np.ndarray):
        data = np.frombuffer(b"".join(packed), np.uint8)
        offs = np.concatenate([[0], np.cumsum([len(p) for p in packed])]).astype(np.int64)
        starts, ends, hashes, first = W.words_in(data, offs)
        raw = data.tobytes()
        per = np.diff(first) - window + 1
        owner = np.repeat(np.arange(len(packed)), per)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        at = first[owner] + within
        marks = W.runs_hashed(hashes, window, 11)[at]
        order = np.lexsort((marks, buckets[owner]))
        b, m = buckets[owner][order], marks[order]
        opens = np.append(True, (b[1:] != b[:-1]) | (m[1:] != m[:-1]))
        group = np.cumsum(opens) - 1
        total = np.bincount(group, weights=weights[owner[order]])
        many = np.bincount(group)
        again = np.zeros(len(owner), bool)
        again[order] = total[group] > 1
        # Equal hashes are compared word for word.
        text = lambda i: raw[starts[at[i]] : ends[at[i] + window - 1]]
        firsts = np.flatnonzero(opens)
        for g in np.flatnonzero(many > 1).tolist():
            members = order[firsts[g] : firsts[g] + many[g]].tolist()
            base = text(members[0])
            if any(text(i) != base for i in members[1:]):
                held: dict[bytes, list[int]] = {}
                for i in members:
                    held.setdefault(text(i), []).append(i)
                for same in held.values():
                    again[same] = weights[owner[same]].sum() > 1
        flags = np.split(again, np.cumsum(per)[:-1])
        kept = [i for i, f in enumerate(flags) if f.any()]
        return pa.RecordBatch.from_arrays(
            [pa.array([keys[i] for i in kept], pa.binary()), pa.array([np.packbits(flags[i]).tobytes() for i in kept], pa.binary())],
            names=["key", "flags"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, packed, keys, weights, held = [], [], [], [], 0
        for batch in batches:
            for b, p, k, n in zip(*(batch.column(c).to_pylist() for c in ("bucket", "packed", "key", "n"))):
                if held > W.CHUNK and buckets and b != buckets[-1]:
                    yield judged(np.array(buckets), packed, keys, np.array(weights))
                    buckets, packed, keys, weights, held = [], [], [], [], 0
                buckets.append(b)
                packed.append(p)
                keys.append(k)
                weights.append(n)
                held += len(p)
        if buckets:
            yield judged(np.array(buckets), packed, keys, np.array(weights))

    return run


def _strip(window: int, whole_text: bool):
    """Drop covered words and hash the rest; with ``whole_text`` return the rest itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches):
            removed, shas, texts = [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
                plain = (text or "").encode().split()
                change = np.zeros(len(plain) + 1, np.int64)
                for mark in marks or ():
                    on = np.flatnonzero(np.unpackbits(np.frombuffer(mark["flags"], np.uint8))) + mark["start"]
                    np.add.at(change, on, 1)
                    np.add.at(change, on + window, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = b" ".join(w for w, g in zip(plain, gone.tolist()) if not g)
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).hexdigest())
                if whole_text:
                    texts.append(kept.decode())
            columns = [batch.column("uid"), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
            names = ["uid", "removed", "stripped_sha"]
            if whole_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("stripped")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_passages(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, split_above: int = SPLIT_ABOVE, whole_text: bool = False
) -> DataFrame:
    """One row per row of ``docs``: what is left of its text (see the module's notes).

    With ``whole_text`` a column ``stripped`` holds the remaining words of a text that lost
    some, and null where nothing was removed; ``text_hash`` tells rows of one id apart.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    # The row number is fixed by being written.
    spans = written(
        keyed.mapInArrow(_find_runs(window, gram), _SPANS).withColumn("uid", F.monotonically_increasing_id()), "passage-runs"
    )
    long_enough = spans.where(F.col("n_words") >= window)
    copies = long_enough.groupBy("whole").agg(F.count("*").alias("n"), F.min("uid").alias("speaker")).where("n > 1")
    settled = written(
        long_enough.select("uid", "whole").join(copies, "whole").select("uid", (F.col("uid") == F.col("speaker")).alias("speaks")),
        "passage-copies",
    )
    heard = (
        spans.where(F.size("minis") > 0).join(small_side(settled, settled.count()), "uid", "left")
        .where(F.coalesce("speaks", F.lit(True)))
        .select("uid", F.col("speaks").isNotNull().alias("copied"), F.explode(F.arrays_zip("minis", "spans")).alias("r"))
    )
    runs = heard.select("uid", "copied", F.col("r.minis").alias("mini"), F.col("r.spans").alias("span"))
    # Written, so that the join below shuffles both sides and a minimiser with many runs can be split.
    often = written(runs.groupBy("mini").agg(F.count("*").alias("n")).where("n > 1"), "passage-minimisers")
    surviving = runs.join(often, "mini").groupBy("uid").agg(
        F.max("copied").alias("copied"), F.collect_list(F.struct("mini", "span", "n")).alias("runs")
    )
    named = written(surviving.join(spans.select("uid", "doc_id", "text_hash"), "uid"), "passage-candidates")
    ids = named.select("doc_id", "text_hash").distinct()
    ids = small_side(ids, named.count())
    wanted = keyed.join(ids, _same(keyed, ids), "left_semi")
    texts = written(wanted.join(named, _same(wanted, named)).select("uid", "text", "copied", "runs"), "passage-texts")
    packs = texts.mapInArrow(_cut(window, split_above, True), "bucket long, key binary, packed binary, n long")
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flagged = packs.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_count(window), "key binary, flags binary")
    flagged = flagged.groupBy("key").agg(F.first("flags").alias("flags"))
    places = texts.where("not copied").mapInArrow(_cut(window, split_above, False), "uid long, start int, key binary")
    marks = places.join(flagged, "key").groupBy("uid").agg(F.collect_list(F.struct("start", "flags")).alias("marks"))
    stripped = texts.select("uid", "text").join(marks, "uid").mapInArrow(
        _strip(window, whole_text), "uid long, removed long, stripped_sha string" + ", stripped string" * whole_text
    )
    everything = settled.select(
        "uid", F.lit(None).cast("long").alias("removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("stripped_sha"),
        *([F.lit("").alias("stripped")] if whole_text else []),
    )
    out = spans.select("uid", "doc_id", "text_hash", "n_words", "sha").join(stripped.unionByName(everything), "uid", "left")
    gone = F.when(F.col("stripped_sha").isNull(), F.lit(0)).otherwise(F.coalesce("removed", "n_words"))
    return out.select(
        "doc_id", "n_words", gone.cast("long").alias("n_removed"), F.coalesce("stripped_sha", "sha").alias("kept_sha256"),
        *(["text_hash", "stripped"] if whole_text else []),
    )


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])

"""Exact duplicates, collocations and structure repair: brute force, odd cases, and paths the tables do not reach."""

import collections
import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from graticule.llm import collocations as C
from graticule.llm import exact_dedup, queries
from graticule.llm import structure_repair as S

SF = "/root/testdata/sf0.001"


# --- exact duplicates ---------------------------------------------------------


@pytest.fixture(scope="module")
def copies(spark):
    rows = [
        (1, "a"), (5, "a"), (None, "a"), (2, None), (3, ""), (4, "A"), (7, "b"), (7, "b"), (7, "b"), (None, "c"), (None, "c"), (8, "x" * 300_000), (9, "x" * 300_000),
        (10, "x" * 299_999 + "y"), (11, "c "), (12, "alone"),
    ]
    return spark.createDataFrame([(*r, "h", 1, 2, "k", 3) for r in rows], "doc_id long, text string, h string, n int, row int, keep_id string, id int")


def by_row(rows):
    return sorted(rows, key=str)


def told(found):
    return by_row((-1 if r["doc_id"] is None else r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in found)


EXPECTED = [
    (-1, 5, 3, False), (-1, None, 2, False), (-1, None, 2, True), (1, 5, 3, False), (2, 3, 2, False), (3, 3, 2, True), (4, 4, 1, True), (5, 5, 3, True),
    (7, 7, 3, False), (7, 7, 3, False), (7, 7, 3, True), (8, 9, 2, False), (9, 9, 2, True), (10, 10, 1, True), (11, 11, 1, True), (12, 12, 1, True),
]


def test_equal_texts_of_odd_rows(copies):
    found = exact_dedup.exact_duplicates(copies)
    assert told(found.collect()) == by_row(EXPECTED)
    assert found.where("doc_id = 2").first()["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert found.columns[:2] == ["doc_id", "h"] and exact_dedup.exact_duplicates(copies.where("false")).count() == 0


@pytest.mark.parametrize("digest", [lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit("same")])
def test_colliding_hashes_are_told_apart_by_their_bytes(copies, digest):
    assert told(exact_dedup.exact_duplicates(copies, digest=digest).collect()) == by_row(EXPECTED)


def test_full_bit_table_and_smallest_id(copies):
    assert told(exact_dedup.exact_duplicates(copies, filter_longs=1).collect()) == by_row(EXPECTED)
    least = exact_dedup.exact_duplicates(copies, largest=False, normalise=F.lower)
    assert {(r["doc_id"], r["keep_id"]) for r in least.collect() if r["kept"] and r["group_size"] > 2} == {(1, 1), (7, 7)}


def test_large_groups_are_broadcast_and_small_ones_joined(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 1700).cast("string")).alias("text"))
    found = exact_dedup.exact_duplicates(rows)
    want = rows.groupBy("text").agg(F.max("doc_id").alias("keep"), F.count("*").alias("n"))
    right = found.join(rows.join(want, "text"), "doc_id").where("keep_id = keep and group_size = n and kept = (doc_id = keep)").count()
    assert right == 5000 and found.where("group_size > 1000").count() == 1667


# --- collocations -------------------------------------------------------------


def brute_collocations(rows, support, best):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            ws = tuple(w for w in re.split("[ \t]", piece) if w)
            n[lang] += len(ws)
            for m in range(1, 6):
                for i in range(len(ws) - m + 1):
                    f[lang, ws[i : i + m]] += 1
    out = collections.defaultdict(list)
    frequent = {k: a for k, a in f.items() if a >= support and len(k[1]) > 1}
    for (lang, ph), a in frequent.items():
        inside = any(
            a2 >= a and l2 == lang and len(p2) > len(ph) and any(p2[i : i + len(ph)] == ph for i in range(len(p2) - len(ph) + 1))
            for (l2, p2), a2 in frequent.items()
        )
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, ph[:k]] * f[lang, ph[k:]]), k, f[lang, ph[:k]], f[lang, ph[k:]]) for k in range(1, len(ph))]
            score, _, l, r = min(cuts)
            out[lang].append((-score, -a, " ".join(ph).encode(), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:best])
    )


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["New", "york", "city", "the", "OF", "é", "ÉÉ", "a", "state#", "x-y", "of\tthe", "of  the"]
    ends = [".", ",", "\n", " ! ", "\r\n", "", " ", "\x0b", "?new york"]
    rows = [("".join(" ".join(rnd.choices(words, k=rnd.randint(0, 9))) + rnd.choice(ends) for _ in range(rnd.randint(0, 12))), rnd.choice(["en", "de", None, "und"])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), (" \t\n", "fr"), ("one. one", "xx"), ("New York city " * 400, "en")] + rows[:3]


@pytest.mark.parametrize("shard", [1, 1 << 22])
def test_collocations_against_brute_force(spark, texts, shard, monkeypatch):
    monkeypatch.setattr(C.W, "CHUNK", 500)
    df = spark.createDataFrame([(*t, 1, "p") for t in texts], "text string, lang string, total int, phrase string").repartition(4)
    found = sorted(tuple(r) for r in C.collocations(df, best=40, support=12, shard_bytes=shard, filter_bits=1 << 12).collect())
    assert found == brute_collocations(texts, 12, 40) and len(found) > 60


def test_local_support_follows_the_share_of_a_shard(spark, texts, monkeypatch):
    """Small shards report every phrase, large ones only what exceeds half of their share; both find all frequent ones."""
    df = spark.createDataFrame(texts, "text string, lang string").coalesce(1)
    reported = {}
    for chunk in (100, 1 << 20):
        monkeypatch.setattr(C.W, "CHUNK", chunk)
        one = df.withColumn("lang", F.lit("en")).withColumn("total", F.lit(5000))
        reported[chunk] = C._mined(one, [None], (2, 2), 40, chunk).count()
        assert sorted(tuple(r) for r in C.collocations(df, best=40, support=5, shard_bytes=chunk).collect()) == brute_collocations(texts, 5, 40)
    assert reported[1 << 20] <= reported[100]


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([("a b. " * 30, "en")], "text string, lang string")
    every, totals = C.frequent_phrases(df, support=10)
    big = spark.sql(
        "select (cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as s "
        "from values (9000000000000, 900000000000000, 9000000000001, 9000000000003) as t(a, n, l, r)"
    ).first()["s"]
    assert big == 1000 * 9000000000000 * 900000000000000 // (9000000000001 * 9000000000003)
    assert sorted((r["phrase"], r["n"]) for r in every.collect()) == [("a", 30), ("a b", 30), ("b", 30)] and totals.first()["total"] == 60


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(df).count() == 0


# --- structure repair ---------------------------------------------------------


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        v = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if v == 1 else re.sub("[.!?]", "", text) if v == 2 else text
        if v:
            out += [(conv, turn, "user" if v == 4 else role, text)] * (2 if v == 3 else 1)
    return out


def cheapest(rows):
    """Faults and repair of one conversation, by Dijkstra over (row, last role) in order of (cost, edits)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, edits, i, last, turns = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            break
        if (i, last) in done:
            continue
        done.add((i, last))
        follow = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for role in ("user", "assistant"):
            if role[0] in follow:
                heapq.heappush(heap, (cost + 3, edits + "I", i, role[0], (*turns, (role, ""))))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, last, turns))
            if faults[i] not in ("b", "d"):
                cost += 3 * (faults[i] == "t")
                if role[:1] and role[0] in follow:
                    heapq.heappush(heap, (cost, edits + "K", i + 1, role[0], (*turns, (role, text))))
                for new in ("user", "assistant"):
                    if new[0] in follow:
                        heapq.heappush(heap, (cost + 3, edits + "R", i + 1, new[0], (*turns, (new, text))))
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    lines = "\n".join(f"{r}:{t}" for r, t in turns)
    return (gaps, *[faults.count(x) for x in "bdt"], sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256(lines.encode()).hexdigest()), turns


def audited(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r[0]]
    for r in damage(rows):
        by[r[0]].append(r)
    return sorted(((k, *cheapest(v)[0]) for k, v in by.items()), key=str)


def test_repairs_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_structure_repair(spark, SF).collect()), key=str) == audited(rows)


def test_search_against_brute_force():
    rnd = random.Random(3)
    roles = ["system", "user", "assistant", "tool", "user", "assistant", ""]
    for _ in range(1500):
        rows = [(1, i, rnd.choice(roles), rnd.choice(["x.", "y", "z!", " ", "w?", "a", "b.\n", ""])) for i in range(rnd.randint(0, 9))]
        s, seen = S.Stretch(), set()
        for _, i, role, text in rows:
            s.add(i, role, text, 1, (role, text) in seen)
            seen.add((role, text))
        cost, edits, state = S.search(s.live, 0, S.LAST)
        edits, turns = s.repaired(edits, 0)
        more, added = S.ending(state)
        want, repaired = cheapest(rows)
        assert (cost + 4 * sum(s.gone), edits + more, tuple(turns + added)) == (want[5], want[6], repaired)
        assert S.lower_bounds(s.live)[0] <= cost


def odd_turns():
    rnd = random.Random(9)
    rows = [(7, i if i % 11 else None, rnd.choice(["user", "assistant", "system", "tool", None]), rnd.choice([f"t{i}.", f"t{i}", "ok.", " ", None, "same"])) for i in range(700)]
    rows += [(i % 20, i, rnd.choice(["user", "assistant"]), rnd.choice(["hm.", f"q{i}?", " "])) for i in range(160)]
    return rows + rows[:90] + [(None, 1, "user", "x."), (None, None, None, None), (99, None, "system", "long " * 50_000 + "end.")]


@pytest.mark.parametrize("stretch", [64, 2])
def test_long_conversations_are_repaired_in_stretches(spark, stretch):
    df = spark.createDataFrame([(*r, "c", 1) for r in odd_turns()], "conv_id long, turn long, role string, text string, conv string, seq int")
    assert sorted((tuple(r) for r in S.audit(df, S.damaged(df), stretch).collect()), key=str) == audited(odd_turns())


def test_repaired_turns(spark):
    df = spark.createDataFrame(odd_turns(), "conv_id long, turn long, role string, text string")
    held = collections.defaultdict(list)
    for r in S.repair(S.damaged(df)).orderBy("part").collect():
        held[r["conv_id"]] += [tuple(t) for t in r["turns"]]
    by = collections.defaultdict(list)
    for r in damage(odd_turns()):
        by[r[0]].append(r)
    assert dict(held) == {k: list(cheapest(v)[1]) for k, v in by.items()}


def test_conversations_without_rows(spark):
    df = spark.createDataFrame([(1, 1, "user", "x.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in S.audit(df, df.where("false")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert S.audit(df.where("false"), df.where("false")).count() == 0 and S.repair(df.where("false")).count() == 0

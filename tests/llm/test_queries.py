"""Registered queries against their SQL, or against brute force where SQL cannot express them."""

import collections
import functools
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from checking import compare, connect
from pyspark.sql import functions as F

import corpus_pipeline
from graticule.llm import chat_format, encoding, oracles, queries, source_mixing, token_counts, url_filter
from graticule.llm import words as W
from graticule.llm.encoding import WordEncoder, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def docs(con):
    return con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()


@pytest.mark.parametrize("name", oracles.oracle_sql())
def test_against_sql(spark, con, name):
    assert compare(getattr(queries, name)(spark, SF), con, oracles.oracle_sql()[name]) is None


def test_every_operator_has_one_query():
    names = [q.__name__ for q in queries.QUERIES]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check_packing(found, texts, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    wanted = {}
    for i, text in texts:
        ids = ids_of(tokenizer, text)
        for at in range(0, len(ids), capacity):
            wanted[i, at // capacity] = (at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in found} == wanted
    by = collections.defaultdict(list)
    for r in found:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(by) <= 1.06 * math.ceil(sum(w[1] for w in wanted.values()) / capacity)


def test_packing(spark, con):
    check_packing(queries.op8_best_fit_packing(spark, SF).collect(), [(r[0], r[1]) for r in docs(con)])


def test_encoder_on_odd_texts():
    encoder = WordEncoder(tokenizer_path())
    odd = ["É l'été it's 'S <|endoftext|> a<|startoftext|>b ª º µm ÿ×÷ İstanbul ΑΣ. K ﬁ é ́x a.b, .,.! ", "\t a b c\x0bd\x1ce", "ÀÉÎõü.. ß! x²  3,5 --", "", " \n", None]
    wanted = [np.array(encoder.encoder.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes() for text in odd]
    assert encoder.encode(odd) == wanted


@pytest.mark.parametrize("known", [2, 10_000])
@pytest.mark.parametrize("collide", [False, True])
def test_ids_of_whole_columns(monkeypatch, known, collide):
    """A full store, and words whose hashes are equal, change nothing."""
    monkeypatch.setattr(encoding, "KNOWN", known)
    if collide:
        found = W.words_in
        monkeypatch.setattr(W, "words_in", lambda data, offs: (lambda s, e, h, f: (s, e, h & np.uint64(1), f))(*found(data, offs)))
    encoder = WordEncoder(tokenizer_path())
    for texts in (["a b  c", None, "", "É l'été\tit's\x0bA.\r\nb, b,"], ["new words a", "x" * 70_000 + " x"], [], [None]):
        ids, bounds = encoder.columns(pa.array(texts, pa.string()))
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [encoder.encoder.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_short_conversations_against_all_repairs(spark):
    """Every role sequence of up to four turns; repairs are enumerated without the operator's tables."""
    roles = ("system", "user", "assistant", "tool")
    given = [c for n in range(1, 5) for c in itertools.product(roles, repeat=n)]
    legal = [s + "ua" * k for s in ("", "s") for k in range(1, 7)]

    def holds(whole, part):
        rest = iter(whole)
        return all(x in rest for x in part)

    @functools.cache
    def missing(opened):
        return min(len(x) - len(opened) for x in legal if holds(x, opened)) if any(holds(x, opened) for x in legal) else 1 << 30

    price = chat_format.PRICES

    def cheapest(turns):
        best = 1 << 30
        for new in itertools.product(roles[:3], repeat=len(turns)):
            cost = sum(0 if a == b else price["unknown"] if a == "tool" else price["relabel"] for a, b in zip(turns, new))
            for merged in itertools.product((False, True), repeat=len(turns)):
                if any(m and (not i or new[i] != new[i - 1]) for i, m in enumerate(merged)):
                    continue
                opened = "".join(r[0] for r, m in zip(new, merged) if not m)
                best = min(best, cost + price["merge"] * sum(merged) + price["insert"] * missing(opened))
        return best

    rows = [(i, k, role, "x") for i, turns in enumerate(given) for k, role in enumerate(turns)]
    by = collections.defaultdict(list)
    for r in chat_format.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        by[r["conv_id"]].append(r)
    for i, turns in enumerate(given):
        found = sorted(by[i], key=lambda r: r["seq"])
        rendered = "".join(x[0] for x in re.findall(r"<\|(\w+)\|>", "".join(r["rendered"] for r in found)) if x != "end")
        assert rendered in legal
        merges = sum("merge" in r["action"] for r in found)
        relabels = sum(price["unknown"] if r["role"] == "tool" else price["relabel"] for r in found if "relabel" in r["action"])
        total = relabels + price["merge"] * merges + price["insert"] * (len(rendered) - len(found) + merges)
        assert total == cheapest(turns), turns


def test_tied_turns_are_rendered_alike_however_dealt_out(spark):
    rows = [(1, 5, "user", f"{'same beginning ' * 30 if k % 2 else ''}{k * 7919 % 400}") for k in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    old, texts = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            texts.append("".join(r["rendered"] for r in sorted(chat_format.repair(turns).collect(), key=lambda r: r["seq"])))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert texts[0] == texts[1]
    assert [x.removesuffix("<|end|>") for x in texts[0].split("\n") if x[:1].isdigit() or x[:4] == "same"] == sorted(r[3] for r in rows)


def test_very_many_phrases_in_one_text(spark):
    text = "cc by " * 80_000 + "x All rights reserved"
    found = queries.license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"]) == (160_004, 80_001, 0, 160_001)


def test_role_repair_is_cheapest_and_legal(spark, con, monkeypatch):
    monkeypatch.setattr(chat_format, "STRETCH", 16)
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    rows += [(-5, k, "user" if k % 7 else "assistant", f"x{k}") for k in range(200)] + [(-7, 0, "tool", "t"), (-8, 0, "system", "s")]
    found = chat_format.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    cost, _, _, last = chat_format.moves()
    by = collections.defaultdict(list)
    for r in found:
        by[r["conv_id"]].append(r)
    for turns in by.values():
        turns.sort(key=lambda r: r["seq"])
        f, s, total = [0] + [1 << 40] * 3, 0, 0
        for r in turns:
            m = cost[r["role"] if r["role"] in chat_format.STATES[1:] else None]
            f = [min(f[i] + int(m[i, j]) for i in range(4)) for j in range(4)]
            o = chat_format.STATES.index(r["new_role"])
            total, s = total + int(m[s, o]), o
        assert total + int(last[s]) == min(f[i] + int(last[i]) for i in range(4))
        text = "".join(r["rendered"] for r in turns)
        roles = "".join(x[0] for x in re.findall(r"<\|(\w+)\|>", text) if x != "end")
        assert re.fullmatch(r"s?(ua)+", roles) and text.count("<|end|>") == len(roles)


def test_url_scores(spark):
    df = queries.table(spark, SF, "pages")
    found = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    held = {
        r["page_id"]: r for r in url_filter.located(df).withColumn("h", F.pmod(F.xxhash64("host", "path"), F.lit(url_filter.HELD_OUT)) == 0).collect()
    }
    k = url_filter.ORDER
    grams = {"allow": collections.Counter(), "block": collections.Counter()}
    padded = {i: "\x02" * k + r["host"] + r["path"] + "\x03" for i, r in held.items()}
    for i, r in held.items():
        if found[i]["rule"] and not r["h"]:
            for at in range(k, len(padded[i])):
                for j in range(k + 1):
                    grams[found[i]["verdict"]][padded[i][at - j : at + 1]] += 1
    total, kinds = {c: collections.Counter() for c in grams}, {c: collections.Counter() for c in grams}
    for c, seen in grams.items():
        for g, n in seen.items():
            total[c][g[:-1]] += n
            kinds[c][g[:-1]] += 1

    def p(c, s, at):
        out = 1 / 256
        for j in range(k + 1):
            x = s[at - j : at]
            if total[c][x]:
                out = (grams[c][s[at - j : at + 1]] + kinds[c][x] * out) / (total[c][x] + kinds[c][x])
        return out

    for i, r in found.items():
        if r["score"] is not None:
            s = padded[i]
            z = sum(math.log(p("allow", s, at) / p("block", s, at)) for at in range(k, len(s))) / (len(s) - k)
            assert r["score"] == pytest.approx(z, abs=2e-6)


def test_mixture_budgets_and_prefixes(spark):
    df = queries.table(spark, SF, "documents")
    drawn = source_mixing.mix(df).collect()
    rows = df.select("doc_id", F.xxhash64("text").alias("th"), source_mixing.domain_of(F.col("source")).alias("d"), "lang", "source", source_mixing.word_count(F.col("text")).alias("n")).collect()
    holds = collections.Counter()
    for r in rows:
        holds[r["d"], r["lang"], r["source"]] += 2 * r["n"]

    def shared(children, budget):
        out, left = {}, dict(children)
        while left:
            weight = sum(w for _, w in left.values())
            full = [c for c, (h, w) in left.items() if h <= budget * w / weight]
            if not full:
                return out | {c: budget * w / weight for c, (_, w) in left.items()}
            for c in full:
                out[c] = left.pop(c)[0]
                budget -= out[c]
        return out

    def down(path, budget):
        if len(path) == 3:
            return {path: budget}
        below = collections.Counter()
        for leaf, n in holds.items():
            if leaf[: len(path)] == path:
                below[leaf[: len(path) + 1]] += n
        out = {}
        for c, b in shared({c: (n, source_mixing.WEIGHTS.get(c, 1.0)) for c, n in below.items()}, budget).items():
            out |= down(c, b)
        return out

    used = collections.Counter()
    for r in drawn:
        used[r["domain"], r["lang"], r["source"]] += r["n_tokens"]
    budget = down((), sum(r["n"] for r in rows) * source_mixing.BUDGET_SHARE)
    largest = collections.Counter()
    for r in rows:
        largest[r["d"], r["lang"], r["source"]] = max(largest[r["d"], r["lang"], r["source"]], r["n"])
    for leaf, b in budget.items():
        assert b - largest[leaf] - 1 <= used[leaf] <= b + 1
    uses = collections.Counter(r["doc_id"] for r in drawn)
    assert max(uses.values()) <= 2 and all(len({r["epoch"] for r in drawn if r["doc_id"] == i}) == n for i, n in uses.most_common(5))


def test_token_counts(spark, con):
    counter = token_counts.ByteCounter(token_counts.rank_path())
    found = {r["doc_id"]: r for r in queries.op10_token_counts(spark, SF).collect()}
    count = lambda x: len(counter.encoder.encode_ordinary(x))
    for i, text, *_ in docs(con):
        masked = re.sub(token_counts.PRIVATE, token_counts.MARK, text or "")
        assert (found[i]["n_before"], found[i]["n_after"]) == (count(text or ""), count(masked))


def test_edits_equal_a_new_count():
    rng, counter = np.random.default_rng(3), token_counts.ByteCounter(token_counts.rank_path())
    for _ in range(300):
        text = "".join(rng.choice([" ", "\n", "a", "'", "s", "1", ".", "é", "  "], rng.integers(0, 200)))
        leaf = int(rng.choice([2, 4, 64]))
        tree = token_counts.grow(text, counter, leaf)
        for _ in range(4):
            new = str(rng.choice(["", "x", "  ", "\n\n", "'s", "12", "word and more"]))
            text, _ = token_counts.apply_edit(text, tree, int(rng.integers(-1, len(text) + 2)), int(rng.choice([0, 1, 30])), new, counter, leaf)
            assert tree.total == len(counter.encoder.encode_ordinary(text))
            for low, high in zip(tree.levels, tree.levels[1:]):
                assert high == [sum(low[i : i + 2]) for i in range(0, len(low), 2)]


def test_pipeline(spark, con):
    found = corpus_pipeline.run(spark, SF).collect()
    docs_left = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in queries.op1_quality_rules(spark, SF).where("kept").select("doc_id").collect()}
    drawn = {r["doc_id"] for r in found}
    assert drawn and drawn <= kept
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs_left = stage(spark, docs_left, SF)
    texts = [(r["doc_id"], r["text"]) for r in docs_left.collect()]
    assert {i for i, _ in texts} == drawn
    check_packing(found, texts)

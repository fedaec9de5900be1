"""Phrase collocations by SON partitioning: shards are mined whole, then candidates are counted exactly.

A phrase that occurs ``support`` times in a language occurs at least ``support * w`` times in
some shard that holds a share ``w`` of the language's words. So:

1. Words are counted exactly per language; rarer ones than ``support`` cannot be part of
   a phrase (a phrase is at most as frequent as its parts).
2. Each shard (texts of about ``SHARD_BYTES`` that follow each other in a task) is mined
   completely: every phrase is locally frequent whose count exceeds half of the support
   lowered to the shard's share of the language. Longer phrases grow only from locally frequent
   shorter ones. A shard reports a hash of the phrase and by how much it exceeds that
   half; as the halves add up to ``support / 2`` over all shards, a phrase can be frequent only if
   its reported excesses add up to the other half. These are the candidates.
3. All candidates are counted in all texts: each shard adds up its own, the sums are
   grouped by language and phrase as written, and those below ``support`` go.

2 and 3 are done for phrases of two words, then for longer ones, which must consist of
frequent pairs. The more shards, the lower the local support: from ``support / 2`` shards on
every phrase of a shard is reported, and what is moved grows in proportion to the texts.

What tasks are told about words, pairs and candidates is a bit table of fixed size: it may
let a phrase through that is none, which is then counted and dropped, and never the reverse.
Counts and scores are exact: word numbers inside a shard are combined without loss, totals
are grouped by the phrase itself, products are decimals of 38 digits. Inside a shard words
are told apart by 64-bit hashes.

Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line breaks into pieces, and those at spaces
and tabs into words; phrases stay within pieces. A null text is empty, a null language is
``und``. A text longer than a shard is a shard of its own. Ties of the ranking go to the larger
count, then to the smaller phrase in byte order. Repeated rows count as often as they
stand; ids and further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm import words as W
from graticule.session import small_side, written

SUPPORT = 100
LONGEST = 5
BEST = 2000
# Text mined as one shard; its arrays take about thirty times as much.
SHARD_BYTES = 1 << 20
# Four megabytes on the driver, and twice that in each Python worker.
FILTER_BITS = 1 << 25
RANK_SHARES = 128

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[list(b".,;:!?")] = 10
_CUTS = np.zeros(256, bool)
_CUTS[[0x0A, 0x0B, 0x0C, 0x0D]] = True
_TIMES = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 63, LONGEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PHRASES = "lang string, phrase string, n long"


class Shard:
    """The words of some texts: number of each word in the shard's vocabulary, language, and whether it opens a piece."""

    def __init__(self, parts: list[tuple]):
        """``parts`` are chunks of texts: hashes and spelling of their words, numbers into these, openings, and (language, words) runs."""
        hashes = np.concatenate([p[0] for p in parts])
        number, self.vocabulary_hashes, first = numbered(hashes)
        self.vocabulary = pa.concat_arrays([p[1] for p in parts]).take(pa.array(first)).cast(pa.string())
        base = np.cumsum([0, *[len(p[0]) for p in parts]])
        self.word = np.concatenate([number[b + p[2]] for b, p in zip(base, parts)])
        self.opens = np.concatenate([p[3] for p in parts])
        runs = [r for p in parts for r in p[4]]
        self.langs = sorted({lang for lang, _ in runs})
        code = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.repeat(np.array([code[lang] for lang, _ in runs], np.int32), [n for _, n in runs])
        self.salts = W.mix(np.array([hash_of(lang) for lang in self.langs], np.uint64))
        self.sizes = np.bincount(self.lang, minlength=len(self.langs))

    def spelled(self, at: np.ndarray) -> pa.Array:
        """Words at these places."""
        return self.vocabulary.take(pa.array(self.word[at]))

    def hashed(self, start: np.ndarray, width: int) -> np.ndarray:
        """Hash of the phrase of ``width`` words at each start, equal in every shard."""
        out = self.salts[self.lang[start]]
        for j in range(width):
            out += self.vocabulary_hashes[self.word[start + j]] * _TIMES[j]
        return W.mix(out)


def hash_of(lang: str) -> int:
    value = 1469598103934665603
    for b in lang.encode():
        value = ((value ^ b) * 1099511628211) & ((1 << 64) - 1)
    return value


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[Shard, dict[str, int]]]:
    """Shards of about ``size`` bytes of ``(text, lang, total)``, with each language's words in all texts."""
    parts, held, totals = [], 0, {}
    for batch in W.chunks(batches):
        data, offs = W.texts_of(batch.column("text"))
        names = batch.column("lang").to_pylist()
        if batch.schema.get_field_index("total") >= 0:
            totals.update(zip(names, batch.column("total").to_pylist()))
        part = _part(data, offs, names)
        if part:
            parts.append(part)
        held += len(data)
        if held >= size and parts:
            yield Shard(parts), totals
            parts, held = [], 0
    if parts:
        yield Shard(parts), totals


def _part(data: np.ndarray, offs: np.ndarray, names: list[str]) -> tuple | None:
    """One chunk of texts for a shard: only its distinct words are kept as text."""
    plain = _PLAIN[data]
    starts, ends, hashes, first = W.words_in(plain, offs, lower=True)
    if not len(starts):
        return None
    # The first word behind a cut or at the start of a text opens a piece.
    opens = np.zeros(len(starts) + 1, bool)
    opens[np.searchsorted(starts, np.flatnonzero(_CUTS[plain]))] = True
    opens[first] = True
    number, distinct, at = numbered(hashes)
    sizes = ends[at] - starts[at]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    spelled = W.folded(plain[np.arange(offsets[-1]) + np.repeat(starts[at] - offsets[:-1], sizes)])
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(spelled)])
    # Runs of texts of one language.
    edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
    runs = [(names[a], int(first[b] - first[a])) for a, b in zip(edges, edges[1:])]
    return distinct, words, number, opens[:-1], [r for r in runs if r[1]]


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each key by first appearance, the distinct keys and where they first stand."""
    found = pa.array(keys).dictionary_encode()
    number = found.indices.to_numpy()
    most = np.maximum.accumulate(number) if len(number) else number
    return number, found.dictionary.to_numpy(), np.flatnonzero(np.diff(most, prepend=-1))


def groups(start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct keys: number at each start, first start and how often each stands."""
    number, distinct, first = numbered(key)
    return number, start[first], np.bincount(number, minlength=len(distinct))


def grown(shard: Shard, allowed: list[np.ndarray | None], longest: int, keep) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(width, some start, count)`` of the shard's distinct phrases, width by width.

    ``allowed[w]`` is a bit table that all parts of ``w`` words must be in (None: no such test);
    ``keep(width, first, count)`` says which phrases may grow further.
    """
    n = len(shard.word)
    start = np.arange(n, dtype=np.int32)
    number, first, count = groups(start, shard.lang.astype(np.int64) << 32 | shard.word)
    for width in range(1, longest + 1):
        if width > 1:
            # Both parts of width - 1 words live on, and the new word goes on the piece.
            number_at = np.full(n, -1, np.int32)
            number_at[start] = number
            going = start[start + width - 1 < n]
            start = going[(number_at[going + 1] >= 0) & ~shard.opens[going + width - 1]]
            if not len(start):
                return
            # The parts at a start and one word further on fix the phrase.
            number, first, count = groups(start, number_at[start].astype(np.int64) << 32 | number_at[start + 1])
        held = np.ones(len(first), bool)
        if width < len(allowed) and allowed[width] is not None:
            held &= contains(allowed[width], shard.hashed(first, width))
        held &= keep(width, first, count)
        if not held.any():
            return
        yield width, first[held], count[held]
        renumber = np.cumsum(held, dtype=np.int32) - 1
        inside = held[number]
        start, number = start[inside], renumber[number[inside]]


def contains(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    p = hashes % np.uint64(64 * len(table))
    return (table[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


def bit_table(hashes: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A table with one bit set for each ``h``: of fixed size, filled from at most ``bits / 64`` rows."""

    def bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_numpy().view(np.uint64) % np.uint64(bits)
            at, number = np.unique(p >> np.uint64(6), return_inverse=True)
            out = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(out, number, np.uint64(1) << (p & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(out.view(np.int64))], ["at", "bits"])

    found = hashes.select("h").mapInArrow(bits_of, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return table


def hashes_of(phrases: DataFrame) -> DataFrame:
    """``h`` of each (lang, phrase), as shards compute it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, hashes, first = W.words_in(*W.texts_of(batch.column("phrase")))
            langs = batch.column("lang").dictionary_encode()
            salts = W.mix(np.array([hash_of(lang) for lang in langs.dictionary.to_pylist()], np.uint64))
            out, widths = salts[langs.indices.to_numpy()], np.diff(first)
            for j in range(LONGEST):
                more = np.flatnonzero(widths > j)
                out[more] += hashes[first[more] + j] * _TIMES[j]
            yield pa.RecordBatch.from_arrays([pa.array(W.mix(out).view(np.int64))], ["h"])

    return phrases.select("lang", "phrase").mapInArrow(run, "h long")


def _counted(texts: DataFrame, allowed: list, widths: tuple[int, int], known: np.ndarray | None, size: int) -> DataFrame:
    """Exact counts of all phrases of these widths that ``known`` holds (all when None)."""
    low, high = widths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, _ in shards(batches, size):

            def keep(width, first, count):
                if width < low or known is None:
                    return np.ones(len(first), bool)
                return contains(known, shard.hashed(first, width))

            for width, first, count in grown(shard, allowed, high, keep):
                if width >= low:
                    phrase = shard.spelled(first)
                    for j in range(1, width):
                        phrase = pc.binary_join_element_wise(phrase, shard.spelled(first + j), " ")
                    lang = pa.array(shard.langs, pa.string()).take(pa.array(shard.lang[first]))
                    yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(count, pa.int64())], ["lang", "phrase", "n"])

    return texts.mapInArrow(run, PHRASES).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _mined(texts: DataFrame, allowed: list, widths: tuple[int, int], support: int, size: int) -> DataFrame:
    """``h`` of the phrases that can be frequent by what all shards report of them."""
    low, high = widths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, totals in shards(batches, size):
            half = (support * shard.sizes) // (2 * np.array([totals[lang] for lang in shard.langs]))

            def keep(width, first, count):
                return count > half[shard.lang[first]]

            for width, first, count in grown(shard, allowed, high, keep):
                if width >= low:
                    excess = count - half[shard.lang[first]]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.hashed(first, width).view(np.int64)), pa.array(excess, pa.int64())], ["h", "excess"])

    return texts.mapInArrow(run, "h long, excess long").groupBy("h").agg(F.sum("excess").alias("excess")).where(F.col("excess") * 2 >= support)


def frequent_phrases(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS
) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, n)`` of all phrases of up to ``longest`` words that stand ``support`` times in a language; ``(lang, total)`` words."""
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases of 1 to {LONGEST} words")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    words = written(_counted(texts, [None], (1, 1), None, shard_bytes), "phrase-words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("total")), "phrase-totals")
    found = [written(words.where(F.col("n") >= support), "phrase-frequent")]
    texts = texts.join(small_side(totals, totals.count()), "lang", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    for low, high in [(2, 2), (3, longest)]:
        if low > longest:
            break
        allowed = [*[None] * (low - 1), bit_table(hashes_of(found[-1]), filter_bits)]
        known = bit_table(_mined(texts, allowed, (low, high), support, shard_bytes), filter_bits)
        found.append(written(_counted(texts, allowed, (low, high), known, shard_bytes).where(F.col("n") >= support), "phrase-frequent"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def collocations(docs: DataFrame, best: int = BEST, support: int = SUPPORT, **options) -> DataFrame:
    """The ``best`` phrases of each language by their weakest cut (see the module's notes)."""
    every, totals = frequent_phrases(docs, support, **options)
    phrases = every.select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w")).where("size(w) > 1")
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    # A phrase inside a longer one that stands as often: the one word longer it lies in is frequent too.
    inner = phrases.where("size(w) > 2").select(
        "lang", "a", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w") - 1))).alias("phrase")
    ).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.size("w") - F.col("k"))})
    of = lambda name, n: every.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(totals, "lang").selectExpr(
        "lang", "phrase", "a", "k", "l", "r", "total as n",
        "(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(total as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as score",
    )
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    kept = weakest.join(inner, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a")
    # The best of each share of a language first, so that at most RANK_SHARES * best rows of it meet in one task.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shared = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SHARES)))
    some = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )

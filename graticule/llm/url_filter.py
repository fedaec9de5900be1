"""URL verdicts: host and path rules, and for the rest a ratio of two character models.

Rules come first (longest wins). Their verdicts are also the labels that train two
smoothed variable-order Markov models, one of allowed and one of blocked URLs. A
character's probability after a context of ``order`` characters is blended with that after
the shorter context, weighted by how many different characters have followed it
(``(n + t * shorter) / (total + t)``); an unseen context passes the shorter one on.

A URL's score is the difference of the log-likelihoods over its characters, divided by
their number. The cut is calibrated on labelled URLs kept out of training (a fifth, by
hash): the one with the largest sum of both hit rates.

The models are counted on distinct grams: occurrences are counted once, all shorter
contexts follow from those counts, and the log ratio is worked out once per gram. URLs
then only look up and add. All counts cover the whole table; joins on a common gram are
skewed on one side only, which adaptive execution splits.

Rows: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``score`` (null where a rule
decides). A null URL, or one without ``://``, has an empty host and path; it and others
with nothing to score are allowed. Rows are judged one by one, so repeated and null ids
are fine. Without labels of both kinds the cut is 0 and the models are flat, which allows.
An empty table gives an empty result; further columns are ignored. Built-in functions
only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.license_scan import lowered
from graticule.session import written

ORDER = 4
ALPHABET = 256.0
HELD_OUT = 5
BIN = 0.01
BINS = 2000

#: (host, path, verdict); a rule fits its host and all subdomains where the path starts with its path.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_START, _END = "\u0002", "\u0003"

def located(pages: DataFrame) -> DataFrame:
    """``page_id, host, path`` of every row."""
    url = F.coalesce("url", F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.select(
        F.col("page_id"), lowered(F.regexp_extract(url, pattern, 1)).alias("host"), F.regexp_extract(url, pattern, 2).alias("path")
    )

def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest fitting rule, nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict

def _grams(df: DataFrame, *keep: str, order: int) -> DataFrame:
    """One row per character, with its context before it."""
    letters = F.split(F.concat(F.lit(_START * order), F.col("host"), F.col("path"), F.lit(_END)), "")
    letters = F.filter(letters, lambda c: c != "")
    return df.select(*keep, letters.alias("c")).select(
        *keep, F.explode(F.transform(F.sequence(F.lit(1), F.size("c") - order), lambda i: F.array_join(F.slice("c", i, order + 1), ""))).alias("g")
    )

def gram_ratios(held: DataFrame, order: int = ORDER) -> DataFrame:
    """``g, ratio``: log of allowed over blocked probability of each gram's last character after the others."""
    training = ~F.col("held_out") & F.col("verdict").isNotNull()
    flagged = held.where(training).select("host", "path", (F.col("verdict") == "allow").cast("long").alias("allow"))
    counts = _grams(flagged, "allow", order=order).groupBy("g").agg(
        F.sum("allow").alias("a"), F.sum(1 - F.col("allow")).alias("b")
    )
    seen = _grams(held.where("verdict is null or held_out"), order=order).select("g").distinct()
    grams = written(seen.join(counts, "g", "full").select("g", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")), "url-grams")
    # Suffixes of 1 .. order + 1 characters; their counts follow from the longest ones.
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.struct(k.alias("k"), F.expr("g").alias("g")))
    cut = grams.select("g", "a", "b", F.explode(suffixes).alias("s")).select(
        "g", "a", "b", F.col("s.k").alias("k"), F.substring("g", order + 2 - F.col("s.k"), F.col("s.k")).alias("suffix")
    )
    counted = cut.groupBy("k", "suffix").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counted = counted.withColumn("context", F.substring("suffix", F.lit(1), F.col("k") - 1))
    contexts = counted.groupBy("k", "context").agg(
        F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.sum((F.col("a") > 0).cast("long")).alias("da"),
        F.sum((F.col("b") > 0).cast("long")).alias("db"),
    )
    stats = written(counted.join(contexts, ["k", "context"]).select("k", "suffix", "a", "b", "ta", "tb", "da", "db"), "url-suffixes")
    lines = cut.select("g", "k", "suffix").join(stats, ["k", "suffix"]).groupBy("g").agg(
        F.array_sort(F.collect_list(F.struct("k", "a", "b", "ta", "tb", "da", "db"))).alias("line")
    )

    def blend(n: str, t: str, d: str):
        return lambda p, s: F.when(s[t] == 0, p).otherwise((s[n] + s[d] * p) / (s[t] + s[d]))

    even = F.lit(1 / ALPHABET)
    allow = F.aggregate("line", even, blend("a", "ta", "da"))
    block = F.aggregate("line", even, blend("b", "tb", "db"))
    return lines.select("g", (F.log(allow) - F.log(block)).alias("ratio"))

def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None, order: int = ORDER) -> DataFrame:
    """Verdict of every row (see the module's notes)."""
    name, verdict = ruled(F.col("host"), F.col("path"), RULES if rules is None else rules)
    # The row number is fixed by being written.
    held = written(
        located(pages).withColumns({"rule": name, "verdict": verdict}).withColumns(
            {"held_out": F.pmod(F.xxhash64("host", "path"), F.lit(HELD_OUT)) == 0, "uid": F.monotonically_increasing_id()}
        ), "urls",
    )
    ratios = written(gram_ratios(held, order), "url-ratios")
    asked = held.where("(verdict is null or held_out) and (host != '' or path != '')")
    scored = written(
        _grams(asked, "uid", order=order).join(ratios, "g").groupBy("uid").agg(F.avg("ratio").alias("score")), "url-scores"
    )
    place = F.floor(F.greatest(F.lit(-BINS), F.least(F.lit(BINS), F.col("score") / BIN))).cast("int")
    labelled = held.where("verdict is not null and held_out").join(scored, "uid").groupBy(place.alias("bin")).agg(
        F.sum((F.col("verdict") == "allow").cast("long")).alias("allow"), F.sum((F.col("verdict") == "block").cast("long")).alias("block")
    )
    cut = calibrated([tuple(r) for r in labelled.collect()])  # at most 2 * BINS + 1 rows
    out = held.join(scored, "uid", "left")
    model = F.when(F.col("score") < cut, "block").otherwise("allow")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", model).alias("verdict"),
        F.when(F.col("verdict").isNull(), F.round("score", 6)).alias("score"),
    )

def calibrated(bins: list[tuple[int, int, int]]) -> float:
    """Cut with the largest sum of hit rates over ``(bin, allowed, blocked)``; the nearest to zero of equals, 0 without both kinds."""
    allowed, blocked = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not allowed or not blocked:
        return 0.0
    below_a = below_b = 0

    found = []
    for at, a, b in sorted(bins):
        found.append((round(below_b / blocked - below_a / allowed, 12), -abs(at * BIN), at * BIN))
        below_a, below_b = below_a + a, below_b + b
        found.append((round(below_b / blocked - below_a / allowed, 12), -abs((at + 1) * BIN), (at + 1) * BIN))
    best = max(found)
    return best[2]

"""Quality rules whose cut-offs are proven on labelled documents.

Each rule is a share measured on a text; a text is rejected above the rule's cut-off.
Candidate cut-offs are fixed in advance, from lenient to strict, and not read off the
labels. For each stratum (language) and rule the labelled good documents of that stratum
that pass the base rule are a holdout, each counted once (with its largest shares, where
rows repeat its id), so the limit covers what the method rejects beyond the base rule: with ``k`` of ``n`` of them above a cut-off, the cut-off is certified if
``P(Binomial(n, limit) <= k) <= level``, the exact test that the true false-rejection
rate is below ``limit`` (the same as an exact upper confidence bound below it).

* Within a rule the cut-offs are tested from lenient to strict, up to the first that
  fails; such a fixed sequence needs no correction.
* Over strata and rules the level is divided by their number (Bonferroni).
* The limit is divided by the number of rules, so all rules together reject at most
  ``false_rejections`` of a stratum's good documents, in all strata at once, with
  confidence ``1 - error``.

With ``joint`` the rules are tested together instead: step ``g`` of one fixed sequence sets
every rule to its ``g``-th cut-off (its last one when it has fewer), the labelled good
documents that any rule rejects are counted, and the steps are tested up to the first that
fails, with the whole limit and the level divided by the strata alone. The guarantee is the
same and needs about 217 good labels at four strata, against about 1 200 for separate rules.

Without enough labels nothing is certified and only the base rule rejects.

Rows: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
``n_repeat_words``, ``base_failed``, ``kept`` and ``text_hash``, which tells rows of one id
apart. A null text has no words and fails the base
rule. A null language is a stratum of its own. Several labels of one document count as
its worst. Null or repeated ids: every row is judged by itself; rows of one id share its
label. Empty tables give empty results; further columns are ignored.

All of it is built-in functions. Eight-word windows are compared by 64-bit hashes
within one text.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.session import small_side, written

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
FALSE_REJECTIONS = 0.02
ERROR = 0.05

#: Candidate cut-offs of each rule, lenient to strict.
CUTOFFS: dict[str, list[float]] = {
    "symbols": [0.50, 0.40, 0.30, 0.25, 0.20, 0.15, 0.10, 0.08],
    "dup_lines": [0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30],
    "repeats": [0.29, 0.27, 0.25, 0.22, 0.20, 0.17, 0.15],
    "capitals": [0.95, 0.90, 0.80, 0.70, 0.60, 0.50, 0.40],
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside a window of ``window`` words that the list holds twice or more."""

    def marked(h: Column) -> Column:
        placed = F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i")))

        def covered(s: Column) -> Column:
            n = F.size(s)
            twice = F.filter(
                F.transform(s, lambda v, j: F.when(
                    ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == v["h"])) | ((j < n - 1) & (s[F.least(j + 1, n - 1)]["h"] == v["h"])), v["i"]
                )), lambda i: i.isNotNull(),
            )
            start = F.struct(F.lit(-window).cast("int").alias("last"), F.lit(0).cast("long").alias("sum"))
            return F.aggregate(
                F.array_sort(twice), start,
                lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(window), i - a["last"])).alias("sum")),
                lambda a: a["sum"],
            )

        repeated = _let(F.array_sort(placed), covered)
        return F.when(F.size(F.array_distinct(h)) < F.size(h), repeated).otherwise(F.lit(0).cast("long"))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    found = _let(F.transform(words, lambda x: F.xxhash64(x)), lambda w: _let(hashed(w), marked))
    return F.when(F.size(words) >= window, found).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame) -> DataFrame:
    """Counts and shares of every row's text."""
    text = F.coalesce("text", F.lit(""))
    parts = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.coalesce("lang", F.lit("")).alias("stratum"), text.alias("text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    counted = parts.select(
        "doc_id", "text_hash", "stratum", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_capitals"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return counted.select(
        "doc_id", "text_hash", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)).alias("base_failed"),
        share("n_symbols", "word_chars").alias("symbols"), share("n_dup_lines", "n_lines").alias("dup_lines"),
        share("n_repeat_words", "n_words").alias("repeats"), share("n_capitals", "word_chars").alias("capitals"),
    )


def _log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series at n + 10, exact to about 1e-13."""
    y = n + F.lit(10.0)
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    down = F.lit(0.0)
    for i in range(1, 10):
        down = down + F.log(n + i)
    return series - down


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """``P(Binomial(n, p) <= k)`` for k < n p, else 1 (such a k never certifies anything).

    The terms are added from k downwards; beyond twelve deviations the rest is below 1e-17
    of the sum.
    """
    n, k = n.cast("double"), k.cast("double")
    first = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    steps = F.least(k, F.ceil(12 * F.sqrt(n * p) + 60)).cast("int")
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))
    ratio = lambda i: (k - i + 1) / (n - k + i) * ((1 - p) / p)
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), start,
        lambda a, i: F.struct((a["t"] * ratio(i)).alias("t"), (a["s"] + a["t"] * ratio(i)).alias("s")), lambda a: a["s"],
    )
    return F.when(k < n * p, first * total).otherwise(F.lit(1.0))


def cutoffs(
    measured: DataFrame, labels: DataFrame, false_rejections: float = FALSE_REJECTIONS, error: float = ERROR, joint: bool = False
) -> DataFrame:
    """Certified cut-off of each stratum and rule, null where none is: ``stratum, <rule>...``."""
    judged = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    holdout = measured.where("not base_failed").join(judged.where("quality = 1"), "doc_id", "left_semi")
    # One draw a label: rows that share an id are not independent.
    holdout = holdout.groupBy("stratum", "doc_id").agg(*[F.max(rule).alias(rule) for rule in CUTOFFS])
    above = [
        F.sum((F.col(rule) > cut).cast("long")).alias(f"{rule}_{g}") for rule, cuts in CUTOFFS.items() for g, cut in enumerate(cuts)
    ]
    steps = [{rule: cuts[min(g, len(cuts) - 1)] for rule, cuts in CUTOFFS.items()} for g in range(max(map(len, CUTOFFS.values())))]
    if joint:
        any_rule = [reduce(or_, [F.col(rule) > cut for rule, cut in step.items()]) for step in steps]
        above = [F.sum(c.cast("long")).alias(f"joint_{g}") for g, c in enumerate(any_rule)]
    counts = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *above)
    counts = counts.crossJoin(F.broadcast(counts.agg(F.count("*").alias("strata"))))  # one row
    if joint:
        tails = [binomial_tail(F.col("n"), F.col(f"joint_{g}"), false_rejections).alias(f"p_{g}") for g in range(len(steps))]
        passed, best = F.lit(True), {rule: F.lit(None).cast("double") for rule in CUTOFFS}
        for g, step in enumerate(steps):
            passed = passed & (F.col(f"p_{g}") <= F.lit(error) / F.col("strata"))
            best = {rule: F.when(passed, F.lit(cut)).otherwise(best[rule]) for rule, cut in step.items()}
        return counts.select("stratum", "strata", *tails).select("stratum", *[b.alias(f"max_{rule}") for rule, b in best.items()])
    limit, level = false_rejections / len(CUTOFFS), F.lit(error) / (F.col("strata") * len(CUTOFFS))
    chosen = []
    for rule, cuts in CUTOFFS.items():
        passed, best = F.lit(True), F.lit(None).cast("double")
        for g, cut in enumerate(cuts):
            passed = passed & (F.col(f"p_{rule}_{g}") <= level)
            best = F.when(passed, F.lit(cut)).otherwise(best)
        chosen.append(best.alias(f"max_{rule}"))
    tails = [binomial_tail(F.col("n"), F.col(f"{rule}_{g}"), limit).alias(f"p_{rule}_{g}") for rule, cuts in CUTOFFS.items() for g in range(len(cuts))]
    return counts.select("stratum", "strata", *tails).select("stratum", *chosen)


def judge(
    docs: DataFrame, labels: DataFrame, false_rejections: float = FALSE_REJECTIONS, error: float = ERROR, joint: bool = False
) -> DataFrame:
    """Counts and verdict of every row (see the module's notes)."""
    measured = written(measures(docs), "quality-measures")
    limits = written(cutoffs(measured, labels, false_rejections, error, joint), "quality-cutoffs")
    joined = measured.join(small_side(limits, limits.count()), "stratum", "left")
    rejected = F.lit(False)
    for rule in CUTOFFS:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"max_{rule}"), F.lit(False))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rejected).alias("kept"), "text_hash",
    )

"""Word, character and capital-run features of a text column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published attribute list of the mail-text data set.
WORDS = (
    "make", "address", "all", "3d", "our", "over", "remove", "internet", "order", "mail", "receive", "will",
    "people", "report", "addresses", "free", "business", "email", "you", "credit", "your", "font", "000", "money",
    "hp", "hpl", "george", "650", "lab", "labs", "telnet", "857", "data", "415", "85", "technology", "1999",
    "parts", "pm", "direct", "cs", "meeting", "original", "project", "re", "edu", "table", "conference",
)
CHARACTERS = (";", "(", "[", "!", "$", "#")


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Maximal runs of letters and digits of any script."""
    return F.regexp_extract_all(_text(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def char_frequency(text: Column | str, character: str) -> Column:
    """100 x occurrences / characters; 0 for an empty text."""
    t = _text(text)
    seen = F.length(t) - F.length(F.replace(t, F.lit(character), F.lit("")))
    return F.when(F.length(t) > 0, 100.0 * seen / F.length(t)).otherwise(0.0)


def with_text_features(
    df: DataFrame, text: str, words: Sequence[str] = WORDS, characters: Sequence[str] = CHARACTERS
) -> DataFrame:
    """Add ``word_freqs``, ``char_freqs`` (arrays) and the three capital-run columns.

    The whole text is split once; only tokens of the vocabulary (a hash-set
    lookup) are kept for the per-word counts. Explode the arrays with
    ``posexplode_outer``: the plain form makes the optimizer repeat the whole
    expression in a not-empty filter.
    """
    vocabulary = F.array(*[F.lit(w) for w in words])
    split = df.withColumn("_tokens", tokens(text)).withColumn(
        "_runs", F.transform(F.regexp_extract_all(F.col(text), F.lit(r"\p{Lu}+"), 0), F.length)
    )
    known = split.withColumns(
        {
            "_known": F.filter("_tokens", lambda t: t.isin(*words)),
            "_n": F.size("_tokens"),
        }
    )
    word_freqs = F.transform(
        vocabulary,
        lambda w: F.when(
            F.col("_n") > 0, 100.0 * F.size(F.filter("_known", lambda t: t == w)) / F.col("_n")
        ).otherwise(0.0),
    )
    total = F.aggregate("_runs", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return known.withColumns(
        {
            "word_freqs": word_freqs,
            "char_freqs": F.array(*[char_frequency(text, c) for c in characters]),
            "capital_run_length_total": total,
            "capital_run_length_longest": F.coalesce(F.array_max("_runs"), F.lit(0)),
            "capital_run_length_average": F.when(F.size("_runs") > 0, total / F.size("_runs")).otherwise(0.0),
        }
    ).drop("_tokens", "_runs", "_known", "_n")

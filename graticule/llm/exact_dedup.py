"""Exact duplicates by 128-bit content hashes, with the bytes compared inside groups.

1. One pass hashes every text and writes (id, row number, hashes): some fifty bytes a row.
2. Rows are counted by hash. Copies collapse inside each task, so a text that a third of
   all rows share costs one row per task.
3. Hashes held by several rows are checked: their texts are read again, one per task and
   hash is shuffled, and a hash with more than one distinct text has collided. Which rows
   need reading again is decided by a bit table of fixed size, so texts that stand
   once stay where they are; a full table only lets more of them through.
4. Each row gets its group's result. Groups with more than a ten-thousandth of all rows
   (hence at most ten thousand of them) are broadcast, the others joined on the hash.
   Rows of collided hashes are grouped by hash and text instead.

Rows: the columns of ``docs`` except the text, then ``keep_id`` (id of the row that stays),
``group_size``, ``kept`` and ``text_sha256``. Built-in functions only; the row numbers
are fixed by being written.

A null text counts as empty. Of equal texts the row with the largest id stays (or the
smallest); a null id stays only where no other id stands. Of rows equal in text and id
exactly one is kept. Very long texts are only hashed and, if their hash stands twice,
compared. Columns of ``docs`` named like a result are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from graticule.session import written

# Longs of the bit table: 4 MB as rows of a broadcast table.
FILTER_LONGS = 1 << 18
RESULTS = ["keep_id", "group_size", "kept", "text_sha256"]


def exact_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", largest: bool = True, normalise: Callable[[Column], Column] | None = None,
    digest: Callable[[Column], Column] = F.md5, filter_longs: int = FILTER_LONGS,
) -> DataFrame:
    """Group, kept row and content hash of every row of ``docs`` (see the module's notes).

    ``normalise`` maps the text column before it is compared; ``digest`` is the content hash.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    content = normalise(content) if normalise else content
    # Names of this module stand apart from those of the input.
    body = F.struct(*[F.col(c) for c in docs.columns if c != text and c not in RESULTS])
    hashed = docs.select(
        body.alias("body"), F.col(key).alias("id"), digest(content).alias("h"), F.sha2(content, 256).alias("sha"), F.monotonically_increasing_id().alias("row")
    )
    seen = Observation()
    rows = written(hashed.observe(seen, F.count(F.lit(1)).alias("n")), "exact-rows")
    total = seen.get["n"] or 0
    groups = written(_groups(rows, ["h"], largest).where("n > 1"), "exact-groups")

    again = _sharing(docs.select(content.alias("content"), digest(content).alias("h")), groups, filter_longs)
    texts = again.groupBy("h", "content").agg(F.count(F.lit(1)).alias("copies"))
    odd = Observation()
    collided = written(
        texts.groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h").observe(odd, F.count(F.lit(1)).alias("n")), "exact-collided"
    )
    if not odd.get["n"]:
        return _shaped(_joined(rows, groups, "h", total))
    # Different texts under one hash: these rows are grouped by the text itself.
    apart = docs.select(body.alias("body"), F.col(key).alias("id"), digest(content).alias("h"), F.sha2(content, 256).alias("sha"), content.alias("content"))
    rest = written(_sharing(apart, collided, filter_longs).join(collided, "h", "left_semi").withColumn("row", F.monotonically_increasing_id()), "exact-apart")
    by_text = _groups(rest, ["h", "content"], largest).where("n > 1")
    settled = rest.join(by_text, ["h", "content"], "left").select("body", "id", "sha", "row", "keep", "n", "stays")
    return _shaped(_joined(rows.join(collided, "h", "left_anti"), groups, "h", total).unionByName(settled))


def _groups(rows: DataFrame, by: list[str], largest: bool) -> DataFrame:
    """Size, id that stays and number of the row that stays of each group."""
    end, end_by = (F.max, F.max_by) if largest else (F.min, F.min_by)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), end("id").alias("keep"), F.coalesce(end_by("row", "id"), F.min("row")).alias("stays")
    )


def _sharing(rows: DataFrame, groups: DataFrame, longs: int) -> DataFrame:
    """The rows whose ``h`` may be one of the groups': all that are, few others."""
    place = F.pmod(F.xxhash64("h"), F.lit(64 * longs))
    bits = groups.select(place.alias("p")).groupBy(F.expr("p div 64").alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")
    )
    # At most ``longs`` rows of two longs.
    return rows.withColumn("p", place).withColumn("at", F.expr("p div 64")).join(F.broadcast(bits), "at").where(
        "bit_get(bits, cast(p % 64 as int)) = 1"
    ).drop("p", "at", "bits")


def _joined(rows: DataFrame, groups: DataFrame, by: str, total: int) -> DataFrame:
    """Rows with their group's columns; the few largest groups are broadcast, so that none meets in one task."""
    large = F.col("n") > max(1000, total // 10_000)
    hot = F.broadcast(groups.where(large))
    wanted = ["body", "id", "sha", "row", "keep", "n", "stays"]
    return rows.join(hot, by).select(*wanted).unionByName(
        rows.join(hot.select(by), by, "left_anti").join(groups.where(~large), by, "left").select(*wanted)
    )


def _shaped(rows: DataFrame) -> DataFrame:
    alone = F.col("n").isNull()
    return rows.select(
        "body.*", F.when(alone, F.col("id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("stays"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )

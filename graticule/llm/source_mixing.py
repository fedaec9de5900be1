"""Mixing sources to target weights: budgets down a domain, language, source tree, token prefixes from seeded epochs.

A budget of tokens is handed down the tree. At every node the children get shares by
weight; one that holds fewer tokens than its share (all its documents, ``epochs`` times)
gets what it holds, and the shortage goes to its siblings by weight. Because a node's
holdings are summed up before budgets come down, siblings use up their room before
anything passes to the ancestors' other children. With ``L`` the level that solves
``sum(min(holding, L * weight)) = budget``, a child gets ``min(holding, L * weight)``; ``L`` is
the largest of ``(budget - holdings before) / weights from here`` over children in order
of holding per weight.

A leaf's budget buys whole epochs and a prefix of the next one. Each epoch has its own
seeded order (a hash of seed, epoch, id and text). The prefix is found on sums over
hash ranges, whose number follows the leaf's rows; only the range in which the budget
ends is sorted, so a leaf with a third of all rows spreads over many tasks.

Tokens are words here (maximal runs outside space and 0x09-0x0D). Rows: the leaf's keys,
``doc_id``, ``text_hash``, ``epoch`` (from 0) and ``n_tokens``, one per use of a document.
Null keys form leaves of their own (empty name); a null text has no tokens; repeated rows
count and are drawn separately; documents without tokens come along while their place in
the order is before the end. Children without a stated weight weigh ``other``. An empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.session import small_side, written

LEVELS = ("domain", "lang", "source")
RANGE_ROWS = 10_000

#: Target weights of the production mixture; a path names a node from the root.
WEIGHTS: dict[tuple[str, ...], float] = {
    ("crawl",): 5.0, ("books",): 3.0, ("forums",): 2.0,
    ("crawl", "en"): 5.0, ("crawl", "de"): 2.0, ("crawl", "fr"): 2.0, ("crawl", "es"): 2.0,
    ("books", "en"): 3.0, ("forums", "en"): 3.0,
}
BUDGET_SHARE = 0.6
EPOCHS = 2
SEED = 7


def domain_of(source: Column) -> Column:
    """Domain of the test tables' sources."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"^src(\d{1,9})$", 1)
    n = F.when(number != "", number.cast("int"))
    return F.when(n == 0, "crawl").when(n < 10, "books").when(n >= 10, "forums").otherwise("other")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _level(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budget of each child from its parent's; ``children`` has holding, weight and parent_budget."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("holding") / F.col("weight"), name)
    before = F.coalesce(F.sum("holding").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    later = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    at = children.where("weight > 0").withColumn("at", (F.col("parent_budget") - before) / later)
    level = F.greatest(F.max("at").over(by), F.lit(0.0))
    return at.withColumn("budget", F.least(F.col("holding"), level * F.col("weight"))).drop("at", "parent_budget", "weight")


def budgets(
    leaves: DataFrame, weights: dict[tuple[str, ...], float], tokens: float | None, share: float, other: float = 1.0
) -> DataFrame:
    """``leaves(<levels>, holding)`` with the tokens each may give; the budget is ``tokens`` or ``share`` of all holdings."""
    spark = leaves.sparkSession
    total = leaves.agg(F.coalesce(F.sum("holding"), F.lit(0.0))).first()[0] * share if tokens is None else float(tokens)
    parents = None
    for depth, name in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        given = [(*k, float(w)) for k, w in weights.items() if len(k) == depth + 1]
        named = spark.createDataFrame(given, ", ".join(f"{k} string" for k in keys) + ", weight double")
        nodes = leaves.groupBy(*keys).agg(F.sum("holding").alias("holding")).join(F.broadcast(named), keys, "left")  # a parameter
        nodes = nodes.fillna(other, ["weight"])
        if parents is None:
            nodes = nodes.withColumn("parent_budget", F.lit(total))
        else:
            nodes = nodes.join(parents, keys[:-1])
        nodes = _level(nodes, keys[:-1], name)
        parents = nodes.select(*keys, F.col("budget").alias("parent_budget"))
    return nodes.select(*LEVELS, F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def mix(
    docs: DataFrame, weights: dict[tuple[str, ...], float] | None = None, domain: Column | None = None,
    tokens: float | None = None, share: float = BUDGET_SHARE, epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """Documents drawn by the mixture (see the module's notes). ``share`` is of the tokens of one epoch."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    domain = domain_of(F.col("source")) if domain is None else domain
    rows = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), blank(domain).alias("domain"),
        blank(F.col("lang")).alias("lang"), blank(F.col("source")).alias("source"), word_count(F.col("text")).alias("n_tokens"),
    )
    # The row number, which parts equal rows, is fixed by being written.
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "mix-rows")
    held = written(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("m")), "mix-leaves")
    leaves = held.select(*LEVELS, (F.col("tokens") * F.lit(epochs)).cast("double").alias("holding"))
    given = held.join(budgets(leaves, WEIGHTS if weights is None else weights, tokens, share / epochs), list(LEVELS)).where("budget > 0")
    given = written(
        given.select(
            *LEVELS, F.floor(F.col("budget") / F.col("tokens")).alias("full"), F.expr("budget % tokens").alias("rest"),
            F.ceil(F.col("m") / RANGE_ROWS).alias("ranges"),
        ), "mix-budgets",
    )
    drawn = rows.join(small_side(given, given.count()), list(LEVELS))
    whole = drawn.where("full > 0").select(
        *LEVELS, "doc_id", "text_hash", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("epoch"), "n_tokens"
    )
    order = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "full", "doc_id", "text_hash"), 1)
    last = drawn.where("rest > 0").withColumn("h", order).withColumn(
        "r", F.floor(F.col("h") / F.lit(float(1 << 63)) * F.col("ranges"))
    )
    sums = last.groupBy(*LEVELS, "r").agg(F.sum("n_tokens").alias("s"))
    before = Window.partitionBy(*LEVELS).orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("s").over(before), F.lit(0)))
    sums = written(sums, "mix-ranges")
    placed = last.join(small_side(sums, sums.count()), [*LEVELS, "r"]).where("base <= rest")
    inside = placed.where("base + s <= rest")
    inner = Window.partitionBy(*LEVELS, "r").orderBy("h", "doc_id", "text_hash", "uid").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("base + s > rest").withColumn("upto", F.sum("n_tokens").over(inner) + F.col("base")).where("upto <= rest")
    columns = [*LEVELS, "doc_id", "text_hash", F.col("full").cast("long").alias("epoch"), "n_tokens"]
    return whole.unionByName(inside.select(*columns)).unionByName(edge.select(*columns))

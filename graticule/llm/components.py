"""Connected components of a link table, by alternating star contractions.

Each round points every node's larger neighbours at its least neighbour, then every
node and its smaller neighbours at the least of them. Rounds are written to the shared
folder, so plans stay short and a lost executor costs one round. Only pairs of keys
move. A node's least neighbour is found by partial sums, but the links of one node meet
in one task when it is attached to them, so callers hand in few links per node where
they can (one per member of a group).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from graticule.session import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its least node.

    Any orderable key type; repeated links, self-links and either direction are fine, links
    with a null end are ignored, no links give no rows.
    """
    edges = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where(
        "a is not null and b is not null and a != b"
    )
    edges, now = _counted(edges.distinct())
    state = None
    while now != state and now[0]:
        state = now
        both = edges.union(edges.select(F.col("hi"), F.col("lo"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.join(least.withColumnRenamed("u", "lo"), "lo").select(F.col("m").alias("lo"), "hi")
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first, "hi").where("lo != m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
        edges, now = _counted(small.union(first.select(F.col("m").alias("lo"), "hi")).distinct())
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The links written, with their number and a check sum taken while writing."""
    seen = Observation()
    out = written(
        edges.observe(
            seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x"), F.bit_xor(F.xxhash64("hi", "lo")).alias("y")
        ), "component-links",
    )
    return out, (seen.get["n"], seen.get["x"], seen.get["y"])

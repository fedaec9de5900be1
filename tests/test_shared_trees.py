"""Trees grown together: what a row gives to several trees is worked out and moved once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from graticule.functions.dense import FlatTrees
from graticule.operators.splits import Level, lines_together
from graticule.plans.tree import Node, train_trees


def test_a_row_of_nine_trees_gives_one_entry():
    roots = [Node(t, 0, 0, False, None, None, 0.0, 500, 100.0, None) for t in range(10)]
    shift = np.zeros(10, np.int64)
    together = lines_together(np.arange(10), np.zeros(10, np.int64), shift, 3)
    level = Level(FlatTrees(roots), np.arange(10), shift, [np.arange(1, 8) * 10.0], 1, 3, False, together)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([[t for t in range(10) if t != i % 10] for i in range(80)], pa.list_(pa.int32())),
         pa.array([[float(i)] for i in range(80)]), pa.array([float(i % 2) for i in range(80)])], ["at", "features", "y"]
    )
    (line, mask, _, number, value, m, q), = level.shared_entries([batch])
    assert len(line) == 80 and m.sum() == 80 and (np.bitwise_count(mask) == 9).all()
    apart = {(s, v): (a, b) for s, _, _, vs, ms, qs in level.entries([batch]) for s, v, a, b in zip(s.tolist(), vs.tolist(), ms.tolist(), qs.tolist())}
    again = {(int(together[l, b]), v): (a, c) for l, k, v, a, c in zip(line, mask, value.tolist(), m.tolist(), q.tolist()) for b in range(16) if k >> b & 1}
    assert again == apart


def test_trees_grown_from_shared_rows_are_those_of_their_own_rows(spark):
    rows = spark.range(3000).select(
        F.array((F.col("id") * 37 % 1009).cast("double"), (F.col("id") % 13).cast("double")).alias("features"),
        (F.xxhash64("id") % 2 == 0).cast("int").alias("label"),
        # Some rows train a tree twice, some none; tree 40 is in a line of its own.
        F.expr("filter(array(0, 1, 2, 2, 40), (t, i) -> (id + i) % 4 != 0 and id % 50 != 7)").alias("tree_ids"),
    )
    apart = rows.withColumn("tree_id", F.explode("tree_ids")).drop("tree_ids")
    for limit in (100, 700, 100_000):
        assert train_trees(rows, max_depth=4, outright_rows=limit).nodes == train_trees(apart, max_depth=4, outright_rows=100_000).nodes

"""Cases at the edge of doubles, rates, seeds and folders."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.operators import sampling
from graticule.operators.prepare import complete
from graticule.plans.forest import votes, votes_expression
from graticule.plans.som import Codebook, train_som, updated
from graticule.plans.tree import between, predict, rank_edges, train_trees
from graticule.sources.tables import from_rows
from graticule.streaming.incremental_som import IncrementalSom, snapshot_path


def test_adjacent_doubles_are_parted(spark):
    low, high = math.nextafter(1.0, 2.0), math.nextafter(math.nextafter(1.0, 2.0), 2.0)
    assert between(low, high) == low and between(1e308, 1.5e308) < 1.5e308
    rows = from_rows(spark, [[low], [low], [high], [high]], [0, 0, 1, 1])
    model = train_trees(rows, max_depth=2)
    assert predict(rows, model).where("prediction != label").count() == 0


@pytest.mark.parametrize("bad", [math.nan, math.inf])
def test_bad_numbers_are_refused_or_dropped(spark, bad):
    rows = from_rows(spark, [[1.0], [2.0], [bad]], [0, 1, 1])
    with pytest.raises(Exception, match="NaN or infinite"):
        train_trees(rows, max_depth=2)
    with pytest.raises(Exception, match="NaN or infinite"):
        train_som(rows, 1, 2, 1, width=1)
    assert complete(rows).count() == 2 and train_trees(complete(rows), max_depth=2).nodes[0].is_split


def test_poisson_rates(spark):
    keys = spark.range(2000)
    for rate in (0.5, 10.0, 300.0, 1000.0):
        mean, var = keys.select(sampling.poisson_copies(["id"], rate, 7).alias("c")).agg(F.avg("c"), F.var_samp("c")).first()
        assert mean == pytest.approx(rate, rel=0.06) and var == pytest.approx(rate, rel=0.15)


def test_histogram_trees_do_not_depend_on_partitioning(spark):
    rows = spark.range(4000).select(
        F.array(F.sqrt("id"), (F.col("id") * 7919 % 1000).cast("double")).alias("features"), (F.col("id") % 1000 < 300).cast("int").alias("label")
    )
    a, b = (train_trees(rows.repartition(n), max_depth=4, search="histogram").nodes for n in (1, 16))
    assert a == b and a[0].is_split


def test_histogram_edges_are_exact_quantile_ranks(spark):
    con = duckdb.connect()
    values = con.execute("SELECT l_extendedprice::DOUBLE FROM '/root/testdata/sf0.001/lineitem.parquet' ORDER BY 1").fetchall()
    rows = from_rows(spark, values)
    wanted = con.execute(
        "SELECT DISTINCT v FROM (SELECT l_extendedprice::DOUBLE AS v, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n"
        " FROM '/root/testdata/sf0.001/lineitem.parquet'), range(1, 32) t(k) WHERE r = (k * n + 31) // 32 ORDER BY v"
    ).fetchall()
    a, b = (rank_edges(rows.repartition(n), 1, 32) for n in (1, 16))
    assert a == b == [[v for v, in wanted]]


def test_histogram_trees_with_outliers_and_heavy_values(spark):
    far = spark.range(4000).select(
        F.array(F.when(F.col("id") == 0, 1e9).otherwise(F.col("id") % 50 / 1.0)).alias("features"), (F.col("id") % 50 < 20).cast("int").alias("label")
    )
    root = train_trees(far, max_depth=2, search="histogram").nodes[0]
    assert root.is_split and root.threshold == 19.5
    for rare, often in ((0.0, 1.0), (1.0, 0.0)):
        heavy = spark.range(4000).select(F.array(F.when(F.col("id") < 4, rare).otherwise(often)).alias("features"), (F.col("id") < 4).cast("int").alias("label"))
        root = train_trees(heavy, max_depth=2, search="histogram").nodes[0]
        assert root.is_split and root.threshold == 0.5


def test_subsets_need_a_key(spark):
    with pytest.raises(ValueError, match="key"):
        train_som(from_rows(spark, [[1.0]]), 1, 2, 1, width=1, subset_fraction=0.5)


def test_large_forests_are_still_counted(spark):
    rows = from_rows(spark, [[float(i)] for i in range(8)], [i % 2 for i in range(8)])
    model = train_trees(rows, max_depth=4)
    assert rows.where(votes(model) != votes_expression(model, max_nodes=1)).count() == 0


def test_update_does_not_allocate_all_pairs():
    book = Codebook(250, 200, np.zeros((50_000, 2)))
    after = updated(book, [{"neuron": 0, "n": 2, "sums": [2.0, 4.0]}], 1.0)
    assert after.weights[0].tolist() == [1.0, 2.0] and after.weights[1].tolist() == [1.0, 2.0]
    assert after.weights[2].tolist() == [0.0, 0.0] and after.weights[200].tolist() == [1.0, 2.0]


def test_a_folder_of_another_stream_is_refused(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "snapshots")
    spark.createDataFrame([([0.5, 0.5],)], "features array<double>").write.parquet(source)
    start = Codebook.random(spark, 2, 2, 2, seed=1)
    stream = spark.readStream.schema("features array<double>").parquet(source)
    IncrementalSom(start, out).start(stream, str(tmp_path / "first"), available_now=True).awaitTermination()
    assert spark.read.parquet(snapshot_path(out, 0)).where("query != ''").count() == 4
    with pytest.raises(Exception, match="another streaming query"):
        IncrementalSom(start, out).start(stream, str(tmp_path / "second"), available_now=True).awaitTermination()

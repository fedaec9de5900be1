"""Readers, preparation, model files, streams and plan shapes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.operators import prepare
from graticule.plans.som import Codebook, assign, unit_sums, updated
from graticule.session import build_session, check_model_size, scratch_path, shared_dir
from graticule.sources import models, tables
from graticule.streaming.incremental_som import IncrementalSom, blended, load_snapshot


def test_csv_fails_on_a_malformed_line(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("1,2.5\n0,oops\n")
    with pytest.raises(Exception):
        tables.read_csv(spark, str(tmp_path / "bad.csv"), ["label", "x"]).collect()


def test_whitespace_reader_skips_blank_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  1.5\t2e3  \n\n   \n-1   0\n")
    found = tables.read_whitespace(spark, str(tmp_path / "a.txt"), ["a", "b"]).collect()
    assert sorted(tuple(r) for r in found) == [(-1.0, 0.0), (1.5, 2000.0)]


def test_uniform_table_is_reproducible(spark):
    a = tables.uniform_table(spark, 500, 3, seed=1, partitions=2)
    b = tables.uniform_table(spark, 500, 3, seed=1, partitions=7)
    assert a.exceptAll(b).count() == 0
    stats = a.select(F.explode("features").alias("v")).agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert 0 <= stats[0] and stats[1] < 1 and stats[2] == pytest.approx(0.5, abs=0.05)


def test_missing_values_are_refused_or_dropped(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    with pytest.raises(ValueError):
        prepare.standard_scale(df, ["x"])
    assert prepare.standard_scale(df, ["x"], on_missing="drop").count() == 2
    constant = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert {r["x"] for r in prepare.standard_scale(constant, ["x"]).collect()} == {0.0}


def test_codebook_file_round_trip(spark, tmp_path):
    book = Codebook.random(spark, 3, 4, 5, seed=9)
    models.save_codebook(spark, book, str(tmp_path / "book"))
    assert (models.load_codebook(spark, str(tmp_path / "book"), 3, 4).weights == book.weights).all()


def test_model_size_is_checked():
    with pytest.raises(ValueError):
        check_model_size(1 << 40, "codebook")


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))
    assert build_session() is spark or build_session().sparkContext is spark.sparkContext


def test_incremental_map_counts_every_batch_once(spark, tmp_path):
    rng = np.random.default_rng(3)
    parts = [rng.random((40, 2)) for _ in range(3)]
    source, out = tmp_path / "in", str(tmp_path / "snapshots")
    start = Codebook.random(spark, 2, 2, 2, seed=1)
    job = IncrementalSom(start, out, sigma_0=1.5, eta_0=0.5, tau=3.0, switch_at=2, eta_f=0.1, sigma_f=0.4)
    expected = start
    for t, part in enumerate(parts):
        batch = spark.createDataFrame([(p.tolist(),) for p in part], "features array<double>")
        batch.coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("features array<double>").parquet(str(source))
        job.start(stream, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
        sigma = 0.4 if t >= 2 else 1.5 * np.exp(-t / 3.0)
        eta = 0.1 if t >= 2 else 0.5 * np.exp(-t / 3.0)
        expected = blended(expected, updated(expected, unit_sums(batch, expected).collect(), sigma), eta)
        assert load_snapshot(spark, out, t, 2, 2).weights == pytest.approx(expected.weights)
    # A batch delivered again finds its snapshot and changes nothing.
    job.step(spark.createDataFrame([([9.0, 9.0],)], "features array<double>"), 2)
    assert load_snapshot(spark, out, 2, 2, 2).weights == pytest.approx(expected.weights)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_assignment_is_narrow_and_prunes_columns(spark):
    from graticule.catalog.queries import table

    rows = table(spark, "/root/testdata/sf0.001", "embeddings").where("label = 3")
    plan = plan_of(assign(rows, Codebook.random(spark, 2, 2, 64, 1), "embedding").select("bmu"))
    assert "Exchange" not in plan and "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan
    assert "vec_id" not in plan.split("ReadSchema")[1]


def test_unit_sums_shuffle_partials_only(spark):
    rows = spark.range(1000).select(F.array(F.rand(1), F.rand(2)).alias("features"))
    plan = plan_of(unit_sums(rows, Codebook.random(spark, 2, 2, 2, 1)))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_sum" in plan
    assert plan.index("MapInArrow") > plan.index("Exchange")

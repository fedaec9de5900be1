"""The registered queries: each reads the given tables in full."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.functions import text as T
from graticule.functions.impurity import criterion, impurity
from graticule.operators import prepare as P
from graticule.operators import reductions as R
from graticule.operators import sampling as S
from graticule.operators import scans as C
from graticule.operators.splits import Level, candidates, value_counts
from graticule.functions.dense import FlatTrees
from graticule.plans import evaluate as E
from graticule.plans import prune
from graticule.plans import som_quality as Q
from graticule.plans.forest import predict_forest, train_forest, votes_expression
from graticule.plans.som import Codebook, assign, train_som, train_soms, unit_sums, update_table
from graticule.plans.tree import Node, TreeModel, predict, train_trees, tree_expression
from graticule.session import scratch_path
from graticule.sources import models as M
from graticule.sources import tables as D
from graticule.streaming.incremental_som import IncrementalSom, load_snapshot, score_stream

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "line"]
GRID = (4, 5)
BATCHES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items as samples: key columns, four-element vector, label = returned."""
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("line"),
        P.vector(LINE_COLUMNS).alias("features"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


def signal_lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items labelled by quantity with noise, so that some splits are worth keeping and some are not."""
    noise = F.col("l_orderkey") % 7 == 0
    return lines(spark, d).withColumn("label", ((F.col("features")[0] > 25) != noise).cast("int"))


def scaled_lines(spark: SparkSession, d: str) -> DataFrame:
    scaled = P.range_scale(table(spark, d, "lineitem"), LINE_COLUMNS)
    return scaled.select(
        "l_orderkey",
        F.col("l_linenumber").cast("bigint").alias("line"),
        P.vector(LINE_COLUMNS).alias("features"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


def order_samples(spark: SparkSession, d: str) -> DataFrame:
    """Orders as samples: price and age in days, label = finished."""
    orders = P.encode_label(table(spark, d, "orders"), "o_orderstatus", "F")
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return orders.select(
        "o_orderkey", F.array(F.col("o_totalprice"), days.cast("double")).alias("features"), "label"
    )


def embedding_samples(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings moved from [-1, 1] to [0, 1]."""
    shifted = F.transform(F.col("embedding").cast("array<double>"), lambda v: (v + 1.0) / 2.0)
    return table(spark, d, "embeddings").select("vec_id", shifted.alias("features"), "label")


def nodes(model: TreeModel, spark: SparkSession) -> DataFrame:
    return model.to_table(spark).select(
        "tree_id", "level", "node", "is_split", "feature", F.round("threshold", 6).alias("threshold"),
        F.round("label", 6).alias("label"), "n", F.round("s", 4).alias("s"), F.round("criterion", 4).alias("criterion"),
    )


def weights(codebook: Codebook, spark: SparkSession) -> DataFrame:
    return Q.component_planes(spark, codebook).select("row", "col", "component", F.round("weight", 6).alias("weight"))


# --- sources -----------------------------------------------------------------


def csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    src = table(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", 1).otherwise(0), *LINE_COLUMNS)
    D.write_csv(src, path)
    return D.read_csv(spark, path, ["label", *LINE_COLUMNS])


def whitespace_scan(spark, d):
    path = scratch_path(spark, "text")
    cols = [F.col(c).cast("string") for c in ["o_orderkey", "o_custkey", "o_totalprice"]]
    table(spark, d, "orders").select(F.concat(F.lit("  "), F.concat_ws("  \t", *cols), F.lit(" "))).write.text(path)
    return D.read_whitespace(spark, path, ["o_orderkey", "o_custkey", "o_totalprice"])


def in_memory_samples(spark, d):
    """One sample per order priority, from a handful of means held in memory."""
    orders = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.count(F.lit(1)).alias("n"))
    held = [(r["mean"], r["n"]) for r in orders.orderBy("o_orderpriority").collect()]
    samples = D.from_rows(spark, held, [int(n % 2) for _, n in held])
    return samples.select("id", "label", F.posexplode("features").alias("component", "value")).withColumn("value", F.round("value", 4))


def label_by_position(spark, d):
    events = table(spark, d, "events").select("event_id", "value")
    return D.label_by_position(events, ["event_id"], 36)


def uniform_vectors(spark, d):
    return D.uniform_vectors(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 4, seed=5).select(
        "o_orderkey", F.posexplode("features").alias("component", "value")
    )


def model_round_trip(spark, d):
    path = scratch_path(spark, "trees")
    M.save_trees(spark, train_trees(order_samples(spark, d), max_depth=3), path)
    return nodes(M.load_trees(spark, path), spark)


# --- preparation -------------------------------------------------------------


def label_last(spark, d):
    first = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return P.label_last(first, "o_orderstatus")


def vector_round_trip(spark, d):
    packed = P.assemble(table(spark, d, "lineitem").select("l_orderkey", *LINE_COLUMNS), LINE_COLUMNS)
    return P.unassemble(packed.select("l_orderkey", "features"), LINE_COLUMNS)


def standard_scale(spark, d):
    scaled = P.standard_scale(table(spark, d, "lineitem"), LINE_COLUMNS)
    return scaled.select("l_orderkey", *[F.round(c, 6).alias(c) for c in LINE_COLUMNS])


def standard_scale_vectors(spark, d):
    scaled = P.scale_vectors(embedding_samples(spark, d).select("vec_id", "features"))
    return scaled.select("vec_id", F.posexplode("features").alias("component", "value")).withColumn(
        "value", F.round("value", 6)
    )


def range_scale(spark, d):
    scaled = P.range_scale(table(spark, d, "orders"), ["o_totalprice"])
    return scaled.select("o_orderkey", F.round("o_totalprice", 8).alias("scaled"))


def attribute_lists(spark, d):
    return P.attribute_lists(order_samples(spark, d), ["o_orderkey", "label"])


def pivot_lists(spark, d):
    lists = P.attribute_lists(order_samples(spark, d), ["o_orderkey"])
    return P.unassemble(P.pivot_lists(lists, ["o_orderkey"], 2), ["price", "days"])


def encode_label(spark, d):
    return order_samples(spark, d).select("o_orderkey", "label")


def attribute_profile(spark, d):
    found = P.profile(table(spark, d, "lineitem"), LINE_COLUMNS)
    return found.select(
        "attribute", "n", "min_value", "max_value",
        *[F.round(c, 6).alias(c) for c in ["mean_value", "std_value", "cv_percent"]],
    )


def class_distribution(spark, d):
    return P.class_distribution(table(spark, d, "orders"), "o_orderstatus").withColumn("percent", F.round("percent", 6))


def missing_values(spark, d):
    return P.missing(table(spark, d, "lineitem"), LINE_COLUMNS)


def _texts(spark, d):
    return T.with_text_features(table(spark, d, "documents").select("doc_id", "text"), "text")


def word_frequencies(spark, d):
    words = F.array(*[F.lit(w) for w in T.WORDS])
    found = _texts(spark, d).select("doc_id", F.posexplode_outer("word_freqs").alias("at", "freq"))
    return found.select("doc_id", F.get(words, "at").alias("word"), F.round("freq", 6).alias("freq"))


def char_frequencies(spark, d):
    chars = F.array(*[F.lit(c) for c in T.CHARACTERS])
    found = _texts(spark, d).select("doc_id", F.posexplode_outer("char_freqs").alias("at", "freq"))
    return found.select("doc_id", F.get(chars, "at").alias("symbol"), F.round("freq", 6).alias("freq"))


def capital_runs(spark, d):
    return _texts(spark, d).select(
        "doc_id", F.round("capital_run_length_average", 6).alias("run_average"),
        F.col("capital_run_length_longest").alias("run_longest"), F.col("capital_run_length_total").alias("run_total"),
    )


# --- scans, positions, gathers -----------------------------------------------


def prefix_sum(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return C.running_sums(orders, {"running": "o_custkey"}, ["o_orderkey"])


def prefix_sum_by_row(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")
    return C.running_sums(orders, {"running": "o_custkey"}, ["o_orderkey"], ["o_orderpriority"])


def prefix_sum_with_criterion(spark, d):
    rows = order_samples(spark, d).select("o_orderkey", F.col("features")[0].alias("price"), "label")
    rows = rows.withColumn("one", F.lit(1).cast("bigint")).withColumn("label", F.col("label").cast("bigint"))
    sums = C.running_sums(
        rows, {"n_left": "one", "s_left": "label"}, ["price", "o_orderkey"], totals={"n": "one", "s": "label"}
    )
    return sums.selectExpr(
        "o_orderkey", "n_left", "s_left", f"round({criterion('gini', 'n_left', 's_left')}, 4) as criterion"
    )


def stable_partition(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", (F.col("value") > 10).alias("goes_right"))
    return C.stable_partition(events, "goes_right", ["event_id"], ["event_type"])


def row_positions(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    return C.positions(events, ["event_id"], ["event_type"])


def _argsort(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    placed = C.positions(events, ["event_id"], ["event_type"], "idx")
    return C.positions(placed, ["value", "event_id"], ["event_type"], "pos")


def feature_argsort(spark, d):
    return _argsort(spark, d).select("event_type", "pos", "idx")


def gather(spark, d):
    index = _argsort(spark, d).select("event_type", "pos", "idx")
    source = table(spark, d, "events").select("event_id", "event_type", "value")
    source = C.positions(source, ["event_id"], ["event_type"], "at")
    return C.gather(index, source, ["event_type"], "idx", "at", "value")


def scatter(spark, d):
    sort = _argsort(spark, d)
    return C.scatter(
        sort.select("event_type", "pos", "value"), sort.select("event_type", "pos", "idx"), ["event_type"], "pos", "idx", "value"
    )


def gather_labels(spark, d):
    index = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    source = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return C.gather(index, source, [], "l_orderkey", "o_orderkey", "o_orderstatus")


def mark_members(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return C.mark_members(table(spark, d, "customer").select("c_custkey"), big, "c_custkey")


def flag_and_complement(spark, d):
    marked = C.mark_members(
        table(spark, d, "orders").select("o_orderkey", "o_custkey"),
        table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")),
        "o_custkey",
    )
    lists = P.attribute_lists(order_samples(spark, d), ["o_orderkey"])
    found = lists.join(marked.select("o_orderkey", "flag"), "o_orderkey")
    return found.select("o_orderkey", "feature", "flag", (~F.col("flag")).alias("complement"))


# --- reductions --------------------------------------------------------------


def argmin(spark, d):
    return R.argmin(table(spark, d, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"])


def argmin_by_row(spark, d):
    return R.argmin_by(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"])


def argmin_of_arrays(spark, d):
    return table(spark, d, "embeddings").select("vec_id", R.argmin_of_array(F.col("embedding")).alias("at"))


def argmin_two_dimensional(spark, d):
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("component", "value"))
    return R.argmin(cells, "value", ["vec_id", "component"]).withColumn("value", F.round("value", 6))


def total(spark, d):
    return R.total(table(spark, d, "lineitem"), "l_quantity")


def total_by_segment(spark, d):
    return R.total_by(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity")


def weighted_means(spark, d):
    weight = F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0.0)
    found = R.weighted_means(
        table(spark, d, "lineitem"), ["l_partkey"], F.col("l_extendedprice"), weight, F.col("l_partkey").cast("double")
    )
    return found.withColumn("mean_value", F.round("mean_value", 4))


# --- sampling ----------------------------------------------------------------


def poisson_sample(spark, d):
    return S.sample_with_replacement(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 0.5, 7)


def sample_fractions(spark, d):
    """Sample size for each fraction 0.1 ... 1.0, in one pass."""
    steps = [i / 10 for i in range(1, 11)]
    orders = table(spark, d, "orders").agg(
        *[F.sum(S.poisson_copies(["o_orderkey"], f, 7)).alias(f"n{i}") for i, f in enumerate(steps)]
    )
    entries = [F.struct(F.lit(f).alias("fraction"), F.col(f"n{i}").alias("n")) for i, f in enumerate(steps)]
    return orders.select(F.inline(F.array(*entries)))


def holdout_split(spark, d):
    return S.holdout(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 90, seed=4)


def random_groups(spark, d):
    return S.assign_groups(lines(spark, d), LINE_KEY, 12, seed=2).select("l_orderkey", "line", "tree_id")


def cross_validation(spark, d):
    found, _ = E.cross_validate(lines(spark, d), LINE_KEY, folds=10, seed=1, max_depth=4)
    return found.withColumn("accuracy", F.round("accuracy", 6))


def repeated_holdout(spark, d):
    found = E.repeated_holdout(order_samples(spark, d), ["o_orderkey"], seeds=[0, 1, 2], depths=[2, 3, 4], trees=4)
    return found.withColumn("accuracy", F.round("accuracy", 6))


# --- self-organizing map -----------------------------------------------------


def _start(spark, width=4, seed=3):
    return Codebook.random(spark, *GRID, width, seed)


def _trained(spark, d, iterations=2):
    return train_som(scaled_lines(spark, d), *GRID, iterations, width=4, sigma_0=2.0, tau=2.0, seed=3)


def _embedding_map(spark, d):
    return train_som(
        embedding_samples(spark, d), *GRID, 3, width=64, smooth_iterations=2, sigma_0=2.0, sigma_f=0.5, tau=4.0, seed=2,
    )


def som_unit_sums(spark, d):
    found = unit_sums(scaled_lines(spark, d), _start(spark))
    return found.select("neuron", "n", F.posexplode("sums").alias("component", "total")).withColumn(
        "total", F.round("total", 4)
    )


def som_update_join(spark, d):
    start = _start(spark)
    found = update_table(unit_sums(scaled_lines(spark, d), start), start.to_table(spark), 2.0)
    return found.select("row", "col", F.col("k").alias("component"), F.round("w", 6).alias("weight"))


def som_training(spark, d):
    return weights(_trained(spark, d), spark)


def som_training_switched(spark, d):
    return weights(_embedding_map(spark, d), spark)


def som_training_subsets(spark, d):
    trained = train_som(
        scaled_lines(spark, d), *GRID, 2, width=4, sigma_0=2.0, tau=2.0, seed=3, subset_fraction=0.5, key=LINE_KEY,
    )
    return weights(trained, spark)


def som_best_units(spark, d):
    found = assign(embedding_samples(spark, d), _embedding_map(spark, d))
    return P.cell_position(found, "bmu", GRID[1]).select(
        "vec_id", "bmu", "second", "row", "col", F.round("distance", 6).alias("distance")
    )


def som_quality(spark, d):
    found = Q.quality(scaled_lines(spark, d), _trained(spark, d))
    return found.select("n", *[F.round(c, 6).alias(c) for c in found.columns if c != "n"])


def som_by_fraction(spark, d):
    """CSV, scaling without centring, a sample of each fraction, training and both errors: one row per fraction."""
    path = scratch_path(spark, "samples-csv")
    D.write_csv(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *LINE_COLUMNS), path)
    read = D.read_csv(spark, path, ["order", "line", *LINE_COLUMNS])
    rows = P.standard_scale(read, LINE_COLUMNS).select(
        F.col("order").cast("bigint").alias("l_orderkey"), F.col("line").cast("bigint").alias("line"), P.vector(LINE_COLUMNS).alias("features")
    ).persist()
    fractions, start = [i / 10 for i in range(1, 11)], Codebook.random(spark, *GRID, 4, seed=3)
    copies = [S.PoissonDraw(tuple(LINE_KEY), f, 7) for f in fractions]
    books = train_soms(rows, [start] * len(fractions), 2, copies, sigma_0=2.0, tau=2.0)
    found = Q.qualities(rows, books, copies)
    fraction = F.element_at(F.array(*map(F.lit, fractions)), F.col("map") + 1).alias("fraction")
    return found.select(fraction, "n", *[F.round(c, 6).alias(c) for c in found.columns if c not in ("map", "n")])


def forest_large_nodes(spark, d):
    """The two-pass search of large nodes, reached by a low limit; equal to the outright search."""
    return nodes(train_forest(lines(spark, d), LINE_KEY, trees=3, seed=2, max_depth=3, outright_rows=1000), spark)


def even_groups_after_split(spark, d):
    """Groups drawn after a split with the same seed stay even: rows of each group."""
    train, _ = S.split(lines(spark, d), LINE_KEY, 90, seed=0)
    return S.assign_groups(train, LINE_KEY, 100, seed=0).groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"))


def som_clusters(spark, d):
    found = Q.clusters(scaled_lines(spark, d), _trained(spark, d))
    return found.withColumn("mean_distance", F.round("mean_distance", 6))


def som_weight_mosaic(spark, d):
    found = Q.weight_mosaic(spark, _embedding_map(spark, d), 8, 8)
    return found.withColumn("grey", F.round("grey", 4))


def som_distance_map(spark, d):
    found = Q.distance_map(spark, _trained(spark, d))
    return found.withColumn("mean_distance", F.round("mean_distance", 6))


def som_density_map(spark, d):
    return Q.density_map(scaled_lines(spark, d), _trained(spark, d), 0.35)


def som_classification(spark, d):
    rows, trained = embedding_samples(spark, d), _embedding_map(spark, d)
    return Q.classify(rows, trained, Q.label_units(rows, trained)).select("vec_id", "label", "bmu", "prediction")


def incremental_som(spark, d):
    """One streamed pass over the event file, blended into the map."""
    path = scratch_path(spark, "stream")
    job = IncrementalSom(Codebook.random(spark, *GRID, 2, 3), f"{path}/snapshots", sigma_0=2.0, eta_0=0.5, tau=4.0)
    job.start(_event_stream(spark, d), f"{path}/checkpoint", available_now=True).awaitTermination()
    return weights(load_snapshot(spark, f"{path}/snapshots", 0, *GRID), spark)


def incremental_som_batches(spark, d):
    """Three batches of events that arrive one after the other, the stream restarted from its checkpoint for each; the last map."""
    path = scratch_path(spark, "batches")
    events = table(spark, d, "events").select("event_id", "value", "ts")
    job = IncrementalSom(Codebook.random(spark, *GRID, 2, 3), f"{path}/snapshots", sigma_0=2.0, eta_0=0.5, tau=4.0)
    for i in range(BATCHES):
        events.where(F.pmod("event_id", F.lit(BATCHES)) == i).write.parquet(f"{path}/events/{i}")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/events/*").select("event_id", _event_features())
        job.start(stream, f"{path}/checkpoint", available_now=True).awaitTermination()
    return weights(load_snapshot(spark, f"{path}/snapshots", BATCHES - 1, *GRID), spark)


def streaming_scoring(spark, d):
    path = scratch_path(spark, "scored")
    scored = score_stream(_event_stream(spark, d), Codebook.random(spark, *GRID, 2, 3)).select(
        "event_id", "bmu", F.round("distance", 6).alias("distance")
    )
    query = (
        scored.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _event_stream(spark, d):
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return stream.select("event_id", _event_features())


def _event_features():
    return F.array(F.col("value") / 100.0, F.hour("ts").cast("double") / 24.0).alias("features")


# --- trees and forests -------------------------------------------------------


def split_candidates(spark, d):
    """Every candidate threshold at the root, with side counts and criterion."""
    rows = lines(spark, d).select(F.array(F.lit(0)).alias("at"), "features", F.col("label").cast("double").alias("y"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")).withColumn("slot", F.lit(0))
    root = Node(0, 0, 0, False, None, None, 0.0, 0, 0.0, None)
    level = Level(FlatTrees([root]), np.array([0]), np.array([0]), [np.empty(0)] * 4, 4, 0)
    found = candidates(value_counts(rows, level), total, "gini")
    return found.select(
        "feature", F.round("threshold", 6).alias("threshold"), "n_left", "s_left", "n_right", "s_right",
        F.round("criterion", 4).alias("criterion"),
    )


def root_split(spark, d):
    return nodes(TreeModel(train_trees(lines(spark, d), max_depth=2).nodes[:1]), spark)


def decision_tree(spark, d):
    return nodes(train_trees(lines(spark, d), max_depth=4), spark)


def decision_tree_min_samples(spark, d):
    return nodes(train_trees(order_samples(spark, d), max_depth=5, min_samples=200), spark)


def decision_tree_entropy(spark, d):
    return nodes(train_trees(order_samples(spark, d), max_depth=3, impurity="entropy"), spark)


def decision_tree_min_gain(spark, d):
    return nodes(train_trees(signal_lines(spark, d), max_depth=4, min_gain=0.0005), spark)


def regression_tree(spark, d):
    rows = table(spark, d, "lineitem").select(
        P.vector(["l_quantity", "l_discount", "l_tax"]).alias("features"), F.col("l_linenumber").cast("double").alias("label")
    )
    return nodes(train_trees(rows, max_depth=4, impurity="variance"), spark)


LINE_EDGES = [[10.0, 20.0, 30.0, 40.0], [20000.0, 40000.0, 60000.0, 80000.0], [0.025, 0.055], [0.015, 0.035, 0.055]]


def histogram_tree_default_edges(spark, d):
    """Cuts only at the quantile ranks of all rows, which the trainer selects itself."""
    return nodes(train_trees(lines(spark, d), max_depth=3, search="histogram"), spark)


def histogram_tree(spark, d):
    return nodes(train_trees(lines(spark, d), max_depth=4, search="histogram", edges=LINE_EDGES), spark)


def text_quality_tree(spark, d):
    """Word, character and capital-run features of the documents against their quality label."""
    texts = _texts(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    runs = [f"capital_run_length_{c}" for c in ("average", "longest", "total")]
    rows = texts.select(
        F.concat("word_freqs", "char_freqs", P.vector(runs)).alias("features"), F.col("quality").alias("label")
    )
    return nodes(train_trees(rows, max_depth=3), spark)


def tree_prediction(spark, d):
    model = train_trees(order_samples(spark, d), max_depth=4)
    return predict(order_samples(spark, d), model).select("o_orderkey", "label", "prediction")


def tree_expression_prediction(spark, d):
    model = train_trees(order_samples(spark, d), max_depth=4)
    return order_samples(spark, d).select("o_orderkey", tree_expression(model, 0).alias("prediction"))


def tree_accuracy(spark, d):
    train, test = S.split(lines(spark, d), LINE_KEY, 90, seed=4)
    found = E.accuracy(predict(test, train_trees(train, max_depth=4)))
    return found.withColumn("accuracy", F.round("accuracy", 6))


def _forest(spark, d):
    return train_forest(lines(spark, d), LINE_KEY, trees=5, seed=2, max_depth=4)


def random_forest(spark, d):
    return nodes(_forest(spark, d), spark)


def forest_votes(spark, d):
    found = predict_forest(lines(spark, d), _forest(spark, d))
    return found.select("l_orderkey", "line", "label", "votes", "prediction")


def forest_votes_expression(spark, d):
    model = train_forest(order_samples(spark, d), ["o_orderkey"], trees=3, seed=2, max_depth=3)
    return order_samples(spark, d).select("o_orderkey", votes_expression(model).alias("votes"))


def forest_accuracy(spark, d):
    found = E.accuracy(predict_forest(lines(spark, d), _forest(spark, d)))
    return found.select("n", "hits", F.round(100 * F.col("accuracy"), 6).alias("accuracy_percent"))


def forest_roc(spark, d):
    found = E.roc_points(predict_forest(lines(spark, d), _forest(spark, d)), "score")
    return found.withColumn("tpr", F.round("tpr", 6))


def value_roc(spark, d):
    events = table(spark, d, "events").select("value", F.when(F.col("event_type") == "click", 1).otherwise(0).alias("label"))
    return E.roc_points(events, "value").withColumn("tpr", F.round("tpr", 6))


def impurities(spark, d):
    """Gini, entropy and variance of the returned label per supplier."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    sums = rows.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")
    )
    return sums.selectExpr(
        "l_suppkey", *[f"round({impurity(k, 'n', 's', 'q')}, 8) as {k}" for k in ("gini", "entropy", "variance")]
    )


def _held_out(spark, d):
    train, test = S.split(signal_lines(spark, d), LINE_KEY, 70, seed=6)
    model = train_trees(train, max_depth=5)
    return model, prune.leaf_counts(test, model)


def validation_counts(spark, d):
    return _held_out(spark, d)[1].select("level", "node", "n", "n_pos")


def reduced_error_pruning(spark, d):
    return nodes(prune.reduced_error(*_held_out(spark, d)), spark)


def cost_complexity_pruning(spark, d):
    return nodes(prune.cost_complexity(*_held_out(spark, d))[0], spark)


def cost_complexity_sequence(spark, d):
    steps = prune.cost_complexity(*_held_out(spark, d))[1]
    data = [(i, *s) for i, s in enumerate(steps)]
    return spark.createDataFrame(data, "step int, tree_id int, leaves int, errors bigint, ratio double")


QUERIES = [
    csv_scan, whitespace_scan, label_by_position, in_memory_samples, uniform_vectors, model_round_trip,
    label_last, vector_round_trip, standard_scale, standard_scale_vectors, range_scale, attribute_lists, pivot_lists,
    encode_label, attribute_profile, class_distribution, missing_values, word_frequencies, char_frequencies, capital_runs,
    prefix_sum, prefix_sum_by_row, prefix_sum_with_criterion, stable_partition, row_positions, feature_argsort,
    gather, scatter, gather_labels, mark_members, flag_and_complement,
    argmin, argmin_by_row, argmin_of_arrays, argmin_two_dimensional, total, total_by_segment, weighted_means,
    poisson_sample, sample_fractions, holdout_split, random_groups, cross_validation, repeated_holdout,
    som_unit_sums, som_update_join, som_training, som_training_switched, som_training_subsets, som_by_fraction, forest_large_nodes, even_groups_after_split, som_best_units,
    som_quality, som_clusters, som_weight_mosaic, som_distance_map, som_density_map, som_classification,
    incremental_som, incremental_som_batches, streaming_scoring,
    split_candidates, root_split, decision_tree, decision_tree_min_samples, decision_tree_entropy, decision_tree_min_gain,
    regression_tree, histogram_tree, histogram_tree_default_edges, text_quality_tree, tree_prediction, tree_expression_prediction, tree_accuracy,
    random_forest, forest_votes, forest_votes_expression, forest_accuracy, forest_roc, value_roc, impurities,
    validation_counts, reduced_error_pruning, cost_complexity_pruning, cost_complexity_sequence,
]

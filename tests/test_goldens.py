"""Small cases worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graticule.functions.schedules import decayed
from graticule.operators.sampling import poisson_copies, sample_with_replacement
from graticule.operators.scans import stable_partition
from graticule.plans.forest import votes, votes_expression
from graticule.plans.som import Codebook, train_som, train_soms, unit_sums, update_table
from graticule.plans.som_quality import quality
from graticule.plans.tree import Node, TreeModel, train_trees
from graticule.sources.tables import from_rows


def grow(spark, values, labels, **options):
    return train_trees(from_rows(spark, [[v] for v in values], labels), **options).nodes


def test_attribute_list_cut(spark):
    root, left, right = grow(spark, [2.5, 4.7, 0.1, 1.0], [0, 0, 1, 1], max_depth=2)
    assert (root.threshold, root.criterion) == (1.75, 0.0)
    assert (left.label, right.label) == (1.0, 0.0)


def test_duplicate_values_cut_between_distinct_ones(spark):
    root = grow(spark, [1, 1, 2, 2], [0, 1, 1, 1], max_depth=2)[0]
    assert (root.threshold, root.criterion) == (1.5, 0.5)


def test_no_valid_split_is_a_majority_leaf(spark):
    assert [(n.is_split, n.label) for n in grow(spark, [3, 3, 3], [0, 1, 1])] == [(False, 1.0)]
    assert [(n.is_split, n.label) for n in grow(spark, [3, 3], [0, 1])] == [(False, 0.0)]


def test_depth_counts_levels(spark):
    assert len(grow(spark, [1, 2], [0, 1], max_depth=1)) == 1
    assert len(grow(spark, [1, 2], [0, 1], max_depth=2)) == 3


def test_min_samples(spark):
    assert len(grow(spark, [1, 2, 3], [0, 1, 1], max_depth=5, min_samples=3)) == 1


def test_ties_go_to_the_first_feature_and_value(spark):
    rows = from_rows(spark, [[1, 5], [2, 6], [3, 7]], [0, 1, 0])
    root = train_trees(rows, max_depth=2).nodes[0]
    assert (root.feature, root.threshold) == (0, 1.5)


def test_stable_partition(spark):
    flags = spark.createDataFrame(list(enumerate([False, True, False, True, True])), "pos int, flag boolean")
    found = stable_partition(flags, "flag", ["pos"], ranges=2).orderBy("pos").collect()
    assert [r["new_pos"] for r in found] == [0, 2, 1, 3, 4]


@pytest.mark.parametrize("ballots,won", [([1, 1, 0, 0], 0), ([1, 1, 1, 0], 1)])
def test_vote(spark, ballots, won):
    model = TreeModel([Node(i, 0, 0, False, None, None, float(b), 1, 0.0, None) for i, b in enumerate(ballots)])
    row = from_rows(spark, [[0.0]])
    counted = row.select(votes(model).alias("a"), votes_expression(model).alias("b")).first()
    assert counted["a"] == counted["b"] == sum(ballots)
    assert int(2 * counted["a"] > len(ballots)) == won


def test_sigma_schedule():
    assert decayed(0, 4, 0.1, 10, 5) == 4
    assert decayed(4, 4, 0.1, 10, 5) == pytest.approx(2.68128, abs=1e-5)
    assert [decayed(t, 4, 0.1, 10, 5) for t in (5, 9)] == [0.1, 0.1]
    assert decayed(50, 4, 0.1, 10) == pytest.approx(4 * math.exp(-5))


@pytest.mark.parametrize("sigma,expected", [(0.5, [0.0, 1.0]), (1.0, [0.23269654, 0.45186276])])
def test_map_step(spark, sigma, expected):
    rows = from_rows(spark, [[0.0], [0.0], [1.0]])
    start = Codebook(1, 2, np.array([[0.0], [1.0]]))
    trained = train_som(rows, 1, 2, 1, init=start, sigma_0=sigma)
    assert trained.weights[:, 0] == pytest.approx(expected, abs=1e-7)
    joined = update_table(unit_sums(rows, start), start.to_table(spark), sigma).orderBy("neuron").collect()
    assert [r["w"] for r in joined] == pytest.approx(expected, abs=1e-7)


def test_untouched_neurons_keep_their_weight(spark):
    start = Codebook(1, 3, np.array([[0.0], [5.0], [10.0]]))
    trained = train_som(from_rows(spark, [[0.0]]), 1, 3, 1, init=start, sigma_0=0.5)
    assert trained.weights[:, 0].tolist() == [0.0, 5.0, 10.0]


def test_quantization_error(spark):
    rows = from_rows(spark, [[0.0], [0.0], [1.0]])
    start = Codebook(1, 2, np.array([[0.0], [1.0]]))
    assert quality(rows, start).first()["quantization_error"] == 0
    after = train_som(rows, 1, 2, 1, init=start, sigma_0=1.0)
    assert quality(rows, after).first()["quantization_error"] == pytest.approx(0.337843, abs=1e-6)


@pytest.mark.parametrize(
    "rows,cols,weights,diagonal,adjacent",
    [
        (2, 2, [[0.0], [9.0], [9.0], [1.0]], 1, 1),  # units 0 and 3 touch at a corner
        (2, 2, [[0.0], [1.0], [9.0], [9.0]], 0, 1),  # units 0 and 1 share a side
        (1, 3, [[0.0], [9.0], [1.0]], 0, 0),  # units 0 and 2 do not touch
    ],
)
def test_adjacency(spark, rows, cols, weights, diagonal, adjacent):
    found = quality(from_rows(spark, [[0.0]]), Codebook(rows, cols, np.array(weights))).first()
    assert (found["diagonal_rate"], found["adjacent_rate"]) == (diagonal, adjacent)
    assert found["topographic_error"] == 1 - adjacent


def test_root_split_of_returned_lines(spark):
    from graticule.catalog.queries import lines

    root = train_trees(lines(spark, "/root/testdata/sf0.01"), max_depth=2).nodes
    assert root[0].feature == 1 and root[0].threshold == (3485.26 + 3488.72) / 2
    assert root[0].criterion == 13346.968097482333 and root[1].n == 1433


def test_text_features(spark):
    from graticule.functions.text import with_text_features

    text = "make MONEY! make it free; the ADdress (now)"
    row = with_text_features(spark.createDataFrame([(text,), ("",)], "text string"), "text").collect()
    words = row[0]["word_freqs"]
    assert words[0] == pytest.approx(100 * 2 / 8) and words[15] == pytest.approx(100 / 8)
    assert row[0]["char_freqs"][0] == pytest.approx(100 / len(text))
    assert row[0]["capital_run_length_total"] == 7 and row[0]["capital_run_length_longest"] == 5
    assert row[0]["capital_run_length_average"] == 3.5
    assert set(row[1]["word_freqs"]) == {0.0} and row[1]["capital_run_length_longest"] == 0


def test_maps_trained_together_are_those_trained_alone(spark):
    rows = spark.range(500).selectExpr("id", "array(id % 7 / 7.0D, id % 11 / 11.0D) as features").persist()
    books = [Codebook.random(spark, 2, 3, 2, seed=1), Codebook.random(spark, 4, 4, 2, seed=2), Codebook.random(spark, 2, 3, 2, seed=1)]
    options = {"sigma_0": 2.0, "tau": 2.0}
    copies = [poisson_copies(["id"], f, 7) for f in (0.3, 1.0, 2.5)]
    together = train_soms(rows, books, 3, copies, **options)
    for book, fraction, found in zip(books, (0.3, 1.0, 2.5), together):
        drawn = sample_with_replacement(rows, ["id"], fraction, 7)
        alone = train_som(drawn, book.rows, book.cols, 3, init=book, **options)
        assert np.allclose(alone.weights, found.weights, rtol=0, atol=1e-9)
    every = train_soms(rows, books[:1], 3, merge_groups=2, **options)[0]
    assert np.allclose(every.weights, train_som(rows, 2, 3, 3, init=books[0], **options).weights, rtol=0, atol=1e-9)


def test_maps_without_drawn_rows_stay_as_they_are(spark):
    rows = from_rows(spark, [[0.5, 0.5]])
    book = Codebook.random(spark, 1, 2, 2)
    none, some = train_soms(rows, [book, book], 1, [F.lit(None), F.lit(2)])
    assert np.allclose(none.weights, book.weights, rtol=0, atol=1e-9) and not np.allclose(some.weights, book.weights)
    assert train_soms(rows, [], 1) == []
    with pytest.raises(ValueError):
        train_soms(rows, [book, Codebook.random(spark, 1, 2, 3)], 1)

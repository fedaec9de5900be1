"""Properties that hold whatever the data, the partitioning and the search."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from graticule.functions.dense import combined, nearest, squared_distance, sums_by_group, term_by_term
from graticule.operators import sampling, scans
from graticule.plans import evaluate, prune, tree
from graticule.plans.forest import predict_forest, train_forest, votes, votes_expression
from graticule.plans.som import Codebook, train_som
from graticule.plans.som_quality import clusters
from graticule.plans.tree import TreeModel, predict, train_trees, tree_expression


@pytest.fixture(scope="module")
def samples(spark):
    """Noisy step data with ties, a constant feature and a value held by a third of all rows."""
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4)).round(2)
    x[:, 2] = 7.0
    x[rng.random(3000) < 0.34, 1] = 0.5
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] < 0.3) ^ (rng.random(3000) < 0.1)).astype(int)
    data = [(i, v.tolist(), int(t), i % 3) for i, (v, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id bigint, features array<double>, label int, tree_id int").persist()


@pytest.mark.parametrize("impurity", ["gini", "entropy", "variance"])
@pytest.mark.parametrize("limit", [500_000, 0])
def test_bounded_search_finds_the_same_trees(samples, monkeypatch, impurity, limit):
    plain = train_trees(samples, max_depth=5, impurity=impurity)
    monkeypatch.setattr(tree, "OUTRIGHT_ROWS", 100)
    monkeypatch.setattr(tree, "ROWS_PER_RANGE", 30)
    monkeypatch.setattr(tree, "BROADCAST_ROWS", limit)
    bounded = train_trees(samples, max_depth=5, impurity=impurity)
    assert len(bounded.nodes) == len(plain.nodes)
    for a, b in zip(bounded.nodes, plain.nodes):
        assert a[:6] == b[:6] and a.n == b.n
        assert a.s == pytest.approx(b.s)


def test_bounded_search_with_sparse_histograms(samples, monkeypatch):
    from graticule.operators import splits

    plain = train_trees(samples, max_depth=4)
    monkeypatch.setattr(tree, "OUTRIGHT_ROWS", 100)
    monkeypatch.setattr(tree, "ROWS_PER_RANGE", 30)
    monkeypatch.setattr(splits, "_DENSE_CELLS", 0)
    assert train_trees(samples, max_depth=4).nodes == plain.nodes


def brute_force(x, y, depth):
    """Reference tree by looping over every cut of one sample set."""
    out = []

    def grow(rows, level, node):
        n, s = len(rows), int(y[rows].sum())
        best = None
        if n > 1 and level < depth - 1 and s not in (0, n):
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for a, b in zip(values[:-1], values[1:]):
                    left = rows[x[rows, f] <= a]
                    nl, sl = len(left), float(y[left].sum())
                    score = sl * (nl - sl) / nl + (s - sl) * ((n - nl) - (s - sl)) / (n - nl)
                    if best is None or (score, f, a) < best[:3]:
                        best = (score, f, a, b)
        out.append((level, node, best is not None, None if best is None else best[1], None if best is None else (best[2] + best[3]) / 2, n, s))
        if best is not None:
            _, f, a, _ = best
            grow(rows[x[rows, f] <= a], level + 1, 2 * node)
            grow(rows[x[rows, f] > a], level + 1, 2 * node + 1)

    grow(np.arange(len(x)), 0, 0)
    return sorted(out, key=lambda r: (r[0], r[1]))


def test_tree_equals_brute_force(samples):
    some = samples.where("tree_id = 1")
    local = some.orderBy("id").collect()
    x, y = np.array([r["features"] for r in local]), np.array([r["label"] for r in local])
    found = [(r.level, r.node, r.is_split, r.feature, r.threshold, r.n, int(r.s)) for r in train_trees(some, max_depth=4).nodes]
    assert sorted(found, key=lambda r: (r[0], r[1])) == brute_force(x, y, 4)


def test_children_add_up_and_depth_is_a_prefix(samples):
    deep = train_trees(samples, max_depth=5)
    at = {(r.tree_id, r.level, r.node): r for r in deep.nodes}
    for r in deep.nodes:
        if r.is_split:
            left, right = at[r.tree_id, r.level + 1, 2 * r.node], at[r.tree_id, r.level + 1, 2 * r.node + 1]
            assert (left.n + right.n, left.s + right.s) == (r.n, r.s)
    shallow = train_trees(samples, max_depth=3)
    key = lambda r: (r.tree_id, r.level, r.node)
    assert sorted(shallow.nodes, key=key) == sorted(deep.truncated(3).nodes, key=key)


def test_partitioning_does_not_matter(samples):
    one, many = samples.repartition(1), samples.repartition(16)
    assert train_trees(one, max_depth=4).nodes == train_trees(many, max_depth=4).nodes
    a = train_som(one, 2, 3, 3, width=4, sigma_0=1.5, tau=3.0, seed=1).weights
    assert a == pytest.approx(train_som(many, 2, 3, 3, width=4, sigma_0=1.5, tau=3.0, seed=1).weights)
    picked = [sorted(r["id"] for r in sampling.sample_with_replacement(s, ["id"], 0.7, 3).collect()) for s in (one, many)]
    assert picked[0] == picked[1]


def test_forest_of_one_is_the_tree(samples):
    alone = samples.drop("tree_id")
    assert train_forest(alone, ["id"], trees=1, max_depth=4).nodes == train_trees(alone, max_depth=4).nodes


def test_prediction_forms_agree(spark, samples):
    model = train_trees(samples, max_depth=3)
    rows = predict(samples, model)
    for t in (0, 1, 2):
        same = rows.where(F.col("tree_id") == t).where(F.col("prediction") != tree_expression(model, t))
        assert same.count() == 0
    assert samples.where(votes(model) != votes_expression(model)).count() == 0
    assert TreeModel.from_table(model.to_table(spark)).nodes == model.nodes
    unknown = samples.withColumn("tree_id", F.lit(99))
    assert predict(unknown, model).where("prediction is not null").count() == 0


def test_empty_group_gives_no_tree_and_no_vote(samples):
    alone = samples.drop("tree_id").where("id < 5")
    model = train_forest(alone, ["id"], trees=50, max_depth=3)
    assert 0 < len(model.tree_ids) <= 5
    assert predict_forest(alone, model).where(F.col("score") > 1).count() == 0


def test_empty_input_gives_no_trees(samples):
    assert train_trees(samples.where("id < 0")).nodes == []


def test_labels_outside_zero_one_are_refused(samples):
    with pytest.raises(ValueError):
        train_trees(samples.withColumn("label", F.col("label") * 2))


def test_cross_validation_tests_every_row_once(samples):
    found, model = evaluate.cross_validate(samples.drop("tree_id"), ["id"], folds=4, max_depth=4)
    assert model.tree_ids == [0, 1, 2, 3]
    assert found.agg(F.sum("n")).first()[0] == 3000
    assert found.agg(F.avg("accuracy")).first()[0] > 0.8


def test_clusters_hold_every_row(samples):
    book = train_som(samples, 2, 3, 2, width=4, sigma_0=1.5, tau=3.0)
    assert clusters(samples, book).agg(F.sum("n")).first()[0] == 3000


def test_wide_vectors_merge_as_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.random((60, 300))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(3)
    book = train_som(rows, 2, 2, 2, sigma_0=1.0, tau=5.0, seed=4)
    w = Codebook.random(spark, 2, 2, 300, 4).weights
    for t in range(2):
        s2 = (1.0 * np.exp(-t / 5.0)) ** 2
        bmu = term_by_term(x, w).argmin(1)
        i = np.arange(4)
        g = (i[:, None] // 2 - bmu // 2) ** 2 + (i[:, None] % 2 - bmu % 2) ** 2
        h = np.where(g <= s2, np.exp(-g / (2 * s2)), 0.0)
        w = np.where(h.sum(1)[:, None] > 0, h @ x / np.maximum(h.sum(1), 1e-300)[:, None], w)
    assert book.weights == pytest.approx(w)


def test_running_sums_equal_a_plain_window(spark):
    rng = np.random.default_rng(2)
    data = [
        (i, [None, "a", "hot", "hot", "hot"][int(rng.integers(5))], int(rng.integers(100)), [None, float("nan"), 1.0, 2.5, -3.0][int(rng.integers(5))])
        for i in range(2000)
    ]
    df = spark.createDataFrame(data, "id int, g string, v long, o double").repartition(5)
    window = Window.partitionBy("g").orderBy("o", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("run", F.sum("v").over(window)).withColumn("all", F.sum("v").over(Window.partitionBy("g")))
    for ranges in (1, 4):
        found = scans.running_sums(df, {"run": "v"}, ["o", "id"], ["g"], totals={"all": "v"}, ranges=ranges)
        assert found.exceptAll(plain).count() == 0 and plain.exceptAll(found).count() == 0


@pytest.mark.parametrize("long_run", [3, 65_536])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_running_sums_over_tasks_batches_and_types(spark, long_run, batch):
    """Groups inside a batch, over batches and over tasks; integer, double and decimal sums; string and date orders."""
    rng = np.random.default_rng(4)
    data = [(i, "hot" if i % 3 else f"g{int(rng.integers(400))}", int(rng.integers(-9, 9)) if i % 13 else None) for i in range(3000)]
    df = spark.createDataFrame(data, "id int, g string, v int").selectExpr(
        "id", "g", "v", "coalesce(v, 0) / 4 as d", "cast(v as decimal(9, 2)) / 2 as m", "concat('k', lpad(id % 500, 4, '0')) as s", "date_add(date'2020-01-01', id) as day"
    ).repartition(3)
    window = Window.partitionBy("g").orderBy("s", "day").rowsBetween(Window.unboundedPreceding, 0)
    plain = df
    for c in ("v", "d", "m"):
        plain = plain.withColumn(f"run_{c}", F.coalesce(F.sum(c).over(window), F.lit(0)))
    plain = plain.withColumn("all_v", F.coalesce(F.sum("v").over(Window.partitionBy("g")), F.lit(0))).withColumn("all_m", F.coalesce(F.sum("m").over(Window.partitionBy("g")), F.lit(0)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = scans.running_sums(
            df, {"run_v": "v", "run_d": "d", "run_m": "m"}, ["s", "day"], ["g"], totals={"all_v": "v", "all_m": "m"}, ranges=9, long_run=long_run
        )
        key = lambda r: r["id"]
        assert [tuple(r) for r in sorted(found.collect(), key=key)] == [tuple(r) for r in sorted(plain.collect(), key=key)]
        only = scans.running_sums(df, {"run_v": "v"}, ["s", "day"], ["g"], ranges=9, long_run=long_run)
        assert only.select("id", "run_v").exceptAll(plain.select("id", "run_v")).count() == 0
        both = only.union(only).groupBy("id").agg(F.count_distinct("run_v").alias("n"), F.count("*").alias("c")).where("n > 1 or c != 2")
        assert both.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_rows_of_one_first_value_spread_over_all_tasks(spark):
    df = spark.range(200_000).select("id", F.lit("same").alias("o"), (F.col("id") % 7).alias("v")).persist()  # cached rows draw other ranges each time
    found = scans.running_sums(df, {"run": "v"}, ["o", "id"], totals={"all": "v"}, ranges=8)
    sizes = found._jdf.queryExecution().toString().count("Exchange rangepartitioning")
    assert sizes == 0  # the rows are not dealt out again
    assert found.where("run != (id div 7) * 21 + ((id % 7) * (id % 7 + 1)) div 2").count() == 0 and found.where(f"all != {sum(i % 7 for i in range(200_000))}").count() == 0
    ranged = df.repartitionByRange(8, "o", "id").groupBy(F.spark_partition_id()).count().collect()
    assert len(ranged) == 8 and max(r["count"] for r in ranged) < 60_000


def test_running_sums_survive_without_broadcast(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = scans.positions(df, ["id"], ["g"], ranges=7)
        assert found.where("pos != id div 3").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_poisson_sample_has_the_right_rates(spark):
    copies = spark.range(200_000).select(sampling.poisson_copies(["id"], 1.0, 3).alias("c")).groupBy("c").count().collect()
    share = {r["c"]: r["count"] / 200_000 for r in copies}
    for k, p in [(0, 0.367879), (1, 0.367879), (2, 0.18394), (3, 0.061313)]:
        assert share[k] == pytest.approx(p, abs=0.005)


def test_reduced_error_never_adds_errors(samples):
    train, test = sampling.split(samples, ["id"], 60, seed=1)
    model = train_trees(train, max_depth=6)
    counts = prune.leaf_counts(test, model)
    smaller = prune.reduced_error(model, counts)
    assert len(smaller.nodes) < len(model.nodes)
    errors = [predict(test, m).where("prediction != label").count() for m in (model, smaller)]
    assert errors[1] <= errors[0]


def test_cost_complexity_equals_brute_force(samples):
    train, test = sampling.split(samples.where("tree_id = 0"), ["id"], 60, seed=1)
    model = train_trees(train, max_depth=5)
    best, steps = prune.cost_complexity(model, prune.leaf_counts(test, model))
    rows = [(np.array(r["features"]), r["label"]) for r in test.collect()]

    def errors(nodes):
        at = {(r.level, r.node): r for r in nodes}
        wrong = 0
        for x, y in rows:
            level, node = 0, 0
            while at[level, node].is_split:
                r = at[level, node]
                node = 2 * node + int(x[r.feature] > r.threshold)
                level += 1
            wrong += at[level, node].label != y
        return wrong

    def collapse(nodes, top):
        below = lambda r: r.level > top.level and r.node >> (r.level - top.level) == top.node
        return [r.as_leaf() if r == top else r for r in nodes if not below(r)]

    leaves = lambda nodes: sum(not r.is_split for r in nodes)
    nodes, expected = list(model.nodes), [(leaves(model.nodes), errors(model.nodes))]
    while any(r.is_split for r in nodes):
        e, k = errors(nodes), leaves(nodes)
        options = []
        for r in nodes:
            if r.is_split:
                cut = collapse(nodes, r)
                options.append(((errors(cut) - e) / (k - leaves(cut)), r.level, r.node, cut))
        nodes = min(options, key=lambda o: o[:3])[3]
        expected.append((leaves(nodes), errors(nodes)))
    assert [(s[1], s[2]) for s in steps] == expected
    assert errors(best.nodes) == min(e for _, e in expected)


@given(st.integers(1, 40), st.integers(2, 9), st.integers(1, 5), st.integers(0, 10_000))
@settings(max_examples=60, deadline=None)
def test_nearest_is_the_lowest_index_of_the_smallest_distance(n, k, d, seed):
    rng = np.random.default_rng(seed)
    x, w = rng.integers(0, 3, (n, d)).astype(float), rng.integers(0, 3, (k, d)).astype(float)
    index = nearest(x, w, 2)
    exact = term_by_term(x, w)
    order = np.argsort(exact, axis=1, kind="stable")[:, :2]
    assert (index == order).all()
    assert (nearest(x, w)[:, 0] == order[:, 0]).all()
    assert squared_distance(x, w, index[:, 0]) == pytest.approx(np.take_along_axis(exact, order, 1)[:, 0])


@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(0, 1)), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_combined_keeps_counts(entries):
    key, value, y = (np.array(c, float) for c in zip(*entries))
    k, v, m, q = combined(key.astype(int), value, y)
    assert m.sum() == len(entries) and q.sum() == y.sum()
    assert len(set(zip(k, v))) == len(k)
    ids, n, s = sums_by_group(value[:, None], key.astype(int))
    assert n.sum() == len(entries) and s.sum() == pytest.approx(value.sum())


def test_trees_that_share_rows_equal_trees_over_copied_rows(spark, samples):
    """An array of tree ids, read once, gives the trees of rows repeated per tree; also where finished rows are written off."""
    marked = samples.drop("tree_id").withColumn("fold", (F.col("id") % 4).cast("int"))
    shared = train_trees(marked.withColumn("tree_ids", sampling.other_folds(4)), max_depth=7, min_samples=40)
    copied = train_trees(marked.withColumn("tree_id", F.explode(sampling.other_folds(4))), max_depth=7, min_samples=40)
    assert shared.nodes == copied.nodes and shared.tree_ids == [0, 1, 2, 3] and shared.depth > 4


@pytest.mark.parametrize("kind", ["gini", "entropy", "variance"])
def test_array_criteria_equal_the_sql_ones(spark, kind):
    from graticule.functions.impurity import criterion
    from graticule.operators.splits import criterion_of

    rng = np.random.default_rng(8)
    n = rng.integers(1, 50, 300)
    n_left = rng.integers(0, n + 1)
    s_left, s_right = rng.binomial(n_left, 0.4).astype(float), rng.binomial(n - n_left, 0.4).astype(float)
    found = criterion_of(kind, n_left, s_left, n, s_left + s_right)
    rows = spark.createDataFrame([(i, int(a), float(b), int(c), float(d)) for i, (a, b, c, d) in enumerate(zip(n_left, s_left, n, s_left + s_right))], "i int, n_left long, s_left double, n long, s double")
    wanted = [r[0] for r in rows.orderBy("i").selectExpr(criterion(kind, "n_left", "s_left")).collect()]
    assert found == pytest.approx(wanted, abs=1e-12)


def _random_tree(depth, seed):
    from graticule.plans.prune import _Branch
    from graticule.plans.tree import Node

    rng, tree = np.random.default_rng(seed), {}

    def grow(level, node):
        split = level < depth - 1 and (level < 2 or rng.random() < 0.97)
        tree[0, level, node] = b = _Branch(Node(0, level, node, split, 0 if split else None, 0.0, float(rng.random() < 0.5), 0, 0.0, None))
        if split:
            kids = [grow(level + 1, 2 * node), grow(level + 1, 2 * node + 1)]
            b.n, b.pos = sum(k.n for k in kids), sum(k.pos for k in kids)
        else:
            b.n = int(rng.integers(0, 9))
            b.pos = int(rng.integers(0, b.n + 1))
        return b

    grow(0, 0)
    return tree


@pytest.mark.parametrize("seed", range(5))
def test_weakest_links_equal_a_full_search_at_every_step(seed):
    from graticule.plans.prune import _settle, _weakest_links

    tree, steps = _random_tree(6, seed), []
    live = {k for k, b in tree.items() if b.row.is_split}
    while True:
        for k in sorted(tree, key=lambda k: -k[1]):
            _settle(tree, k)
        live = {k for k in live if not any(tree.get((0, k[1] - u, k[2] >> u)).collapsed for u in range(k[1] + 1))}
        if not live:
            break
        steps.append(min(((tree[k].leaf_errors - tree[k].errors) / (tree[k].leaves - 1), k[1], k[2]) for k in live))
        tree[0, steps[-1][1], steps[-1][2]].collapsed = True
    found = _weakest_links(_random_tree(6, seed))
    assert [(r, *key[1:]) for key, _, _, r in found[1:]] == steps and len(steps) > 5


def test_weakest_links_of_a_large_tree():
    import time

    from graticule.plans.prune import _weakest_links

    tree = _random_tree(17, 3)
    start = time.perf_counter()
    steps = _weakest_links(tree)
    splits = sum(b.row.is_split for b in tree.values())
    assert splits > 20_000 and steps[-1][1] == 1 and time.perf_counter() - start < 30


def test_trees_do_not_depend_on_partitioning(samples):
    assert train_trees(samples.repartition(3), max_depth=6).nodes == train_trees(samples.repartition(11), max_depth=6).nodes

"""The SQL each registered query is checked against, run on the same tables."""

from __future__ import annotations

import math

from graticule.catalog.queries import BATCHES, GRID, LINE_EDGES
from graticule.catalog.sql import (
    group_of,
    hashed,
    random_codebook,
    step_ctes,
    tree_ctes,
    unit,
    units_cte,
    walk_ctes,
)
from graticule.functions.schedules import decayed
from graticule.functions.text import CHARACTERS, WORDS
from graticule.operators.sampling import FOLDS_SALT, GROUPS_SALT

ROWS, COLS = GRID
K = ROWS * COLS

LINES = (
    "(SELECT l_orderkey, l_linenumber::BIGINT AS line, [l_quantity, l_extendedprice, l_discount, l_tax] AS x, "
    "(l_returnflag = 'R')::INTEGER AS y FROM lineitem)"
)
SIGNAL = (
    "(SELECT l_orderkey, l_linenumber::BIGINT AS line, [l_quantity, l_extendedprice, l_discount, l_tax] AS x, "
    "((l_quantity > 25) <> (l_orderkey % 7 = 0))::INTEGER AS y FROM lineitem)"
)
ORDERS = (
    "(SELECT o_orderkey, [o_totalprice, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE] AS x, "
    "(o_orderstatus = 'F')::INTEGER AS y FROM orders)"
)
SCALED = (
    "(SELECT row_number() OVER () AS id, l_orderkey, l_linenumber::BIGINT AS line, "
    "[(l_quantity - q0) / (q1 - q0), (l_extendedprice - p0) / (p1 - p0), (l_discount - d0) / (d1 - d0), "
    "(l_tax - t0) / (t1 - t0)] AS x FROM lineitem, (SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, "
    "min(l_extendedprice) AS p0, max(l_extendedprice) AS p1, min(l_discount) AS d0, max(l_discount) AS d1, "
    "min(l_tax) AS t0, max(l_tax) AS t1 FROM lineitem))"
)
EMBEDDINGS = "(SELECT vec_id AS id, label, list_transform(embedding, lambda v: (v::DOUBLE + 1) / 2) AS x FROM embeddings)"
EVENTS = "(SELECT event_id AS id, [value / 100.0, hour(ts)::DOUBLE / 24.0] AS x FROM events)"

NODES = (
    "SELECT tree_id::INTEGER AS tree_id, level::INTEGER AS level, node, is_split, feature, round(threshold, 6) AS threshold, "
    "round(label, 6) AS label, n, round(s, 4) AS s, round(criterion, 4) AS criterion FROM nodes"
)


def _sigma(t: int, start: float, tau: float) -> float:
    return start * math.exp(-t / tau)


def _weights(codebook: str, scale: str = "") -> str:
    return (
        f"SELECT (neuron // {COLS})::INTEGER AS row, (neuron % {COLS})::INTEGER AS col, k::INTEGER AS component, "
        f"round(v{scale}, 6) AS weight FROM (SELECT neuron, unnest(w) AS v, unnest(range(len(w))) AS k FROM {codebook})"
    )


def _line_map() -> str:
    """CTEs up to ``cb2``: two iterations on the scaled line items."""
    return ",\n".join(
        [
            f"base AS (SELECT id, x FROM {SCALED})",
            random_codebook(K, 4, 3),
            step_ctes("base", COLS, _sigma(0, 2.0, 2.0), "cb0", "cb1"),
            step_ctes("base", COLS, _sigma(1, 2.0, 2.0), "cb1", "cb2"),
        ]
    )


def _embedding_map() -> str:
    """CTEs up to ``cb3``: three iterations, sigma fixed from the third on."""
    return ",\n".join(
        [
            f"base AS (SELECT id, x FROM {EMBEDDINGS})",
            random_codebook(K, 64, 2),
            step_ctes("base", COLS, _sigma(0, 2.0, 4.0), "cb0", "cb1"),
            step_ctes("base", COLS, _sigma(1, 2.0, 4.0), "cb1", "cb2"),
            step_ctes("base", COLS, 0.5, "cb2", "cb3"),
        ]
    )


def _copies(fraction: float) -> str:
    """Draws of a Poisson sample as a sum over the cut points of its distribution function."""
    cuts, mass, below = [], math.exp(-fraction), 0.0
    for k in range(1, 60):
        if below + mass >= 1.0 - 2.0**-53:
            break
        below += mass
        cuts.append(f"(u >= {below!r}::DOUBLE)::INTEGER")
        mass *= fraction / k
    return " + ".join(cuts)


def _tree(base: str, width: int, depth: int, **kw) -> str:
    return f"WITH base AS (SELECT 0 AS tree_id, x, y FROM {base}),\n{tree_ctes('base', width, depth, **kw)}\n{NODES}"


def _forest_ctes(base: str, keys: list[str], trees: int, seed: int, width: int, depth: int) -> str:
    grouped = hashed(base, keys, str(seed + GROUPS_SALT))
    return (
        f"marked AS (SELECT row_number() OVER () AS id, *, {group_of('h', trees)} AS tree_id FROM {grouped}),\n"
        f"{tree_ctes('marked', width, depth)},\n"
        f"asked AS (SELECT m.id, t.tree_id, m.x, m.y FROM marked m, (SELECT DISTINCT tree_id FROM nodes) t),\n"
        f"{walk_ctes('asked', depth)},\n"
        f"votes AS (SELECT id, sum(label)::INTEGER AS votes, count(*) AS trees FROM p_reached GROUP BY id),\n"
        f"judged AS (SELECT m.*, v.votes, v.trees, (2 * v.votes > v.trees)::INTEGER AS prediction "
        "FROM marked m JOIN votes v USING (id))"
    )


def _line_forest() -> str:
    return _forest_ctes(LINES, ["l_orderkey", "line"], 5, 2, 4, 4)


def _roc(rows: str) -> str:
    return (
        f"per AS (SELECT score, sum((y = 1)::INT) AS pos, sum((y <> 1)::INT) AS neg FROM {rows} GROUP BY score),\n"
        "run AS (SELECT sum(pos) OVER w / (SELECT sum(pos) FROM per) AS tpr, sum(neg) OVER w / (SELECT sum(neg) FROM per) AS fpr "
        "FROM per WINDOW w AS (ORDER BY score DESC))\n"
        "SELECT r.max_fpr, round(coalesce(max(tpr) FILTER (WHERE fpr <= r.max_fpr), 0), 6) AS tpr FROM run, "
        "(SELECT unnest([0.01::DOUBLE, 0.02, 0.05, 0.1, 0.2]) AS max_fpr) r GROUP BY r.max_fpr"
    )


def _held_out() -> str:
    """CTEs ``nodes`` (five levels on the 70 % part) and ``reached`` counts of the rest."""
    marked = hashed(SIGNAL, ["l_orderkey", "line"], "6")
    return (
        f"marked AS (SELECT row_number() OVER () AS id, 0 AS tree_id, x, y, {group_of('h', 100)} < 70 AS is_train FROM {marked}),\n"
        "train AS (SELECT * FROM marked WHERE is_train), test AS (SELECT * FROM marked WHERE NOT is_train),\n"
        f"{tree_ctes('train', 4, 5)},\n{walk_ctes('test', 5)},\n"
        "reached AS (SELECT level, node, count(*) AS n, sum(y)::BIGINT AS n_pos FROM p_reached GROUP BY level, node)"
    )


def _reduced_error() -> str:
    parts = [
        _held_out(),
        "tried AS (SELECT a.level, a.node, a.is_split, "
        "coalesce(sum(CASE WHEN a.label < 0.5 THEN r.n_pos ELSE r.n - r.n_pos END), 0) AS own "
        "FROM nodes a LEFT JOIN reached r ON r.level >= a.level AND (r.node >> (r.level - a.level)::INT) = a.node "
        "GROUP BY a.level, a.node, a.is_split)",
        "e4 AS (SELECT level, node, true AS leafy, own AS errors FROM tried WHERE level = 4)",
    ]
    for i in (3, 2, 1, 0):
        parts.append(
            f"e{i} AS (SELECT t.level, t.node, CASE WHEN NOT t.is_split THEN true ELSE l.leafy AND r.leafy AND "
            f"t.own <= l.errors + r.errors END AS leafy, CASE WHEN NOT t.is_split OR (l.leafy AND r.leafy AND "
            f"t.own <= l.errors + r.errors) THEN t.own ELSE l.errors + r.errors END AS errors FROM tried t "
            f"LEFT JOIN e{i + 1} l ON l.node = 2 * t.node LEFT JOIN e{i + 1} r ON r.node = 2 * t.node + 1 WHERE t.level = {i})"
        )
    parts.append("judged AS (" + " UNION ALL ".join(f"SELECT * FROM e{i}" for i in range(5)) + ")")
    parts.append(
        "kept AS (SELECT a.*, j.leafy FROM nodes a JOIN judged j USING (level, node) WHERE NOT EXISTS (SELECT 1 FROM judged u "
        "WHERE u.leafy AND u.level < a.level AND (a.node >> (a.level - u.level)::INT) = u.node))"
    )
    return (
        "WITH " + ",\n".join(parts) + "\nSELECT tree_id::INTEGER AS tree_id, level::INTEGER AS level, node, NOT leafy AS is_split, "
        "CASE WHEN NOT leafy THEN feature END AS feature, CASE WHEN NOT leafy THEN round(threshold, 6) END AS threshold, "
        "round(label, 6) AS label, n, round(s, 4) AS s, CASE WHEN NOT leafy THEN round(criterion, 4) END AS criterion FROM kept"
    )


def _batches(stream: str) -> str:
    """The map blended over three batches, sigma and eta decaying from one to the next."""
    parts, before = [stream], "cb0"
    for t in range(BATCHES):
        eta = decayed(t, 0.5, 0.01, 4.0)
        parts.append(f"e{t} AS (SELECT * FROM base WHERE id % {BATCHES} = {t})")
        parts.append(step_ctes(f"e{t}", COLS, decayed(t, 2.0, 0.1, 4.0), before, f"t{t}"))
        parts.append(
            f"mixed{t} AS (SELECT a.neuron, list_transform(list_zip(a.w, b.w), lambda p: p[1] + {eta!r} * (p[2] - p[1])) AS w "
            f"FROM {before} a JOIN t{t} b USING (neuron))"
        )
        before = f"mixed{t}"
    return ",\n".join(parts) + f"\n{_weights(before)}"


def _ranked_tree(ranges: int = 32, most: int = 64) -> str:
    """The histogram tree whose edges are the values of ranks k n / ranges, and the next value after one that fills a range."""
    edge = lambda f, k: f"coalesce((SELECT v FROM edges WHERE feature = {f} AND k = {k}), 'Infinity'::DOUBLE)"
    edges = [[edge(f, k) for k in range(1, most + 1)] for f in range(4)]
    return f"""
    WITH vals AS (SELECT feature, x[feature + 1] AS v, count(*) AS c FROM {LINES}, (SELECT unnest(range(4)) AS feature) GROUP BY ALL),
    runs AS (SELECT *, sum(c) OVER w AS upto, sum(c) OVER (PARTITION BY feature) AS n, lead(v) OVER w AS after FROM vals WINDOW w AS (PARTITION BY feature ORDER BY v)),
    crossed AS (SELECT * FROM runs WHERE least(upto * {ranges} // n, {ranges - 1}) > (upto - c) * {ranges} // n),
    every AS (SELECT feature, v FROM crossed UNION SELECT feature, after FROM crossed WHERE c * {ranges} >= n AND after IS NOT NULL),
    edges AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS k FROM every),
    base AS (SELECT 0 AS tree_id, x, y FROM {LINES}),
    {tree_ctes("base", 4, 3, edges=edges)}
    {NODES}"""


def _cross_validation() -> str:
    marked = hashed(LINES, ["l_orderkey", "line"], str(1 + FOLDS_SALT))
    return (
        f"WITH marked AS (SELECT row_number() OVER () AS id, x, y, {group_of('h', 10)} AS fold FROM {marked}),\n"
        "train AS (SELECT t.tree_id, x, y FROM marked, (SELECT unnest(range(10))::INTEGER AS tree_id) t WHERE tree_id <> fold),\n"
        f"{tree_ctes('train', 4, 4)},\n"
        f"asked AS (SELECT id, fold AS tree_id, x, y FROM marked),\n{walk_ctes('asked', 4)}\n"
        "SELECT tree_id AS fold, count(*) AS n, sum((label = y)::INT)::BIGINT AS hits, "
        "round(sum((label = y)::INT) / count(*), 6) AS accuracy FROM p_reached GROUP BY tree_id"
    )


def _repeated_holdout() -> str:
    """Three seeds x three depths, every forest grown separately from its own rows."""
    ctes, picks = [], []
    for seed in (0, 1, 2):
        ctes.append(
            f"drawn{seed} AS (SELECT o_orderkey AS id, x, y, {group_of('h', 100)} AS pick, {group_of('g', 4)} AS tree_id FROM "
            + hashed(hashed(ORDERS, ["o_orderkey"], str(seed)), ["o_orderkey"], str(seed + GROUPS_SALT), "g")
            + ")"
        )
    runs = " UNION ALL ".join(f"SELECT {s} AS seed, * FROM drawn{s}" for s in (0, 1, 2))
    ctes.append(f"runs AS ({runs})")
    ctes.append("train AS (SELECT seed * 4 + tree_id AS tree_id, x, y FROM runs WHERE pick < 90)")
    ctes.append(tree_ctes("train", 2, 4))
    ctes.append("asked AS (SELECT seed * 1000000000 + id AS id, t.tree_id, x, y FROM (SELECT * FROM runs WHERE pick >= 90) r, "
                "(SELECT DISTINCT tree_id FROM nodes) t WHERE t.tree_id // 4 = r.seed)")
    for depth in (2, 3, 4):
        ctes.append(
            f"nodes{depth} AS (SELECT tree_id, level, node, is_split AND level < {depth - 1} AS is_split, feature, threshold, label "
            f"FROM nodes WHERE level < {depth})"
        )
        ctes.append(walk_ctes("asked", depth, f"nodes{depth}", f"d{depth}"))
        picks.append(
            f"SELECT tree_seed AS seed, {depth} AS depth, count(*) AS n, sum((p = y)::INT)::BIGINT AS hits, "
            f"round(sum((p = y)::INT) / count(*), 6) AS accuracy FROM (SELECT id, (any_value(tree_id) // 4)::INTEGER AS tree_seed, "
            f"any_value(y) AS y, (2 * sum(label) > count(*))::INT AS p FROM d{depth}_reached GROUP BY id) GROUP BY tree_seed"
        )
    return "WITH " + ",\n".join(ctes) + "\n" + " UNION ALL ".join(picks)


def _adjacency(units: str = "u", first: str = "") -> str:
    dr, dc = f"abs(bmu // {COLS} - second // {COLS})", f"abs(bmu % {COLS} - second % {COLS})"
    near = f"({dr} <= 1 AND {dc} <= 1 AND {dr} + {dc} > 0)::INT"
    return (
        f"SELECT {first}count(*) AS n, round(avg(distance), 6) AS quantization_error, "
        f"round(avg(({dr} = 1 AND {dc} = 1)::INT), 6) AS diagonal_rate, round(avg({near}), 6) AS adjacent_rate, "
        f"round(1 - avg({near}), 6) AS topographic_error FROM {units}"
    )


def _text_features() -> str:
    freq = "100.0::DOUBLE * len(list_filter(tok, lambda t: t = '{}')) / len(tok)"
    words = ", ".join(f"CASE WHEN len(tok) > 0 THEN {freq.format(w)} ELSE 0 END" for w in WORDS)
    chars = ", ".join(
        f"CASE WHEN length(text) > 0 THEN 100.0::DOUBLE * (length(text) - length(replace(text, '{c}', ''))) / length(text) ELSE 0 END"
        for c in CHARACTERS
    )
    return (
        "tok AS (SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS tok, "
        "list_transform(regexp_extract_all(text, '\\p{Lu}+'), lambda r: length(r)) AS runs FROM documents),\n"
        f"feats AS (SELECT doc_id, [{words}]::DOUBLE[] AS word_freqs, [{chars}]::DOUBLE[] AS char_freqs, "
        "CASE WHEN len(runs) > 0 THEN list_sum(runs)::DOUBLE / len(runs) ELSE 0 END AS run_average, "
        "coalesce(list_max(runs), 0)::INTEGER AS run_longest, coalesce(list_sum(runs), 0)::BIGINT AS run_total FROM tok)"
    )


def _argsort() -> str:
    return (
        "s AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, "
        "row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS pos FROM events)"
    )


def oracle_sql() -> dict[str, str]:
    order_walk = (
        f"WITH base AS (SELECT o_orderkey AS id, 0 AS tree_id, x, y FROM {ORDERS}),\n{tree_ctes('base', 2, 4)},\n{walk_ctes('base', 4)}"
    )
    words = ", ".join(f"'{w}'" for w in WORDS)
    chars = ", ".join(f"'{c}'" for c in CHARACTERS)
    columns = "l_quantity, l_extendedprice, l_discount, l_tax"
    std = ", ".join(f"round({c} / (SELECT stddev_samp({c}) FROM lineitem), 6) AS {c}" for c in columns.split(", "))
    profile = " UNION ALL ".join(
        f"SELECT '{c}' AS attribute, count({c}) AS n, min({c}) AS min_value, max({c}) AS max_value, "
        f"round(avg({c}), 6) AS mean_value, round(stddev_samp({c}), 6) AS std_value, "
        f"round(100 * stddev_samp({c}) / avg({c}), 6) AS cv_percent FROM lineitem"
        for c in columns.split(", ")
    )
    u_orders = f"(SELECT o_orderkey, o_custkey, {unit('h')} AS u FROM {hashed('orders', ['o_orderkey'], '7')})"
    fractions = " UNION ALL ".join(
        f"SELECT {i / 10}::DOUBLE AS fraction, sum({_copies(i / 10)})::BIGINT AS n FROM {u_orders}" for i in range(1, 11)
    )
    sampled_step = []
    for t in (0, 1):
        picked = hashed(SCALED, ["l_orderkey", "line"], str(3 + t))
        sampled_step.append(
            f"base{t} AS (SELECT row_number() OVER () AS id, x FROM (SELECT x, unnest(range({_copies(0.5)})) AS copy "
            f"FROM (SELECT x, {unit('h')} AS u FROM {picked})))"
        )
        sampled_step.append(step_ctes(f"base{t}", COLS, _sigma(t, 2.0, 2.0), f"cb{t}", f"cb{t + 1}"))
    subsets = "WITH " + random_codebook(K, 4, 3) + ",\n" + ",\n".join(sampled_step)
    by_fraction, scaled = [random_codebook(K, 4, 3)], "(SELECT l_orderkey, l_linenumber::BIGINT AS line, [" + ", ".join(
        f"{c} / (SELECT stddev_samp({c}) FROM lineitem)" for c in columns.split(", ")
    ) + "] AS x FROM lineitem)"
    for i in range(1, 11):
        by_fraction.append(
            f"b{i} AS (SELECT row_number() OVER () AS id, x FROM (SELECT x, unnest(range({_copies(i / 10)})) AS copy "
            f"FROM (SELECT x, {unit('h')} AS u FROM {hashed(scaled, ['l_orderkey', 'line'], '7')})))"
        )
        by_fraction.append(step_ctes(f"b{i}", COLS, _sigma(0, 2.0, 2.0), "cb0", f"f{i}a"))
        by_fraction.append(step_ctes(f"b{i}", COLS, _sigma(1, 2.0, 2.0), f"f{i}a", f"f{i}b"))
        by_fraction.append(units_cte(f"b{i}", f"f{i}b", f"u{i}"))
    by_fraction = "WITH " + ",\n".join(by_fraction) + "\n" + " UNION ALL ".join(
        _adjacency(f"u{i}", f"{i / 10}::DOUBLE AS fraction, ") for i in range(1, 11)
    )
    start = f"WITH base AS (SELECT id, x FROM {SCALED}),\n{random_codebook(K, 4, 3)}"
    stream = f"WITH base AS (SELECT id, x FROM {EVENTS}),\n{random_codebook(K, 2, 3)}"
    held = f"WITH {_held_out()}"
    return {
        "csv_scan": f"SELECT (l_returnflag = 'R')::DOUBLE AS label, {columns} FROM lineitem",
        "whitespace_scan": "SELECT o_orderkey::DOUBLE AS o_orderkey, o_custkey::DOUBLE AS o_custkey, o_totalprice FROM orders",
        "in_memory_samples": "SELECT id, (n % 2)::INTEGER AS label, unnest([0, 1])::INTEGER AS component, unnest([round(mean, 4), n::DOUBLE]) AS value FROM "
        "(SELECT row_number() OVER (ORDER BY o_orderpriority) - 1 AS id, avg(o_totalprice) AS mean, count(*) AS n FROM orders GROUP BY o_orderpriority)",
        "label_by_position": "SELECT event_id, value, (row_number() OVER (ORDER BY event_id) <= 36)::INTEGER AS label FROM events",
        "uniform_vectors": f"SELECT o_orderkey, k::INTEGER AS component, {unit('h')} AS value FROM "
        + hashed("(SELECT o_orderkey, unnest(range(4)) AS k FROM orders)", ["o_orderkey", "k"], "5"),
        "model_round_trip": _tree(ORDERS, 2, 3),
        "label_last": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
        "vector_round_trip": f"SELECT l_orderkey, {columns} FROM lineitem",
        "standard_scale": f"SELECT l_orderkey, {std} FROM lineitem",
        "standard_scale_vectors": f"WITH e AS (SELECT id, unnest(x) AS v, unnest(range(64))::INTEGER AS component FROM {EMBEDDINGS}), "
        "sd AS (SELECT component, stddev_samp(v) AS sd FROM e GROUP BY component) "
        "SELECT id AS vec_id, component, round(v / sd, 6) AS value FROM e JOIN sd USING (component)",
        "range_scale": "SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 8) AS scaled FROM orders, "
        "(SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)",
        "attribute_lists": f"SELECT o_orderkey, y AS label, unnest(range(2))::INTEGER AS feature, unnest(x) AS value FROM {ORDERS}",
        "pivot_lists": f"SELECT o_orderkey, x[1] AS price, x[2] AS days FROM {ORDERS}",
        "encode_label": f"SELECT o_orderkey, y AS label FROM {ORDERS}",
        "attribute_profile": profile,
        "class_distribution": "SELECT o_orderstatus, count(*) AS n, round(100 * count(*) / (SELECT count(*) FROM orders), 6) AS percent "
        "FROM orders GROUP BY o_orderstatus",
        "missing_values": "SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c})) AS {c}" for c in columns.split(", "))
        + " FROM lineitem",
        "word_frequencies": f"WITH {_text_features()} SELECT doc_id, unnest([{words}]) AS word, "
        "unnest(list_transform(word_freqs, lambda f: round(f, 6))) AS freq FROM feats",
        "char_frequencies": f"WITH {_text_features()} SELECT doc_id, unnest([{chars}]) AS symbol, "
        "unnest(list_transform(char_freqs, lambda f: round(f, 6))) AS freq FROM feats",
        "capital_runs": f"WITH {_text_features()} SELECT doc_id, round(run_average, 6) AS run_average, run_longest, run_total FROM feats",
        "prefix_sum": "SELECT o_orderkey, o_custkey, sum(o_custkey) OVER (ORDER BY o_orderkey)::BIGINT AS running FROM orders",
        "prefix_sum_by_row": "SELECT o_orderkey, o_orderpriority, o_custkey, "
        "sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::BIGINT AS running FROM orders",
        "prefix_sum_with_criterion": "WITH s AS (SELECT o_orderkey, row_number() OVER w AS n_left, sum(y) OVER w AS s_left, "
        f"count(*) OVER () AS n, sum(y) OVER () AS s FROM {ORDERS} WINDOW w AS (ORDER BY x[1], o_orderkey)) "
        "SELECT o_orderkey, n_left, s_left::BIGINT AS s_left, round(s_left::DOUBLE * (n_left - s_left) / n_left + "
        "CASE WHEN n > n_left THEN (s - s_left)::DOUBLE * ((n - n_left) - (s - s_left)) / (n - n_left) ELSE 0 END, 4) AS criterion FROM s",
        "stable_partition": "SELECT event_id, event_type, value > 10 AS goes_right, "
        "row_number() OVER (PARTITION BY event_type ORDER BY value > 10, event_id) - 1 AS new_pos FROM events",
        "row_positions": "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos FROM events",
        "feature_argsort": f"WITH {_argsort()} SELECT event_type, pos, idx FROM s",
        "gather": f"WITH {_argsort()} SELECT event_type, pos, idx, value FROM s",
        "scatter": f"WITH {_argsort()} SELECT event_type, idx AS pos, value FROM s",
        "gather_labels": "SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "mark_members": "SELECT c_custkey, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS flag FROM customer",
        "flag_and_complement": "SELECT o_orderkey, unnest(range(2))::INTEGER AS feature, flag, NOT flag AS complement FROM "
        "(SELECT o_orderkey, o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS flag FROM orders)",
        "argmin": "SELECT l_extendedprice, l_orderkey, l_linenumber FROM lineitem ORDER BY 1, 2, 3 LIMIT 1",
        "argmin_by_row": "SELECT l_suppkey, l_extendedprice, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER "
        "(PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1",
        "argmin_of_arrays": "SELECT vec_id, (list_position(embedding, list_min(embedding)) - 1)::INTEGER AS at FROM embeddings",
        "argmin_two_dimensional": "SELECT round(value::DOUBLE, 6) AS value, vec_id, component FROM (SELECT vec_id, unnest(embedding) AS value, "
        "unnest(range(len(embedding)))::INTEGER AS component FROM embeddings) ORDER BY 1, 2, 3 LIMIT 1",
        "total": "SELECT sum(l_quantity) AS total FROM lineitem",
        "total_by_segment": "SELECT l_suppkey, sum(l_quantity) AS total FROM lineitem GROUP BY l_suppkey",
        "weighted_means": "SELECT l_partkey, round(CASE WHEN sum(w) <> 0 THEN sum(l_extendedprice * w) / sum(w) ELSE l_partkey END, 4) AS mean_value "
        "FROM (SELECT *, CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END AS w FROM lineitem) GROUP BY l_partkey",
        "poisson_sample": f"SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, unnest(range({_copies(0.5)})) AS c FROM {u_orders})",
        "sample_fractions": fractions,
        "holdout_split": f"SELECT o_orderkey, {group_of('h', 100)} < 90 AS is_train FROM {hashed('orders', ['o_orderkey'], '4')}",
        "random_groups": f"SELECT l_orderkey, line, {group_of('h', 12)} AS tree_id FROM {hashed(LINES, ['l_orderkey', 'line'], str(2 + GROUPS_SALT))}",
        "cross_validation": _cross_validation(),
        "repeated_holdout": _repeated_holdout(),
        "som_unit_sums": f"{start},\n{units_cte('base', 'cb0', 'u')}\nSELECT bmu AS neuron, count(*) AS n, k::INTEGER AS component, "
        "round(sum(v), 4) AS total FROM (SELECT bmu, unnest(x) AS v, unnest(range(4)) AS k FROM u) GROUP BY bmu, k",
        "som_update_join": f"{start},\n{step_ctes('base', COLS, 2.0, 'cb0', 'cb1')}\n{_weights('cb1')}",
        "som_training": f"WITH {_line_map()}\n{_weights('cb2')}",
        "som_training_switched": f"WITH {_embedding_map()}\n{_weights('cb3')}",
        "som_training_subsets": f"{subsets}\n{_weights('cb2')}",
        "som_best_units": f"WITH {_embedding_map()},\n{units_cte('base', 'cb3', 'u')}\nSELECT id AS vec_id, bmu, second, "
        f"(bmu // {COLS})::INTEGER AS row, (bmu % {COLS})::INTEGER AS col, round(distance, 6) AS distance FROM u",
        "som_by_fraction": by_fraction,
        "forest_large_nodes": f"WITH {_forest_ctes(LINES, ['l_orderkey', 'line'], 3, 2, 4, 3)}\n{NODES}",
        "even_groups_after_split": f"SELECT {group_of('g', 100)} AS tree_id, count(*) AS n FROM "
        + hashed(hashed(LINES, ["l_orderkey", "line"], "0"), ["l_orderkey", "line"], str(GROUPS_SALT), "g")
        + f" WHERE {group_of('h', 100)} < 90 GROUP BY 1",
        "som_quality": f"WITH {_line_map()},\n{units_cte('base', 'cb2', 'u')}\n{_adjacency()}",
        "som_clusters": f"WITH {_line_map()},\n{units_cte('base', 'cb2', 'u')}\nSELECT neuron, (neuron // {COLS})::INTEGER AS row, "
        f"(neuron % {COLS})::INTEGER AS col, count(u.id) AS n, round(avg(distance), 6) AS mean_distance FROM cb2 "
        "LEFT JOIN u ON bmu = neuron GROUP BY neuron",
        "som_weight_mosaic": f"WITH {_embedding_map()}\nSELECT (neuron // {COLS} * 8 + k // 8)::INTEGER AS y, (neuron % {COLS} * 8 + k % 8)::INTEGER AS x, "
        "round(255 * v, 4) AS grey FROM (SELECT neuron, unnest(w) AS v, unnest(range(64)) AS k FROM cb3)",
        "som_distance_map": f"WITH {_line_map()}\nSELECT a.neuron, (a.neuron // {COLS})::INTEGER AS row, (a.neuron % {COLS})::INTEGER AS col, "
        f"round(avg(list_distance(a.w, b.w)), 6) AS mean_distance FROM cb2 a JOIN cb2 b ON abs(a.neuron // {COLS} - b.neuron // {COLS}) + "
        f"abs(a.neuron % {COLS} - b.neuron % {COLS}) = 1 GROUP BY a.neuron",
        "som_density_map": f"WITH {_line_map()}\nSELECT neuron, (neuron // {COLS})::INTEGER AS row, (neuron % {COLS})::INTEGER AS col, "
        "count(*) FILTER (WHERE list_distance(x, w) <= 0.35) AS n FROM cb2, base GROUP BY neuron",
        "som_classification": f"WITH {_embedding_map()},\n{units_cte('base', 'cb3', 'u')},\n"
        f"lab AS (SELECT u.id, u.bmu, e.label FROM u JOIN {EMBEDDINGS} e USING (id)),\n"
        "best AS (SELECT bmu, label AS prediction FROM (SELECT bmu, label, row_number() OVER (PARTITION BY bmu ORDER BY count(*) DESC, label) AS r "
        "FROM lab GROUP BY bmu, label) WHERE r = 1)\nSELECT id AS vec_id, label, bmu, prediction FROM lab JOIN best USING (bmu)",
        "incremental_som": f"{stream},\n{step_ctes('base', COLS, 2.0, 'cb0', 'cb1')},\n"
        "mixed AS (SELECT a.neuron, list_transform(list_zip(a.w, b.w), lambda p: p[1] + 0.5 * (p[2] - p[1])) AS w "
        f"FROM cb0 a JOIN cb1 b USING (neuron))\n{_weights('mixed')}",
        "incremental_som_batches": _batches(stream),
        "streaming_scoring": f"{stream},\n{units_cte('base', 'cb0', 'u')}\nSELECT id AS event_id, bmu, round(distance, 6) AS distance FROM u",
        "split_candidates": f"WITH base AS (SELECT 0 AS tree_id, x, y FROM {LINES}),\n{tree_ctes('base', 4, 2)}\n"
        "SELECT feature, round((value + next_value) / 2, 6) AS threshold, n_left::BIGINT AS n_left, s_left, (n - n_left)::BIGINT AS n_right, "
        "s - s_left AS s_right, round(criterion, 4) AS criterion FROM k0",
        "root_split": _tree(LINES, 4, 2) + " WHERE level = 0",
        "decision_tree": _tree(LINES, 4, 4),
        "decision_tree_min_samples": _tree(ORDERS, 2, 5, min_samples=200),
        "decision_tree_entropy": _tree(ORDERS, 2, 3, kind="entropy"),
        "decision_tree_min_gain": _tree(SIGNAL, 4, 4, min_gain=0.0005),
        "regression_tree": _tree("(SELECT [l_quantity, l_discount, l_tax] AS x, l_linenumber AS y FROM lineitem)", 3, 4, kind="variance"),
        "histogram_tree_default_edges": _ranked_tree(),
        "histogram_tree": _tree(LINES, 4, 4, edges=LINE_EDGES),
        "text_quality_tree": f"WITH {_text_features()},\nbase AS (SELECT 0 AS tree_id, list_concat(list_concat(word_freqs, char_freqs), "
        "[run_average, run_longest::DOUBLE, run_total::DOUBLE]) AS x, quality AS y FROM feats JOIN labels USING (doc_id)),\n"
        f"{tree_ctes('base', len(WORDS) + len(CHARACTERS) + 3, 3)}\n{NODES}",
        "tree_prediction": f"{order_walk}\nSELECT id AS o_orderkey, y AS label, label AS prediction FROM p_reached",
        "tree_expression_prediction": f"{order_walk}\nSELECT id AS o_orderkey, label AS prediction FROM p_reached",
        "tree_accuracy": f"WITH marked AS (SELECT row_number() OVER () AS id, 0 AS tree_id, x, y, {group_of('h', 100)} < 90 AS is_train FROM "
        f"{hashed(LINES, ['l_orderkey', 'line'], '4')}),\ntrain AS (SELECT * FROM marked WHERE is_train), test AS (SELECT * FROM marked WHERE NOT is_train),\n"
        f"{tree_ctes('train', 4, 4)},\n{walk_ctes('test', 4)}\nSELECT count(*) AS n, sum((label = y)::INT)::BIGINT AS hits, "
        "round(sum((label = y)::INT) / count(*), 6) AS accuracy FROM p_reached",
        "random_forest": f"WITH {_line_forest()}\n{NODES}",
        "forest_votes": f"WITH {_line_forest()}\nSELECT l_orderkey, line, y AS label, votes, prediction FROM judged",
        "forest_votes_expression": f"WITH {_forest_ctes(ORDERS, ['o_orderkey'], 3, 2, 2, 3)}\nSELECT o_orderkey, votes FROM judged",
        "forest_accuracy": f"WITH {_line_forest()}\nSELECT count(*) AS n, sum((prediction = y)::INT)::BIGINT AS hits, "
        "round(100 * sum((prediction = y)::INT) / count(*), 6) AS accuracy_percent FROM judged",
        "forest_roc": f"WITH {_line_forest()},\n{_roc('(SELECT votes / trees AS score, y FROM judged)')}",
        "value_roc": "WITH " + _roc("(SELECT value AS score, (event_type = 'click')::INT AS y FROM events)"),
        "impurities": "SELECT l_suppkey, round(2 * f * (1 - f), 8) AS gini, round(-(CASE WHEN f > 0 THEN f * ln(f) ELSE 0 END) - "
        "(CASE WHEN f < 1 THEN (1 - f) * ln(1 - f) ELSE 0 END), 8) AS entropy, round(f - f * f, 8) AS variance FROM "
        "(SELECT l_suppkey, avg((l_returnflag = 'R')::INT) AS f FROM lineitem GROUP BY l_suppkey)",
        "validation_counts": f"{held}\nSELECT level::INTEGER AS level, node, n, n_pos FROM reached",
        "reduced_error_pruning": _reduced_error(),
    }

"""Building blocks of the check SQL: hashing, unrolled trees, unrolled map steps.

Everything here is plain SQL text for the checking engine; nothing is used by
the library itself.
"""

from __future__ import annotations

from collections.abc import Sequence

_TWO64 = "18446744073709551616::UHUGEINT"
# The primes of the published 64-bit xxHash.
_P1, _P2, _P3 = "11400714785074694791", "14029467366897019727", "1609587929392839161"
_P4, _P5 = "9650029242287828579", "2870177450012600261"


def _times(a: str, p: str) -> str:
    return f"(({a})::UHUGEINT * {p}::UHUGEINT % {_TWO64})"


def _rotated(a: str, r: int) -> str:
    return f"(({a}) % {2 ** (64 - r)}::UHUGEINT * {2**r}::UHUGEINT + ({a}) // {2 ** (64 - r)}::UHUGEINT)"


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)"


def hashed(source: str, keys: Sequence[str], seed: str, name: str = "h") -> str:
    """``source`` plus ``name``: the unsigned xxHash64 of the (non-negative) keys and the seed.

    One nested SELECT per step, because aliases used within their own SELECT are
    expanded in place and the text would double with every step.
    """
    steps, state = [], "42"
    for i, key in enumerate([*keys, seed]):
        p = f"_{name}{i}"
        steps += [
            f"{_times(f'({key})', _P2)} AS {p}a",
            f"{_times(_rotated(f'{p}a', 31), _P1)} AS {p}b",
            f"(({state})::UHUGEINT + {_P5}::UHUGEINT + 8::UHUGEINT) % {_TWO64} AS {p}c",
            f"{_xor(f'{p}b', f'{p}c')} AS {p}d",
            f"({_times(_rotated(f'{p}d::UHUGEINT', 27), _P1)} + {_P4}::UHUGEINT) % {_TWO64} AS {p}e",
            f"{_times(_xor(f'{p}e', f'{p}e // 8589934592::UHUGEINT'), _P2)} AS {p}f",
            f"{_times(_xor(f'{p}f', f'{p}f // 536870912::UHUGEINT'), _P3)} AS {p}g",
            f"{_xor(f'{p}g', f'{p}g // 4294967296::UHUGEINT')} AS {p}h",
        ]
        state = f"{p}h"
    steps.append(f"{state} AS {name}")
    inner = source
    for step in steps:
        inner = f"(SELECT *, {step} FROM {inner})"
    return inner


def group_of(h: str, groups: int) -> str:
    signed = f"(CASE WHEN {h} >= 9223372036854775808 THEN {h}::HUGEINT - 18446744073709551616 ELSE {h}::HUGEINT END)"
    return f"((({signed} % {groups}) + {groups}) % {groups})::INTEGER"


def unit(h: str) -> str:
    return f"(({h} // 2048)::DOUBLE * 1.1102230246251565e-16)"


def _side(kind: str, n: str, s: str) -> str:
    if kind == "gini":
        return f"({s} * ({n} - {s}) / {n})"
    if kind == "entropy":
        zero = lambda p: f"(CASE WHEN {p} > 0 THEN ({p}) * ln(({p}) / {n}) ELSE 0 END)"
        return f"(-({zero(s)} + {zero(f'({n} - {s})')}))"
    return f"(-({s} * {s} / {n}))"


def tree_ctes(
    base: str,
    width: int,
    depth: int,
    kind: str = "gini",
    min_samples: int = 1,
    min_gain: float | None = None,
    edges: Sequence[Sequence[float]] | None = None,
) -> str:
    """CTEs ending in ``nodes``: the trees of ``base(tree_id, x, y)`` unrolled level by level."""
    parts = [f"r0 AS (SELECT tree_id, 0::BIGINT AS node, x, y::DOUBLE AS y FROM {base})"]
    for i in range(depth):
        n, s = "n::DOUBLE", "s"
        right_n, right_s = "(n - n_left)::DOUBLE", "(s - s_left)"
        parts.append(f"t{i} AS (SELECT tree_id, node, count(*) AS n, sum(y) AS s FROM r{i} GROUP BY ALL)")
        last = i == depth - 1
        if not last:
            if edges is None:
                bucket, carried = "value", "value"
            else:
                cases = " ".join(
                    f"WHEN {f} THEN {' + '.join(f'(value >= {e})::INT' for e in es) or '0'}" for f, es in enumerate(edges)
                )
                bucket, carried = f"(CASE feature {cases} END)", "max(value)"
            parts.append(
                f"m{i} AS (SELECT tree_id, node, feature, x[feature + 1] AS value, y "
                f"FROM r{i}, (SELECT unnest(range({width}))::INTEGER AS feature) f)"
            )
            parts.append(
                f"v{i} AS (SELECT tree_id, node, feature, {bucket} AS bucket, {carried} AS value, min(value) AS low, "
                f"count(*) AS m, sum(y) AS q FROM m{i} GROUP BY tree_id, node, feature, bucket{', value' if edges is None else ''})"
            )
            parts.append(
                f"c{i} AS (SELECT tree_id, node, feature, value, "
                "sum(m) OVER w AS n_left, sum(q) OVER w AS s_left, lead(low) OVER w AS next_value "
                f"FROM v{i} WINDOW w AS (PARTITION BY tree_id, node, feature ORDER BY bucket))"
            )
            parts.append(
                f"k{i} AS (SELECT c.*, n, s, {_side(kind, 'n_left::DOUBLE', 's_left')} + {_side(kind, right_n, right_s)} AS criterion "
                f"FROM c{i} c JOIN t{i} USING (tree_id, node) WHERE next_value IS NOT NULL)"
            )
            parts.append(
                f"b{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree_id, node "
                f"ORDER BY criterion, feature, value) AS place FROM k{i}) WHERE place = 1)"
            )
            gain = {
                "gini": f"2 * ({_side(kind, n, s)} - criterion) / n",
                "entropy": f"({_side(kind, n, s)} - criterion) / n",
                "variance": f"({_side(kind, n, s)} - criterion) / n",
            }[kind]
            ok = f"n > {min_samples}"
            ok += " AND s <> 0 AND s <> n" if kind != "variance" else f" AND {gain} > 1e-12 * greatest(1, (s / n) * (s / n))"
            if min_gain is not None:
                ok += f" AND {gain} >= {min_gain}"
            parts.append(f"g{i} AS (SELECT * FROM b{i} WHERE {ok})")
        label = "t.s / t.n" if kind == "variance" else "(2 * t.s > t.n)::INT::DOUBLE"
        if last:
            parts.append(
                f"n{i} AS (SELECT t.tree_id, {i} AS level, t.node, false AS is_split, NULL::INTEGER AS feature, "
                f"NULL::DOUBLE AS threshold, {label} AS label, t.n, t.s, NULL::DOUBLE AS criterion FROM t{i} t)"
            )
        else:
            parts.append(
                f"n{i} AS (SELECT t.tree_id, {i} AS level, t.node, g.node IS NOT NULL AS is_split, g.feature, "
                f"(g.value + g.next_value) / 2 AS threshold, {label} AS label, t.n, t.s, g.criterion "
                f"FROM t{i} t LEFT JOIN g{i} g USING (tree_id, node))"
            )
            parts.append(
                f"r{i + 1} AS (SELECT r.tree_id, CASE WHEN r.x[n.feature + 1] <= n.threshold THEN 2 * r.node "
                f"ELSE 2 * r.node + 1 END AS node, r.x, r.y FROM r{i} r JOIN n{i} n USING (tree_id, node) WHERE n.is_split)"
            )
    parts.append("nodes AS (" + " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(depth)) + ")")
    return ",\n".join(parts)


def walk_ctes(rows: str, depth: int, nodes: str = "nodes", tag: str = "p") -> str:
    """CTEs ending in ``{tag}_reached``: (id, tree_id, level, node, label, y) of each row's leaf."""
    parts = [f"{tag}0 AS (SELECT id, tree_id, 0::BIGINT AS node, x, y FROM {rows})"]
    for i in range(depth):
        parts.append(
            f"{tag}{i}_at AS (SELECT p.id, p.tree_id, p.node, p.x, p.y, n.is_split, n.feature, n.threshold, n.label "
            f"FROM {tag}{i} p JOIN {nodes} n ON n.tree_id = p.tree_id AND n.level = {i} AND n.node = p.node)"
        )
        if i < depth - 1:
            parts.append(
                f"{tag}{i + 1} AS (SELECT id, tree_id, CASE WHEN x[feature + 1] <= threshold THEN 2 * node "
                f"ELSE 2 * node + 1 END AS node, x, y FROM {tag}{i}_at WHERE is_split)"
            )
    parts.append(
        f"{tag}_reached AS ("
        + " UNION ALL ".join(
            f"SELECT id, tree_id, {i} AS level, node, label, y FROM {tag}{i}_at WHERE NOT is_split" for i in range(depth)
        )
        + ")"
    )
    return ",\n".join(parts)


def random_codebook(neurons: int, width: int, seed: int, name: str = "cb0") -> str:
    """CTE (neuron, w): uniform weights from the hash of (neuron, element, seed)."""
    cells = f"(SELECT id // {width} AS neuron, id % {width} AS k FROM (SELECT unnest(range({neurons * width})) AS id))"
    return (
        f"{name} AS (SELECT neuron::INTEGER AS neuron, list({unit('h')} ORDER BY k) AS w "
        f"FROM {hashed(cells, ['neuron', 'k'], str(seed))} GROUP BY neuron)"
    )


def units_cte(base: str, codebook: str, name: str) -> str:
    """CTE (id, x, bmu, second, distance) for ``base(id, x)``."""
    return (
        f"{name} AS (SELECT id, any_value(x) AS x, min(e).k AS bmu, min(e, 2)[2].k AS second, min(e).d AS distance "
        f"FROM (SELECT b.id, b.x, {{'d': list_distance(b.x, c.w), 'k': c.neuron}} AS e FROM {base} b, {codebook} c) GROUP BY id)"
    )


def step_ctes(base: str, cols: int, sigma: float, before: str, after: str) -> str:
    """CTEs turning codebook ``before`` into ``after`` by one batch step."""
    s2 = repr(sigma * sigma)
    g = f"((j.neuron // {cols} - c.bmu // {cols}) ** 2 + (j.neuron % {cols} - c.bmu % {cols}) ** 2)"
    return ",\n".join(
        [
            units_cte(base, before, f"{after}_units"),
            f"{after}_n AS (SELECT bmu, count(*) AS n FROM {after}_units GROUP BY bmu)",
            f"{after}_s AS (SELECT bmu, k, sum(v) AS s FROM (SELECT bmu, unnest(x) AS v, "
            f"unnest(range(len(x))) AS k FROM {after}_units) GROUP BY bmu, k)",
            f"{after}_h AS (SELECT j.neuron, c.bmu, exp(-{g} / (2 * {s2})) AS h FROM {before} j, {after}_n c WHERE {g} <= {s2})",
            f"{after}_new AS (SELECT h.neuron, s.k, sum(h.h * s.s) / sum(h.h * n.n) AS w FROM {after}_h h "
            f"JOIN {after}_s s USING (bmu) JOIN {after}_n n USING (bmu) GROUP BY h.neuron, s.k)",
            f"{after} AS (SELECT o.neuron, list(coalesce(u.w, o.v) ORDER BY o.k) AS w FROM (SELECT neuron, unnest(w) AS v, "
            f"unnest(range(len(w))) AS k FROM {before}) o LEFT JOIN {after}_new u ON u.neuron = o.neuron AND u.k = o.k "
            "GROUP BY o.neuron)",
        ]
    )

"""Split criteria as SQL expressions over a side's sufficient statistics.

``n`` is the row count of a side, ``s`` the sum of its targets (the positives of
a 0/1 label) and ``q`` the sum of squared targets. ``side`` is the *weighted*
impurity of a side, concave in (n, s), which the pruned split search relies on.
"""

from __future__ import annotations

import math

KINDS = ("gini", "entropy", "variance")


def side(kind: str, n: str, s: str) -> str:
    n, s = f"cast({n} as double)", f"cast({s} as double)"
    if kind == "gini":
        value = f"{s} * ({n} - {s}) / {n}"
    elif kind == "entropy":
        value = f"-({_xlogx(s, n)} + {_xlogx(f'({n} - {s})', n)})"
    elif kind == "variance":
        value = f"-({s} * {s} / {n})"
    else:
        raise ValueError(f"unknown impurity {kind!r}, choose from {KINDS}")
    return f"(case when {n} > 0 then {value} else 0D end)"


def _xlogx(part: str, whole: str) -> str:
    return f"(case when {part} > 0 then {part} * ln({part} / {whole}) else 0D end)"


def criterion(kind: str, n_left: str, s_left: str, n: str = "n", s: str = "s") -> str:
    """Summed weighted impurity of both sides; smaller is better."""
    return f"({side(kind, n_left, s_left)} + {side(kind, f'({n} - {n_left})', f'({s} - {s_left})')})"


def impurity(kind: str, n: str, s: str, q: str | None = None) -> str:
    """Impurity of one set in its textbook form (Gini, entropy in nats, variance)."""
    if kind == "gini":
        return f"(2 * {side(kind, n, s)} / {n})"
    if kind == "entropy":
        return f"({side(kind, n, s)} / {n})"
    return f"({q} / {n} - ({s} / {n}) * ({s} / {n}))"


def gain(kind: str, best: float, n: int, s: float) -> float:
    """Information gain of a split whose criterion is ``best``, for a node (n, s)."""
    if kind == "gini":
        return 2.0 * (s * (n - s) / n - best) / n
    if kind == "entropy":
        parts = [p for p in (s, n - s) if p > 0]
        return (-sum(p * math.log(p / n) for p in parts) - best) / n
    return (-(s * s / n) - best) / n

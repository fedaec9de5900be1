"""Numeric helpers that run on one Arrow batch inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Cells of one distance block: about 2 MB, so that a block stays in cache.
_BLOCK_CELLS = 250_000


def matrix(column: pa.Array, width: int, finite: bool = True) -> np.ndarray:
    """An Arrow list column as a dense (rows, width) float64 matrix; ``finite`` refuses NaN and infinity."""
    if column.null_count:
        raise ValueError("null feature vector; drop such rows with operators.prepare.complete()")
    flat = column.flatten()
    if flat.null_count or len(flat) != len(column) * width:
        raise ValueError(f"every feature vector must hold {width} non-null values")
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if finite and not np.isfinite(values).all():
        raise ValueError("NaN or infinite feature; drop such rows with operators.prepare.complete()")
    return values.reshape(len(column), width)


def members(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and value of every entry of a list column."""
    if column.null_count:
        raise ValueError("null list")
    offsets = column.offsets.to_numpy()
    return np.repeat(np.arange(len(column)), np.diff(offsets)), column.flatten().to_numpy(zero_copy_only=False)


def nearest(x: np.ndarray, w: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the k nearest rows of ``w`` for each row of ``x``, nearest first.

    A matrix product ranks the candidates; rows where two neighbouring ranks lie
    within the product's rounding error are measured again term by term, so ties
    always go to the lowest index.
    """
    n, d = x.shape
    index = np.empty((n, k), np.int64)
    w2 = np.einsum("ij,ij->i", w, w)
    step = max(1, _BLOCK_CELLS // max(len(w), d))
    for lo in range(0, n, step):
        block = x[lo : lo + step]
        rows = np.arange(len(block))
        approx = w2[:, None] - 2.0 * (w @ block.T)
        slack = 8 * (d + 8) * np.finfo(np.float64).eps * (np.einsum("ij,ij->i", block, block) + w2.max())
        unclear = np.zeros(len(block), bool)
        before = None
        for j in range(k + 1):
            value = approx.min(axis=0)
            if before is not None:
                unclear |= value - before <= slack
            if j < k:
                best = approx.argmin(axis=0)
                index[lo : lo + step, j] = best
                approx[best, rows] = np.inf
                before = value
        if unclear.any():
            again = np.flatnonzero(unclear)
            exact = term_by_term(block[again], w)
            index[lo + again] = np.argsort(exact, axis=1, kind="stable")[:, :k]
    return index


def squared_distance(x: np.ndarray, w: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Squared distance of each row of ``x`` to the row of ``w`` its index names."""
    diff = x - w[index]
    return np.einsum("ij,ij->i", diff, diff)


def term_by_term(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """All squared distances, summed one dimension after the other."""
    out = np.zeros((len(x), len(w)))
    for j in range(x.shape[1]):
        out += (x[:, j, None] - w[None, :, j]) ** 2
    return out


def sums_by_group(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group ids, row counts, vector sums) of the groups present in ``group``."""
    order = np.argsort(group, kind="stable")
    ids, starts, counts = np.unique(group[order], return_index=True, return_counts=True)
    return ids, counts, np.add.reduceat(x[order], starts, axis=0)


class FlatTrees:
    """Trees as parallel arrays, for sending rows down in bulk.

    ``feature`` is -1 where a node does not split; ``left`` / ``right`` are node
    indices; ``roots`` maps sorted tree ids to their root's index.
    """

    def __init__(self, nodes) -> None:
        index = {(r.tree_id, r.level, r.node): i for i, r in enumerate(nodes)}
        self.depth = 1 + max((r.level for r in nodes), default=-1)
        self.feature = np.array([r.feature if r.is_split else -1 for r in nodes], np.int64)
        self.threshold = np.array([r.threshold if r.is_split else 0.0 for r in nodes], np.float64)
        self.left = np.zeros(len(nodes), np.int64)
        self.right = np.zeros(len(nodes), np.int64)
        for i, r in enumerate(nodes):
            if r.is_split:
                self.left[i] = index[r.tree_id, r.level + 1, 2 * r.node]
                self.right[i] = index[r.tree_id, r.level + 1, 2 * r.node + 1]
        self.tree_ids = np.array(sorted(r.tree_id for r in nodes if r.level == 0), np.int64)
        self.roots = np.array([index[t, 0, 0] for t in self.tree_ids], np.int64)

    def start(self, tree_ids: np.ndarray) -> np.ndarray:
        """Root index of each row's tree, -1 for an unknown tree."""
        at = np.minimum(np.searchsorted(self.tree_ids, tree_ids), len(self.tree_ids) - 1)
        return np.where(self.tree_ids[at] == tree_ids, self.roots[at], -1)

    def descend(self, x: np.ndarray, current: np.ndarray, steps: int | None = None, rows: np.ndarray | None = None) -> np.ndarray:
        """Index of the node each row reaches after ``steps`` levels (its leaf when None).

        ``rows`` names the row of ``x`` of each entry of ``current``, where rows go down several trees.
        """
        rows = np.arange(len(x)) if rows is None else rows
        current = current.copy()
        for _ in range(self.depth if steps is None else steps):
            feature = np.where(current >= 0, self.feature[current], -1)
            moving = feature >= 0
            if not moving.any():
                break
            goes_left = x[rows, np.maximum(feature, 0)] <= self.threshold[current]
            current = np.where(moving, np.where(goes_left, self.left[current], self.right[current]), current)
        return current


def combined(key: np.ndarray, value: np.ndarray, y: np.ndarray):
    """Collapse equal (key, value) pairs: (keys, values, row counts, target sums)."""
    order = np.lexsort((value, key))
    key, value, y = key[order], value[order], y[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
    starts = np.flatnonzero(first)
    counts = np.diff(np.append(starts, len(key)))
    return key[starts], value[starts], counts, np.add.reduceat(y, starts) if len(starts) else y[:0]

"""Blocks compared inside a task: pairs held at once are bounded, the outcome is that of all pairs together."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from graticule.llm import minhash_dedup as M

LISTS, MEMBERS = 6, 1024


def _batch():
    rng = np.random.default_rng(5)
    n = LISTS * MEMBERS
    bits = np.tile(rng.integers(0, 2**62, M.BITMAP_BITS // 64), (n, 1))
    for row in range(n):  # a few bits differ, so that shares differ
        bits[row, rng.integers(0, bits.shape[1], 3)] ^= 1 << int(rng.integers(0, 60))
    keys = [int(i).to_bytes(16, "big") for i in np.tile(np.arange(MEMBERS * 2), LISTS)[:n]]
    maps = M.W.lists(pa.array(bits.ravel()), np.full(n, bits.shape[1]))
    whole = pa.array(np.full(n, 400), pa.int64())
    zero = pa.array(np.zeros(n, np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.arange(LISTS), MEMBERS)), zero, zero, zero, pa.array(keys, pa.binary()), pa.array(keys, pa.binary()), whole, whole, maps, maps],
        ["value", "i", "j", "mine", "key", "component", "held", "rest", "bits", "half"],
    )


def _pairs(forest):
    return {p for b in M._compared(75, forest)(iter([_batch()])) for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}


@pytest.mark.parametrize("forest", [True, False])
def test_pairs_in_parts_are_those_of_all_at_once(monkeypatch, forest):
    found = _pairs(forest)
    monkeypatch.setattr(M, "PAIRS_HELD", 1 << 40)
    assert found and found == _pairs(forest)


def test_a_forest_does_not_hold_all_pairs():
    batch, run = _batch(), M._compared(75, True)
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert 0 < rows < LISTS * MEMBERS and peak < 150e6, peak

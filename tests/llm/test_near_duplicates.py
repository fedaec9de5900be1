"""Near duplicates in one large group whose members are partly below the threshold, against brute force."""

import numpy as np
import pytest

from graticule.llm import minhash_dedup


def _copies(rows: int, length: int, most: int, seed: int):
    """Texts of distinct words, each with a few words replaced by words of its own; and the shingles each kept."""
    draw = np.random.Generator(np.random.PCG64(seed))
    texts, kept = [], np.ones((rows, length - 4), np.int32)
    for row in range(rows):
        words = [f"w{i}" for i in range(length)]
        for at in draw.choice(length, draw.integers(1, most + 1), replace=False).tolist():
            words[at] = f"own{row}x{at}"
            kept[row, max(0, at - 4) : at + 1] = 0
        texts.append(" ".join(words))
    return texts, kept


def _least_of_components(linked: np.ndarray) -> list[int]:
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label, len(label)).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


@pytest.mark.parametrize("rows,length,most", [(5000, 120, 8), (300, 1500, 70)])
def test_one_group_of_many_copies(spark, monkeypatch, rows, length, most):
    monkeypatch.setattr(minhash_dedup, "BLOCK_MEMBERS", 200)
    texts, kept = _copies(rows, length, most, 5)
    n = length - 4
    meet = (kept.astype(np.float32) @ kept.T.astype(np.float32)).astype(np.int64)
    np.fill_diagonal(meet, n)
    linked = meet * 100 >= (2 * n - meet) * 75
    assert 0.01 < linked.mean() < 0.9
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs).collect()}
    wanted = _least_of_components(linked)
    assert len(set(wanted)) > 1
    assert [found[i] for i in range(rows)] == wanted

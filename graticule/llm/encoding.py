"""Token ids of whole texts with a public tokenizer file, inside Arrow tasks.

The word tokenizer drops white space and never joins tokens over it, so a text's ids are
those of its parts between white space. ``columns`` finds the words of a whole batch in
numpy, looks up each distinct word once and gathers the ids of all places. Words are told
apart by 64-bit hashes and then compared byte for byte; a batch where that fails is
encoded text by text.

Words are encoded once per task while the store of known words is below ``KNOWN`` entries
(about 60 bytes each, in flat arrays); a full store is emptied, which costs time but
changes nothing.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from graticule.llm import words as W

KNOWN = 800_000
# Words without ends that are kept as Python objects.
_CORES = 200_000
# Words compared with their first occurrence at once.
_BLOCK = 1 << 15


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Ends of words that the tokenizer splits off as one piece, and letters that its clean-up only lowers.
_ENDS = ".,!?;:|*#$%&"
_PLAIN = "".join(chr(c) for c in range(0xAA, 0x100) if chr(c).isalpha())


class WordEncoder:
    """Little-endian 32-bit ids of texts.

    A part made of plain letters and an end goes straight to the merge model, letters and
    end apart, as the tokenizer's own pattern splits them; any other part is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.encoder = Tokenizer.from_file(path)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in _PLAIN}
        self.cores: dict[str, bytes] = {}
        self._forget()

    def _forget(self) -> None:
        """An empty store: words in order of their hash, with their places in the flat bytes and ids."""
        self.hashes = np.zeros(0, np.uint64)
        self.word_at, self.word_size, self.id_at, self.id_size = (np.zeros(0, np.int64) for _ in range(4))
        self.raw, self.ids = np.zeros(0, np.uint8), np.zeros(0, "<u4")

    def _learn(self, parts: list[str]) -> list[bytes]:
        """Ids of every part, as bytes in the order of the machine."""
        cores, model, odd, out = self.cores, self.encoder.model, [], []
        if len(cores) > _CORES:
            cores.clear()
        for part in parts:
            low = part.lower()
            core = low.rstrip(_ENDS)
            ids = cores.get(core)
            if ids is None:
                plain = core if core.isascii() else core.translate(self.bytes_of)
                if not core.isalpha() or (plain is not core and max(core) > "\xff"):
                    odd.append(len(out))
                    out.append(b"")
                    continue
                ids = cores[core] = array("I", [t.id for t in model.tokenize(plain)]).tobytes()
            if len(low) > len(core):
                end = low[len(core) :]
                more = cores.get(end)
                if more is None:
                    more = cores[end] = array("I", [t.id for t in model.tokenize(end)]).tobytes()
                ids = ids + more
            out.append(ids)
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            for i, found in zip(some, self.encoder.encode_batch_fast([parts[i] for i in some], add_special_tokens=False)):
                out[i] = array("I", found.ids).tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as bytes."""
        rows = [(t or "").replace("\n", " ").split(" ") for t in texts]
        parts = list({p for row in rows for p in row})
        known = dict(zip(parts, self._learn(parts)))
        return [np.frombuffer(b"".join([known[p] for p in row]), np.uint32).astype("<u4").tobytes() for row in rows]

    def _add(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Store new words, given in order of their hash."""
        raw = data[_ranges(starts, sizes)]
        cut = np.cumsum(sizes) - sizes
        held = raw.tobytes()
        found = self._learn([held[a : a + n].decode() for a, n in zip(cut.tolist(), sizes.tolist())])
        id_size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), np.uint32).astype("<u4")
        to = np.searchsorted(self.hashes, hashes)
        self.word_at = np.insert(self.word_at, to, cut + len(self.raw))
        self.word_size = np.insert(self.word_size, to, sizes)
        self.id_at = np.insert(self.id_at, to, np.cumsum(id_size) - id_size + len(self.ids))
        self.id_size = np.insert(self.id_size, to, id_size)
        self.hashes = np.insert(self.hashes, to, hashes)
        self.raw, self.ids = np.concatenate([self.raw, raw]), np.concatenate([self.ids, ids])

    def columns(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column in one array, and where each text's ids start; one more entry ends the last."""
        data, offs = W.texts_of(column)
        starts, ends, hashes, first = W.words_in(data, offs)
        sizes = ends - starts
        distinct, at, which = np.unique(hashes, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self.hashes, assume_unique=True)
        if len(self.hashes) + int(new.sum()) > KNOWN:
            self._forget()
            new[:] = True
        self._add(distinct[new], data, starts[at[new]], sizes[at[new]])
        place = np.searchsorted(self.hashes, distinct)[which]
        if not _same_bytes(data, starts, sizes, self.raw, self.word_at[place], self.word_size[place]):
            found = self.encode(column.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), np.concatenate([[0], np.cumsum([len(f) // 4 for f in found], dtype=np.int64)])
        taken = self.id_size[place]
        bounds = np.concatenate([[0], np.cumsum(taken)])
        return self.ids[_ranges(self.id_at[place], taken)], bounds[first]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of them, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _same_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, at: np.ndarray, n: np.ndarray) -> bool:
    """Whether every word of ``data`` is that at its place in ``other``."""
    if not np.array_equal(sizes, n):
        return False
    for i in range(0, len(starts), _BLOCK):
        cut = slice(i, i + _BLOCK)
        if not np.array_equal(data[_ranges(starts[cut], sizes[cut])], other[_ranges(at[cut], n[cut])]):
            return False
    return True

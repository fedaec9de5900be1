"""Token counts that follow edits: a segment tree of pre-tokens per text, re-encoded only where an edit touches it.

The byte-level tokenizer splits a text into pre-tokens and encodes each by itself, so a
text's count is the sum over its pre-tokens. A tree keeps, per document, where every
``leaf`` pre-tokens begin, how many tokens they hold, and the sums of ever larger
subtrees. Where a pre-token ends depends only on what follows shortly after it, so an
edit is handled locally: splitting starts anew a leaf before the edit (boundary context)
and stops at the first leaf end beyond it at which old and new text are split alike. Only
that region is encoded again; sums above it are updated, the rest is reused as it is.

``build`` makes the trees, ``edited`` applies edits, given as an array column on each
document, in order, each in the coordinates of the text as the edits before it left it.
Texts, trees and edits are cells of a row, so work is dealt out by document and memory is
bounded by the largest one.

Rows: ``doc_id``, ``n_tokens`` and the tree, or after edits ``n_before``, ``n_edits``,
``n_after``, ``n_reencoded`` (characters encoded again). A null text is empty and holds no
tokens. A null edit list is empty; positions and lengths are cut to the text's bounds; null
replacements are empty. Repeated and null ids are fine, rows are counted by themselves. An
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm import words as W

LEAF = 64
KNOWN = 200_000


def rank_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteCounter:
    """Token count of a pre-token, and the split of a text into pre-tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, pieces: list[str]) -> int:
        known, total = self.known, 0
        for piece in pieces:
            n = known.get(piece)
            if n is None:
                if len(known) >= KNOWN:
                    known.clear()
                n = known[piece] = len(self.encoder.encode_ordinary(piece))
            total += n
        return total


class Tree:
    """Leaves of pre-tokens: where each starts, its tokens, and subtree sums (level by level, pairs of the level below)."""

    def __init__(self, starts: list[int], sums: list[int]):
        self.starts, self.levels = starts, [sums]
        self.rise(0)

    def rise(self, first: int) -> None:
        """Update the sums over the leaves from ``first`` on."""
        depth = 0
        while len(self.levels[depth]) > 1:
            below = self.levels[depth]
            kept = self.levels[depth + 1][: first // 2] if depth + 1 < len(self.levels) else []
            first = len(kept)
            self.levels[depth + 1 : depth + 2] = [kept + [sum(below[i : i + 2]) for i in range(2 * first, len(below), 2)]]
            depth += 1
        del self.levels[depth + 1 :]

    @property
    def total(self) -> int:
        return self.levels[-1][0] if self.levels[-1] else 0


def grow(text: str, counter: ByteCounter, leaf: int = LEAF) -> Tree:
    starts, sums, at = [], [], 0
    pieces = counter.split(text)
    for i in range(0, len(pieces), leaf):
        some = pieces[i : i + leaf]
        starts.append(at)
        sums.append(counter.count(some))
        at += sum(map(len, some))
    return Tree(starts, sums)


def apply_edit(text: str, tree: Tree, start: int, length: int, new: str, counter: ByteCounter, leaf: int = LEAF) -> tuple[str, int]:
    """Edit the text and its tree; the new text and the characters that were encoded again."""
    start = min(max(start, 0), len(text))
    length = min(max(length, 0), len(text) - start)
    after = text[:start] + new + text[start + length :]
    shift = len(new) - length
    # A pre-token's end may look past it by a white-space run, so a whole leaf before the edit is context.
    first = max(0, bisect.bisect_right(tree.starts, start) - 2)
    begin = tree.starts[first] if tree.starts else 0
    stop = bisect.bisect_left(tree.starts, start + length + 1)
    starts, sums, pieces, at, resume = [], [], [], begin, len(tree.starts)
    ends = {s + shift: i for i, s in enumerate(tree.starts) if i >= stop}
    here = begin
    for match in counter.pattern.finditer(after, begin):
        if match.start() in ends and match.start() > start + len(new):
            resume = ends[match.start()]
            break
        pieces.append(match.group())
        here = match.end()
        if len(pieces) == leaf:
            starts.append(at)
            sums.append(counter.count(pieces))
            at, pieces = here, []
    if pieces:
        starts.append(at)
        sums.append(counter.count(pieces))
    leaves = tree.levels[0]
    tree.starts = tree.starts[:first] + starts + [s + shift for s in tree.starts[resume:]]
    tree.levels[0] = leaves[:first] + sums + leaves[resume:]
    tree.rise(first)
    return after, here - begin


_EDIT = "array<struct<start:int,length:int,text:string>>"


#: What ``masks`` replaces: mail addresses and numbers of six digits or more.
#: The look-behind starts a try only where a name starts, so a long run is read once.
PRIVATE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|[0-9]{6,}"
MARK = "[masked]"


def masks(text: str) -> list[dict]:
    """Edits that mask private data, last first so that places stay valid."""
    found = re.finditer(PRIVATE, text)
    return [{"start": m.start(), "length": m.end() - m.start(), "text": MARK} for m in found][::-1]


def _counted(path: str, leaf: int, apply: bool, find: Callable[[str], list[dict]] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ByteCounter(path)
        for batch in W.chunks(batches):
            out = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                tree = grow(text, counter, leaf)
                if not apply:
                    out.append((tree.total, tree.starts, tree.levels[0]))
                    continue
                before, again = tree.total, 0
                edits = find(text) if find else batch.column("edits")[i].as_py() or []
                for edit in edits:
                    text, redone = apply_edit(text, tree, edit["start"] or 0, edit["length"] or 0, edit["text"] or "", counter, leaf)
                    again += redone
                out.append((before, len(edits), tree.total, again))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64()) if apply else (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            names = ["n_before", "n_edits", "n_after", "n_reencoded"] if apply else ["n_tokens", "starts", "sums"]
            columns = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    return run


def build(docs: DataFrame, path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Token count of every row, with the leaves of its tree."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_counted(path or rank_path(), leaf, False), "doc_id long, n_tokens long, starts array<int>, sums array<int>")


def edited(
    docs: DataFrame, edits: Column | Callable[[str], list[dict]], path: str | None = None, leaf: int = LEAF
) -> DataFrame:
    """Token count of every row before and after its edits.

    ``edits`` is an array column of (start, length, text), or a function that finds the edits
    in a text, such as ``masks``.
    """
    found = None if isinstance(edits, Column) else edits
    more = [edits.cast(_EDIT).alias("edits")] if found is None else []
    rows = docs.select(F.col("doc_id").cast("long"), "text", *more)
    return rows.mapInArrow(
        _counted(path or rank_path(), leaf, True, found), "doc_id long, n_before long, n_edits long, n_after long, n_reencoded long"
    )

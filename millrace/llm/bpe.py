"""Byte-level BPE of a public tokenizer: whole-corpus encoding.

A pre-token is merged with a segment tree over its adjacent pairs: each leaf holds the rank of one pair, each inner
node the smaller of its children (rank first, then position), so the root is the leftmost pair of lowest rank. A
merge changes at most three leaves, each updated along one path, until no pair can be merged: O(n log n) also for
one very long pre-token.

Texts are cut at spaces that follow a non-space, where the tokenizer's own pattern always ends a pre-token, and the
ids of such pieces are kept in a bounded table per Python worker, as words repeat across a corpus.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries of a worker's table of pieces, and the longest piece kept in it.
CACHE_ENTRIES, CACHE_LENGTH = 300_000, 48
_BIG = 1 << 62
#: White space runs that are no single space: those with an inner or a final space are not cut at spaces.
_ODD_SPACE = re.compile(r"\s \s|\s \Z")


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def default_pattern() -> str:
    """The pre-token pattern published with the vocabulary."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a rank file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token by repeated merges of the leftmost pair of lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return (whole,)
    n = len(piece)
    parts: list = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << max(0, (n - 2).bit_length())
    get = ranks.get
    tree = [_BIG] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r * size + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def update(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            best = a if a < b else b
            if tree[k] == best:
                return
            tree[k] = best
            k >>= 1

    def pair(i: int) -> int:
        j = after[i]
        r = get(parts[i] + parts[j]) if j < n else None
        return _BIG if r is None else r * size + i

    while (top := tree[1]) < _BIG:
        i = top % size
        j = after[i]
        parts[i] += parts[j]
        parts[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        if j < n - 1:
            update(j, _BIG)
        update(i, pair(i))
        if before[i] >= 0:
            update(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return tuple(out)


class _Pieces(dict):
    """Piece -> ids; a piece stands for itself with one space before it."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encoder.direct(" " + piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Encoder of one vocabulary without special tokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.pieces = _Pieces(self)

    def direct(self, text: str) -> tuple[int, ...]:
        """Ids by the pattern alone."""
        words, out = self.words, []
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                ids = merge(w.encode("utf-8", "surrogatepass"), self.ranks)
                if len(w) <= CACHE_LENGTH:
                    if len(words) >= CACHE_ENTRIES:
                        words.clear()
                    words[w] = ids
            out.extend(ids)
        return tuple(out)

    def parts(self, text: str | None) -> Iterator[tuple[int, ...]]:
        """Ids of a text, piece by piece; nothing for empty and null texts."""
        if not text:
            return iter(())
        if _ODD_SPACE.search(text):
            return iter((self.direct(text),))
        first, *rest = text.split(" ")
        return chain((self.direct(first),), map(self.pieces.__getitem__, rest))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text)))

    def count(self, text: str | None) -> int:
        return sum(map(len, self.parts(text)))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """The encoder of this Python worker, kept between tasks."""
    key = (path or default_path(), pattern or default_pattern())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col, ids array<int>`` for every row: token ids of the whole text, an empty list for empty and null texts.

    No shuffle; order and copies of rows are kept as they are. ``path`` is a rank file that every executor can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                docs = [enc.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(docs) + 1, np.int32)
                np.cumsum([len(d) for d in docs], out=offsets[1:])
                values = np.fromiter(chain.from_iterable(docs), np.int32, int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [id_col, "ids"])

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``id_col, n_tokens int`` for every row; 0 for empty and null texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for batch in batches:
            n = np.fromiter((enc.count(t) for t in batch.column(1).to_pylist()), np.int32, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], [id_col, "n_tokens"])

    rows = df.select(id_col, text_col)
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens int")

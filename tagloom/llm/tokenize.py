"""Encoding of texts with a public byte-level BPE vocabulary (problem 6).

A text is cut by the vocabulary's public pattern into pieces; each piece's bytes are merged by rank. The merge of a
piece keeps its adjacent pairs' ranks in a segment tree whose root names the leftmost pair of the lowest rank; a
merge is a constant number of point updates, so a piece of n bytes costs O(n log n) however long it is.
Pieces recur, so each Python worker keeps the ids of those it has seen, within a bound.
"""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..session import spread

# Fixed value: the split pattern that the vocabulary is published with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO_PIECES = 300_000  # pieces kept per Python worker
MEMO_BYTES = 64  # longer pieces aren't kept


def vocabulary_folder(folder: str | None = None) -> str:
    """The given folder, else that of the public_tokenizers package, else /opt/tokenizers."""
    if folder:
        return folder
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class MergeTree:
    """Segment tree over the ranks of adjacent pairs; the root gives the leftmost lowest-ranked one."""

    NONE = 1 << 60

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        self.node = [self.NONE] * size + keys + [self.NONE] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = a if a <= b else b

    def least(self) -> int:
        return self.node[1]

    def put(self, at: int, key: int) -> None:
        node = self.node
        i = at + self.size
        node[i] = key
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a <= b else b
            if node[i] == low:
                break
            node[i] = low
            i >>= 1


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the leftmost pair of the lowest rank is merged until no pair is in the vocabulary.

    A tree key is rank * n + position, so that the least key is the lowest rank and, of equals, the leftmost.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    if n == 1:
        return [ranks[piece]]
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    none = MergeTree.NONE

    def key(i: int, j: int) -> int:
        r = ranks.get(parts[i] + parts[j])
        return none if r is None else r * n + i

    tree = MergeTree([key(i, i + 1) for i in range(n - 1)])
    while (low := tree.least()) < none:
        i = low % n
        j = nxt[i]
        parts[i] += parts[j]
        parts[j] = None
        k = nxt[j]
        nxt[i] = k
        if j < n - 1:
            tree.put(j, none)
        if k < n:
            prv[k] = i
            tree.put(i, key(i, k))
        else:
            tree.put(i, none)
        h = prv[i]
        if h >= 0:
            tree.put(h, key(h, i))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Encoder of one worker: compiled pattern, ranks, and the ids of the pieces seen so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.find = regex.compile(pattern).findall
        self.ranks = ranks
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> list[int]:
        out: list[int] = []
        memo, add = self.memo, out.extend
        for p in self.find(text):
            ids = memo.get(p)
            if ids is None:
                raw = p.encode("utf-8", "surrogatepass")
                ids = tuple(merge_piece(raw, self.ranks))
                if len(raw) <= MEMO_BYTES:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[p] = ids
            add(ids)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, made once per Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(load_ranks(path))
    return _ENCODERS[path]


def encode_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids) of every row, without special tokens; strings of special tokens in a text are ordinary text.

    Null and empty texts both give an empty list, never null. Rows keep their order within a partition, nothing is
    shuffled, and repeated or null identifiers are kept as they are. The vocabulary is read by each worker from
    ``folder`` (default: the installed public tokenizers).
    """
    path = os.path.join(vocabulary_folder(folder), f"{vocabulary}.tiktoken")
    src = spread(docs.select(id_col, text_col))
    schema = T.StructType([src.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            flat: list[int] = []
            ends = [0]
            for s in b.column(1).to_pylist():
                if s:
                    flat.extend(enc(s))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    return src.mapInArrow(run, schema)

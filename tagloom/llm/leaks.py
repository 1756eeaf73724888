"""Evaluation texts inside training texts (problem 7), by Wu-Manber multi-pattern search over words.

Both sides are reduced to plain words. Of a passage of L words in which at most L/8 differ, some six words in a row
are untouched: (L - L/8) / (L/8 + 1) is at least 6 from L = 20 on, rounded up. So the patterns are all runs of six
words of all items. The search moves a window of six words: the last three form a block, whose entry in the shift
table says how far the window may jump; where it may not, the block's bucket gives the patterns that are compared
word by word. Every occurrence fixes an alignment of item and document, along which the longest passage within the
tolerance is then measured exactly.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

RUN = 6  # words of a pattern; lossless for LEAST and TOLERANCE
BLOCK = 3  # words of a block
LEAST = 20  # words in a row
TOLERANCE = 8  # one word in so many may differ

_TAG = re.compile(r"</?[A-Za-z!](?:[^<>]{0,200}|[^<>=]{0,200}=[^<>]*)>")  # longer ones have attributes
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_LINE_NO = re.compile(r"^[ \t>*#|]*(\d{1,6})(?:[.:)\]|]|[ \t]*\||\t)[ \t]*")
_SOFT = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011][ \t]*\r?\n[ \t>*#|]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_APOSTROPHE = re.compile("(?<=\\w)['\u2019\u02bc\uff07](?=\\w)")


def _without_line_numbers(text: str) -> str:
    """Lines' leading numbers go where they count up from line to line; other numbers are words."""
    lines = text.split("\n")
    nums = [(m := _LINE_NO.match(x)) and (int(m[1]), m.end()) for x in lines]
    for i, x in enumerate(nums):
        if x and any(y and abs(y[0] - x[0]) == 1 and (y[0] - x[0]) == j for y, j in ((nums[i - 1] if i else None, -1), (nums[i + 1] if i + 1 < len(nums) else None, 1))):
            lines[i] = lines[i][x[1] :]
    return "\n".join(lines)


def words(text: str | None) -> list[str]:
    """Words in plain form: no case, accents, letter width, punctuation, line breaks, line numbers or markup."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _SOFT.sub("", text))
        text = "".join(c for c in text if not unicodedata.combining(c))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "\n" in text:
        text = _without_line_numbers(text)
        text = _HYPHEN.sub("", text)
    return _WORD.findall(_APOSTROPHE.sub("", text).casefold())


class WuManber:
    """Search for all runs of RUN words of the items; words are numbers, 0 is any word that no item has."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.number: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item_id, ws in items:
            self.items.append((item_id, [self.number.setdefault(w, len(self.number) + 1) for w in ws]))
        self.base = len(self.number) + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[int, int]]] = {}
        far = RUN - BLOCK + 1
        for k, (_, ws) in enumerate(self.items):
            for p in range(len(ws) - RUN + 1):
                for j in range(far):
                    h = self._block(ws, p + j)
                    room = far - 1 - j
                    if room < self.shift.get(h, far):
                        self.shift[h] = room
                self.bucket.setdefault(self._block(ws, p + far - 1), []).append((k, p))

    def _block(self, ws: list[int], at: int) -> int:
        return (ws[at] * self.base + ws[at + 1]) * self.base + ws[at + 2]

    def alignments(self, doc: list[int]) -> set[tuple[int, int]]:
        """(item, document position minus item position) of every pattern that occurs."""
        out: set[tuple[int, int]] = set()
        n, base, far = len(doc), self.base, RUN - BLOCK + 1
        shift, bucket = self.shift, self.bucket
        at = RUN - BLOCK  # start of the window's last block
        while at + BLOCK <= n:
            h = (doc[at] * base + doc[at + 1]) * base + doc[at + 2]
            jump = shift.get(h, far)
            if jump:
                at += jump
                continue
            start = at - (RUN - BLOCK)
            window = doc[start : start + RUN]
            for k, p in bucket[h]:
                if (k, start - p) not in out and self.items[k][1][p : p + RUN] == window:
                    out.add((k, start - p))
            at += 1
        return out

    def longest(self, item: list[int], doc: list[int], offset: int) -> tuple[int, int, int]:
        """(words, differing words, start in the document) of the longest passage within the tolerance."""
        lo, hi = max(0, -offset), min(len(item), len(doc) - offset)
        total, lows, best = 0, [(0, lo)], (0, 0, 0)
        sums = [0]
        for p in range(lo, hi):
            total += 1 if item[p] == doc[p + offset] else 1 - TOLERANCE
            sums.append(total)
        # the earliest start whose sum is no larger than the sum at the end: starts with new lows suffice
        lows = [0]
        for i, s in enumerate(sums):
            if s < sums[lows[-1]]:
                lows.append(i)
        k = len(lows) - 1
        for e in range(len(sums) - 1, 0, -1):
            while k >= 0 and lows[k] >= e:
                k -= 1
            while k > 0 and sums[lows[k - 1]] <= sums[e]:
                k -= 1
            if k >= 0 and sums[lows[k]] <= sums[e] and e - lows[k] > best[0]:
                size = e - lows[k]
                best = (size, (size - (sums[e] - sums[lows[k]])) // TOLERANCE, lo + lows[k] + offset)
        return best

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, words, differing words, first word in the document) of each item that the text contains."""
        get = self.number.get
        doc = [get(w, 0) for w in words(text)]
        best: dict[int, tuple[int, int, int]] = {}
        for k, offset in sorted(self.alignments(doc)):
            got = self.longest(self.items[k][1], doc, offset)
            if got[0] >= LEAST and got > best.get(k, (0, 0, 0)):
                best[k] = got
        return [(self.items[k][0], *v) for k, v in sorted(best.items())]


OUT = "doc_id bigint, item_id bigint, n_words int, n_different int, first_word int"
_NAMES = [x.split()[0] for x in OUT.split(", ")]
ITEM_BYTES = 8 << 20  # of item text up to which the search tables are broadcast: some 5 times that as sent, 30 times in a worker
BLOOM_BITS = 1 << 29  # of the filter of runs beyond it: 64 MiB whatever the items


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64() if j < 2 else pa.int32()) for j, c in enumerate(cols)], names=_NAMES)


def contained_items(docs: DataFrame, items: DataFrame, max_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, n_words, n_different, first_word) of every document and item it contains.

    An item counts for a passage of at least 20 of its words in a row with at most one word in eight different, also
    when other items share the passage. The items' size is measured first: up to ``max_bytes`` of text their tables
    are broadcast and the corpus is read once, without a shuffle; beyond, runs of words are joined (see
    joined_items), with the same rows. Null and empty texts contain nothing; items of fewer than 20 words can't be
    contained; repeated documents are reported each, repeated items once.
    """
    items = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    src = docs.where("text is not null and length(text) > 0").select("doc_id", "text")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > max_bytes:
        return joined_items(src, items)
    whole = [(r[0], words(r[1])) for r in items.orderBy("item_id").toLocalIterator()]
    engine = docs.sparkSession.sparkContext.broadcast(WuManber([x for x in whole if len(x[1]) >= LEAST]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = engine.value.find
        for b in batches:
            got = [(d, *x) for d, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in find(s)]
            if got:
                yield _batch(got)

    return spread(src).mapInArrow(run, OUT)


def _run_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hash of every run of RUN words."""
    n = len(ws) - RUN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in ws], dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(RUN):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _runs(rows: DataFrame, key: str, keep: np.ndarray | None = None) -> DataFrame:
    """(h, key, at) of the runs of every text; ``keep``: a broadcast bitmap of the hashes that matter."""
    shared = None if keep is None else rows.sparkSession.sparkContext.broadcast(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ks, ps = [], [], []
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = _run_hashes(words(s))
                at = np.arange(h.size, dtype=np.int32)
                if shared is not None:
                    bit = h % np.uint64(BLOOM_BITS)
                    hit = (shared.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
                    at = np.flatnonzero(hit).astype(np.int32)
                    h = h[at]
                hs.append(h.view(np.int64))
                ps.append(at)
                ks.append(np.full(h.size, k, dtype=np.int64))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ks, ps)], names=["h", key, "at"])

    return rows.mapInArrow(run, f"h bigint, {key} bigint, at int")


def _bitmap(runs: DataFrame) -> np.ndarray:
    """Bitmap of BLOOM_BITS bits of the hashes, made in pieces where the runs are; its size doesn't depend on them."""
    piece = 1 << 15  # bits

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = np.zeros(BLOOM_BITS >> 3, dtype=np.uint8)
        for df in frames:
            bit = df["h"].to_numpy().view(np.uint64) % np.uint64(BLOOM_BITS)
            np.bitwise_or.at(full, (bit >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)))
        parts = full.reshape(-1, piece >> 3)
        some = np.flatnonzero(parts.any(axis=1))
        for lo in range(0, some.size, 256):
            yield pd.DataFrame({"piece": some[lo : lo + 256], "bits": [parts[i].tobytes() for i in some[lo : lo + 256]]})

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"piece": [df["piece"].iloc[0]], "bits": [np.bitwise_or.reduce(np.stack([np.frombuffer(x, dtype=np.uint8) for x in df["bits"]])).tobytes()]})

    out = np.zeros(BLOOM_BITS >> 3, dtype=np.uint8)
    schema = "piece bigint, bits binary"
    for r in runs.select("h").mapInPandas(run, schema).groupBy("piece").applyInPandas(merge, schema).toLocalIterator():
        out[r["piece"] * (piece >> 3) : (r["piece"] + 1) * (piece >> 3)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def joined_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """contained_items for items of any size: runs of six words of both sides meet by their hash.

    A bitmap of the items' hashes, of fixed size, keeps all but a few of the corpus' other runs from the shuffle.
    What meets gives alignments, one per document, item and offset; these are verified on the texts, so equal
    hashes of different runs cost a comparison and no row. Spark splits hot hashes at run time (skew joins of AQE).
    """
    own = docs.withColumn("uid", F.xxhash64("doc_id", "text"))  # also of documents without an id; of equal ones the same
    mine = _runs(items, "item_id").withColumnRenamed("at", "p")
    theirs = _runs(spread(own.select("uid", "text")), "uid", _bitmap(mine))
    met = theirs.join(mine, "h").select("uid", "item_id", (F.col("at") - F.col("p")).alias("offset")).distinct()
    each = met.groupBy("uid", "item_id").agg(F.collect_list("offset").alias("offsets"))
    pairs = each.join(items.withColumnRenamed("text", "item"), "item_id").join(own, "uid").select("doc_id", "item_id", "offsets", "item", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for d, i, offsets, item, text in zip(*(c.to_pylist() for c in b.columns)):
                ws = words(item)
                if len(ws) < LEAST:
                    continue
                engine = WuManber([(i, ws)])
                doc = [engine.number.get(w, 0) for w in words(text)]
                best = max((engine.longest(engine.items[0][1], doc, o) for o in offsets if -len(ws) < o < len(doc)), default=(0, 0, 0))
                if best[0] >= LEAST:
                    got.append((d, i, *best))
            if got:
                yield _batch(got)

    return pairs.mapInArrow(run, OUT)

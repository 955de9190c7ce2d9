"""Problem 8: the whole corpus encoded by a public byte-level BPE vocabulary.

Merges run through a hierarchical-bitmap rank queue: one bucket per merge rank holds positions of a
linked list, find-first-set over three levels of bitmap words gives the lowest rank present, and stale
entries are skipped when popped. A merge costs O(log) whatever the pre-token's length, so a text
without blanks of 100,000 characters is no special case. Pre-tokens seen before come from a bounded
cache per Python worker. Texts are encoded where they lie: no shuffle, no skew.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType

from lodespark.session import spread

#: Longest pre-token (characters) that is cached, and most entries the cache holds before it starts anew.
CACHE_CHARS, CACHE_ENTRIES = 64, 400_000

#: The published pattern; letters, numbers and blanks are spelled out for texts without letters and numbers beyond
#: the basic plane, which the standard library matches several times faster than general property classes.
_SHAPE = r"'(?:[sdmt]|ll|ve|re)| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(kind: str) -> str:
    """Character-class text of all basic-plane characters whose category begins with ``kind``."""
    held = [c for c in range(0x10000) if unicodedata.category(chr(c))[0] == kind]
    cuts = [0, *(i for i in range(1, len(held)) if held[i] != held[i - 1] + 1), len(held)]
    return "".join(f"\\u{held[a]:04x}-\\u{held[b - 1]:04x}" for a, b in zip(cuts, cuts[1:]))


_ASCII = re.compile(_SHAPE.format(L="A-Za-z", N="0-9", S=r"\t-\r "))
_WIDE = None
_EXACT = None


def pretokens(text: str) -> list[str]:
    """The pieces of the published splitting pattern."""
    global _WIDE, _EXACT
    if text.isascii():
        return _ASCII.findall(text)
    if all(c < "\U00010000" or unicodedata.category(c)[0] not in "LN" for c in set(text)):
        if _WIDE is None:
            _WIDE = re.compile(_SHAPE.format(L=_ranges("L"), N=_ranges("N"), S=_BLANK))
        return _WIDE.findall(text)
    if _EXACT is None:
        import regex

        _EXACT = regex.compile(_SHAPE.format(L=r"\p{L}", N=r"\p{N}", S=_BLANK))
    return _EXACT.findall(text)


class RankQueue:
    """Positions by merge rank; pops the lowest rank, leftmost position first.

    Level 0 has a bit per rank, level 1 a bit per word of level 0, level 2 a bit per word of level 1.
    """

    __slots__ = ("buckets", "words", "upper", "top")

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.words = [0] * ((ranks >> 6) + 1)
        self.upper = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.words[rank >> 6] |= 1 << (rank & 63)
        self.upper[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int] | None:
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        u = self.upper[a]
        b = (a << 6) + (u & -u).bit_length() - 1
        w = self.words[b]
        rank = (b << 6) + (w & -w).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.words[b] = w = w & (w - 1)
            if not w:
                self.upper[a] = u = u & (u - 1)
                if not u:
                    self.top &= self.top - 1
        return rank, position


class ByteBpe:
    """Encoder over a rank file (base64 token, blank, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.cache = _Cache(self)

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return [whole]
        n = len(data)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = [-1] * n  # rank of the pair that begins here, -1 if none or merged away
        queue = RankQueue(self.size)
        for i in range(n - 1):
            if (r := ranks.get(data[i : i + 2])) is not None:
                pair[i] = r
                queue.push(r, i)
        while (head := queue.pop()) is not None:
            rank, i = head
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            pair[j] = -1
            if k < n:
                before[k] = i
                r = ranks.get(data[i : after[k]])
                if r is None:
                    pair[i] = -1
                else:
                    pair[i] = r
                    queue.push(r, i)
            else:
                pair[i] = -1
            if (h := before[i]) >= 0:
                r = ranks.get(data[h:k])
                if r is None:
                    pair[h] = -1
                elif pair[h] != r:
                    pair[h] = r
                    queue.push(r, h)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[data[i : after[i]]])
            i = after[i]
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.cache.__getitem__, pretokens(text))))

    def count(self, text: str) -> int:
        return sum(map(len, map(self.cache.__getitem__, pretokens(text))))


class _Cache(dict):
    def __init__(self, bpe: ByteBpe):
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.bpe.merge(piece.encode("utf-8", "replace")))
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


_HELD: dict[str, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """The worker's encoder for a rank file, read once per Python worker."""
    if path not in _HELD:
        _HELD[path] = ByteBpe(path)
    return _HELD[path]


def encode_corpus(df: DataFrame, key: str, text: str, path: str, rows: int = 512) -> DataFrame:
    """``(key, ids)``: the ids of every text, without special tokens; null and empty texts have ``[]``.

    Repeated rows stay repeated; a null key is kept. ``path`` is the rank file, on every worker.
    """
    schema = df.select(key).schema.add("ids", ArrayType(IntegerType()))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                lists = [bpe.encode(t) if t else [] for t in batch.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(task, schema)


def count_tokens(path: str):
    """A pandas UDF: number of tokens of a text, 0 for null."""
    @pandas_udf("bigint")
    def tokens(texts: pd.Series) -> pd.Series:
        bpe = encoder(path)
        return pd.Series([bpe.count(t) if t else 0 for t in texts], dtype="int64")

    return tokens

"""Problem 10: texts above a token limit cut into pieces at natural places, with an overlap.

Lexical cohesion: every sentence end is scored by how far the similarity of the word blocks before and
after it falls below the peaks on both sides. Within the window in which a piece may end, the deepest
valley is the cut; the next piece begins with the given overlap. Each text is cut where it lies.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.llm.bpe import ByteBpe, encoder, pretokens
from lodespark.session import spread

_END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s|$)|[。！？]+|[^\S\n]*\n[\s]*")
#: Width of hashed word vectors; sentences in a block; characters of a part of an overlong pre-token.
DIMENSIONS, BLOCK, PART = 256, 6, 32


def _parts(text: str) -> list[str]:
    """Pre-tokens, overlong ones in parts, so that a cut can always be found."""
    out = []
    for p in pretokens(text):
        if len(p) <= PART:
            out.append(p)
        else:
            out.extend(p[i : i + PART] for i in range(0, len(p), PART))
    return out


def valley_depths(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Depth of the cohesion valley at each sentence end; ``words`` are hashed parts, ``ends`` part indices."""
    unit = np.searchsorted(ends, np.arange(len(words)), "right")
    units = len(ends) + 1
    used = words >= 0
    bag = np.bincount(unit[used] * DIMENSIONS + words[used], minlength=units * DIMENSIONS).reshape(units, DIMENSIONS)
    total = np.vstack([np.zeros(DIMENSIONS), np.cumsum(bag, axis=0)])
    gap = np.arange(1, units)
    left = total[gap] - total[np.maximum(gap - BLOCK, 0)]
    right = total[np.minimum(gap + BLOCK, units)] - total[gap]
    size = np.sqrt((left**2).sum(1) * (right**2).sum(1))
    similar = np.divide((left * right).sum(1), size, out=np.zeros(len(gap)), where=size > 0)
    depth = np.zeros(len(gap))
    for side in (similar, similar[::-1]):
        peak, climb = np.empty(len(gap)), -1.0
        for i, s in enumerate(side):  # the peak reached by climbing away from the gap
            climb = climb if i and climb >= s and side[i - 1] >= s else s
            peak[i] = climb
        depth += (peak - side) if side is similar else (peak - side)[::-1]
    return depth


def cut_text(text: str, bpe: ByteBpe, limit: int, overlap: int, least: float = 0.5) -> list[tuple[int, int, int, str]]:
    """``(start, end, tokens, kind)`` in characters of each piece; empty if ``text`` is within the limit.

    ``kind`` tells where a piece ends: at a ``sentence`` end, a ``blank``, ``inside`` a run without either,
    or at the ``end`` of the text. Of the sentence ends in the window the deepest valley whose piece is
    within the limit is the cut; if the tokens at a cut differ from the count so far, the next deepest.
    """
    if len(text.encode("utf-8", "replace")) <= limit or bpe.count(text) <= limit:
        return []
    parts = _parts(text)
    cache = bpe.cache
    cum = np.concatenate([[0], np.cumsum(np.fromiter((len(cache[p]) for p in parts), np.int64, len(parts)))])
    chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])
    ends = np.unique(np.searchsorted(chars, [m.end() for m in _END.finditer(text)], "left"))
    ends = ends[(ends > 0) & (ends < len(parts))]
    known: dict[str, int] = {}
    words = np.empty(len(parts), np.int64)
    for i, p in enumerate(parts):
        if (h := known.get(p)) is None:
            word = p.strip().lower()
            h = known[p] = zlib.crc32(word.encode("utf-8", "replace")) % DIMENSIONS if len(word) > 3 or not word.isascii() and word else -1
        words[i] = h
    depth = valley_depths(words, ends)
    n = len(parts)

    def places(done: int, start: int, stop: int) -> Iterator[tuple[int, str]]:
        """Where a piece may end, best first."""
        if stop < n:
            low = int(np.searchsorted(cum, cum[start] + least * limit, "left"))
            a, b = np.searchsorted(ends, [max(low, done + 1), stop + 1])
            if a == b:
                a, b = np.searchsorted(ends, [done + 1, stop + 1])
                a = max(a, b - 1)
            window = np.arange(a, b)
            for i in window[np.lexsort((-window, -depth[window]))]:
                yield int(ends[i]), "sentence"
            blank = next((i for i in range(stop, done, -1) if parts[i][0].isspace()), 0)
            if blank:
                yield blank, "blank"
        yield stop, "end" if stop == n else "inside"

    pieces, start, done = [], 0, 0
    while done < n:
        stop = int(np.searchsorted(cum, cum[start] + limit, "right")) - 1
        stop = max(stop, done + 1)
        kind = "end" if stop == n else "inside"
        for at, what in places(done, start, stop):
            tokens = bpe.count(text[chars[start] : chars[at]])
            if tokens <= limit:
                stop, kind = at, what
                break
        while tokens > limit and not (stop <= done + 1 and start == done):
            if stop > done + 1:
                stop, kind = stop - 1, "inside"
            else:
                start += 1  # the overlap gives way
            tokens = bpe.count(text[chars[start] : chars[stop]])
        pieces.append((int(chars[start]), int(chars[stop]), tokens, kind))
        done = stop
        start = max(start + 1, int(np.searchsorted(cum, cum[stop] - overlap, "left")))
        start = min(start, done)
    return pieces


def split_oversized(df: DataFrame, key: str, text: str, path: str, limit: int = 1024, overlap: int = 64) -> DataFrame:
    """``(key, piece_no, start_char, end_char, tokens, kind, piece)`` of every text above ``limit`` tokens.

    Each piece has at most ``limit`` tokens of the vocabulary at ``path``. From the second on it begins
    with as many whole pre-tokens of the piece before as fit into ``overlap`` tokens. Without the
    overlaps the pieces are the text. ``kind`` tells where the piece ends (see ``cut_text``). Texts within the limit, null and empty ones give no rows.
    Repeated rows and rows with a null key are cut like any other.
    """
    kind = dict(df.dtypes)[key]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(path)
        for batch in batches:
            rows = []
            for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                if t:
                    rows += [(k, i, a, b, n, how, t[a:b]) for i, (a, b, n, how) in enumerate(cut_text(t, bpe, limit, overlap), 1)]
            yield pd.DataFrame(rows, columns=[key, "piece_no", "start_char", "end_char", "tokens", "kind", "piece"])

    schema = f"`{key}` {kind}, piece_no bigint, start_char bigint, end_char bigint, tokens bigint, kind string, piece string"
    return spread(df.select(key, text)).mapInPandas(task, schema)


def cut_report(pieces: DataFrame, limit: int) -> DataFrame:
    """``(kind, cuts, share, tokens, over)``: how many pieces end where, their mean tokens, and how many are above ``limit``."""
    per = pieces.groupBy("kind").agg(F.count("*").alias("cuts"), F.round(F.avg("tokens"), 1).alias("tokens"), F.count_if(F.col("tokens") > limit).alias("over"))
    total = per.agg(F.sum(F.when(F.col("kind") != "end", F.col("cuts"))).alias("all"))  # a row per kind: four at most
    share = F.when(F.col("kind") != "end", F.round(F.try_divide("cuts", "all"), 4))
    return per.join(F.broadcast(total)).select("kind", "cuts", share.alias("share"), "tokens", "over")

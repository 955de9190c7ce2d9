"""What the vector problems share: reading vectors, and scoring them in blocks of an inverted index."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.session import cut, release, spread

#: Most queries and index rows that meet in one task; larger cells are split.
QUERY_BLOCK, INDEX_BLOCK = 2048, 4096
#: Rows that meet in one pass: as many as the table has, or these; more are taken in several passes.
PASS_ROWS = 20_000
#: What a vector is in a block: indexed, asking, or (both bits) the two at once.
BASE, QUERY = 1, 2


def numbers(text: str, size: int) -> np.ndarray | None:
    """The JSON array ``text`` of ``size`` finite numbers, not all zero; else None."""
    if '"' in text or "true" in text or "false" in text:
        return None
    try:
        v = np.array(json.loads(text), dtype=float)
    except (ValueError, TypeError, RecursionError):
        return None
    return v if v.shape == (size,) and np.isfinite(v).all() and v.any() else None


def parsed(text: str, size: int) -> np.ndarray | None:
    """The unit vector of a JSON array of ``size`` finite numbers, not all zero; else None."""
    v = numbers(text, size)
    return None if v is None else units(v[None])[0]


def units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def packed(rows: np.ndarray) -> list[bytes]:
    """Each row without loss in few bytes: as whole numbers of 2 or 4 bytes over a power of ten where that gives the very same doubles, else as these.

    The first byte is the power, 16 more for 4 bytes, 255 for doubles.
    """
    out: list[bytes] = [b""] * len(rows)
    left = np.arange(len(rows))
    with np.errstate(over="ignore", invalid="ignore"):
        for power in range(10):
            whole = np.rint(rows[left] * 10.0**power)
            top = np.abs(whole).max(1, initial=0)
            same = (whole / 10.0**power == rows[left]).all(1) & (top < 2**31)
            for i, r, small in zip(left[same].tolist(), whole[same], top[same] < 2**15):
                out[i] = bytes([power]) + r.astype("<i2").tobytes() if small else bytes([16 + power]) + r.astype("<i4").tobytes()
            left = left[~same]
            if not len(left):
                break
    for i in left.tolist():
        out[i] = b"\xff" + rows[i].astype("<f8").tobytes()
    return out


def unpacked(values: list[bytes]) -> np.ndarray:
    """The rows that ``packed`` was given."""
    codes = np.frombuffer(b"".join(x[:1] for x in values), np.uint8)
    out = None
    for code in np.unique(codes):
        at = np.flatnonzero(codes == code)
        kind, by = ("<f8", 1.0) if code == 255 else ("<i4", 10.0 ** (code - 16)) if code >= 16 else ("<i2", 10.0**code)
        rows = np.frombuffer(b"".join(values[i][1:] for i in at.tolist()), kind).reshape(len(at), -1) / by
        out = np.empty((len(values), rows.shape[1])) if out is None else out
        out[at] = rows
    return out


def _texts(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``(id, t)``: of the usable texts of each key the smallest."""
    held = df.select(F.col(key).alias("id"), F.col(text).alias("t")).where("id is not null and t is not null")
    kind = held.schema["id"].dataType.simpleString()

    def usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[[numbers(t, size) is not None for t in b["t"]]]

    return spread(held).mapInPandas(usable, f"id {kind}, t string").groupBy("id").agg(F.min("t").alias("t"))


def unit_vectors(df: DataFrame, key: str, text: str, size: int = 200) -> DataFrame:
    """``(id, v)``: one unit vector (``array<double>``) per key.

    Usable is a JSON array of ``size`` finite numbers, not all zero; anything else, and a null key, is
    left out. A key counts once; of several usable vectors of one key the smallest text is taken. What
    is shuffled for that is the text, combined map side.
    """
    texts = _texts(df, key, text, size)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "v": [parsed(t, size) for t in b["t"]]})

    return texts.mapInPandas(read, f"id {texts.schema['id'].dataType.simpleString()}, v array<double>")


def packed_vectors(df: DataFrame, key: str, text: str, size: int = 200) -> DataFrame:
    """``(id, v)`` as ``unit_vectors``, the numbers as written in few bytes (``binary``); ``matrix`` makes unit vectors of them."""
    texts = _texts(df, key, text, size)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": packed(np.stack([numbers(t, size) for t in b["t"]]))})

    return texts.mapInPandas(pack, f"id {texts.schema['id'].dataType.simpleString()}, v binary")


def as_arrays(vectors: DataFrame) -> DataFrame:
    """``(id, v)`` with ``v`` as ``array<double>``, whichever form it has."""
    if vectors.schema["v"].dataType.simpleString() != "binary":
        return vectors.select("id", "v")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "v": list(matrix(b["v"]))})

    return vectors.select("id", "v").mapInPandas(read, f"id {vectors.schema['id'].dataType.simpleString()}, v array<double>")


def matrix(values: pd.Series) -> np.ndarray:
    """Unit vectors of arrays of them or of what ``packed`` made."""
    if not len(values):
        return np.zeros((0, 1))
    held = values.to_numpy()
    return units(unpacked(held.tolist())) if isinstance(held[0], (bytes, bytearray)) else np.stack(held)


def _hash(ids: pd.Series) -> np.ndarray:
    return pd.util.hash_array(ids.to_numpy(dtype=object)).astype(np.uint64)


def blocked(
    vectors: DataFrame,
    route: Callable[[np.ndarray], tuple[np.ndarray, list[np.ndarray]]],
    cells: int,
    score: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame],
    schema: str,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Every query against every cell that ``route`` probes for it, in blocks of bounded size.

    ``route`` gives the home cell of each vector, under which it is indexed, and the cells it probes.
    Cells that draw many rows are split by a hash of the key on both sides, so a hot cell becomes many
    tasks. A vector goes once to a cell that it is both indexed under and probes. ``score`` gets ids and
    vectors of a query block and an index block. Blocks are taken in passes, each of about as many rows as
    the table has (``PASS_ROWS`` at least), whose shuffle files go before the next, so the disk taken does
    not grow with the cells probed. ``keep`` reduces what is found, in each pass and over all of them.
    """
    spark = vectors.sparkSession
    columns = f"id {vectors.schema['id'].dataType.simpleString()}, v {vectors.schema['v'].dataType.simpleString()}"

    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                home, probes = route(matrix(b["v"]))
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "home": home, "asked": probes})

    routed = cut(vectors.select("id", "v").mapInPandas(routes, f"{columns}, home int, asked array<int>"))
    queries, indexed = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    # bounded: one row per cell reaches the driver
    for r in routed.select(F.explode("asked").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect():
        queries[r["cell"]] = r["n"]
    for r in routed.groupBy("home").agg(F.count("*").alias("n")).collect():
        indexed[r["home"]] = r["n"]
    qn, bn = np.maximum(1, -(-queries // QUERY_BLOCK)), np.maximum(1, -(-indexed // INDEX_BLOCK))
    # a unit is a block of queries of a cell with all the cell's index; a pass has units in a row
    before, of = np.cumsum(qn) - qn, np.repeat(np.arange(cells), qn)
    rows = np.cumsum((queries / qn * bn + indexed)[of])
    passes = max(1, int(-(-rows[-1] // max(int(indexed.sum()), PASS_ROWS))))
    ends = np.unique([*np.searchsorted(rows, rows[-1] * np.arange(1, passes) / passes, side="right"), len(of)])

    def placed(start: int, end: int) -> DataFrame:
        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                at = []
                for c, asked, x in zip(b["home"].tolist(), b["asked"], (_hash(b["id"]) >> np.uint64(3)).tolist()):
                    part = x % int(bn[c])
                    own = {(c, u - int(before[c]), part): BASE for u in range(max(start, int(before[c])), min(end, int(before[c] + qn[c])))}
                    for p in asked.tolist():
                        q = x % int(qn[p])
                        if start <= before[p] + q < end:
                            for i in range(bn[p]):
                                k = (p, q, i)
                                own[k] = own.get(k, 0) | QUERY
                    at.append([[*k, role] for k, role in own.items()])
                if at:
                    yield pd.DataFrame({"id": b["id"], "v": b["v"], "at": at})

        low, high = int(of[start]), int(of[end - 1])
        here = routed.where(F.col("home").between(low, high) | F.exists("asked", lambda c: c.between(low, high)))
        out = here.mapInPandas(place, f"{columns}, at array<array<int>>").select("id", "v", F.explode("at").alias("at"))
        return out.select("id", "v", *[F.col("at")[i].alias(c) for i, c in enumerate(("c", "q", "b", "role"))])

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        ids, v, role = rows["id"].to_numpy(), matrix(rows["v"]), rows["role"].to_numpy()
        asks, base = (role & QUERY) > 0, (role & BASE) > 0
        return score(ids[asks], v[asks], ids[base], v[base])

    found = [(int(a), int(b)) for a, b in zip([0, *ends], ends) if a < b]
    if len(found) == 1:
        return keep(placed(*found[0]).groupBy("c", "q", "b").applyInPandas(task, schema))
    parts = []
    for start, end in found:
        release(spark)
        parts.append(cut(keep(placed(start, end).groupBy("c", "q", "b").applyInPandas(task, schema))))
    release(spark)
    return keep(reduce(DataFrame.unionByName, parts))


def top_by(score: Column, k: int) -> Column:
    """Aggregate: the ``k`` largest of a struct column, in descending order."""
    return F.slice(F.sort_array(F.collect_list(score), asc=False), 1, k)

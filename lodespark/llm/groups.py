"""Problem 6: records divided into clusters of mutually similar records, each described.

Distributed k-means with parallel oversampled seeding (k-means||) gives cells, packed into blocks. A block
meets all blocks that the angles of its records to the centroids and the cells' radii don't rule out.
Within a block records at or above the similarity are linked, and close ones form clumps; between blocks a
record meets the members of a clump only if its angle to the clump's centre doesn't rule them out. A block
keeps one link per record, a pair of blocks one per component that it joins, and the links are contracted
to groups. Records that have terms and no vectors are vectorised with hashed
weighted features; k-means of those gives clusters of any records, described in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lodespark.llm.vectors import INDEX_BLOCK, PASS_ROWS, QUERY_BLOCK, as_arrays, matrix
from lodespark.operators.components import connected_components
from lodespark.session import cut, release

#: Documented bound: records that the centroids of the cells are fitted on. Radii are over all records.
SAMPLE = 65_536
#: Least cosine to the first record of a clump.
CLOSE = 0.75
#: More than the error of a cosine of single-precision unit vectors; what is that near a bound is decided in doubles.
ROUNDING = 3e-5


def hashed_features(df: DataFrame, key: str, terms: Column, size: int = 512) -> DataFrame:
    """``(id, v)``: unit vectors of hashed terms weighted by inverse document frequency.

    ``terms`` is an ``array<string>``; null terms don't count; rows without terms, or with no term of any
    weight, are left out. An empty table has no rows.
    """
    listed = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t.isNotNull())
    held = cut(df.select(F.col(key).alias("id"), listed.alias("terms")).where(F.size("terms") > 0))
    if held.isEmpty():
        return held.select("id", F.array().cast("array<double>").alias("v"))
    counted = HashingTF(inputCol="terms", outputCol="tf", numFeatures=size).transform(held)
    weighted = IDF(inputCol="tf", outputCol="w").fit(counted).transform(counted)
    unit = Normalizer(inputCol="w", outputCol="u").transform(weighted).select("id", vector_to_array("u").alias("v"))
    return unit.where(F.exists("v", lambda x: x != 0))


def link_components(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of the rows and columns of a boolean matrix of links; -1 without a link."""
    rows, columns = np.full(linked.shape[0], -1), np.full(linked.shape[1], -1)
    label = 0
    for seed in np.flatnonzero(linked.any(axis=1)):
        if rows[seed] >= 0:
            continue
        front = np.array([seed])
        while len(front):
            rows[front] = label
            reached = np.flatnonzero(linked[front].any(axis=0) & (columns < 0))
            columns[reached] = label
            front = np.flatnonzero(linked[:, reached].any(axis=1) & (rows < 0)) if len(reached) else reached
        label += 1
    return rows, columns


def packed_cells(sizes: np.ndarray, centres: np.ndarray, rows: int) -> list[np.ndarray]:
    """Blocks of each cell: neighbouring cells share one of about ``rows`` records, larger cells have several."""
    blocks: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sizes)
    left, at, opened, held = set(range(len(sizes))), 0, 0, 0
    while left:  # a chain from cell to nearest cell
        left.discard(at)
        if held and held + sizes[at] > rows:
            opened, held = opened + 1, 0
        parts = max(1, -(-int(sizes[at]) // rows))
        blocks[at] = np.arange(opened, opened + parts)
        opened, held = opened + parts - 1, held + int(sizes[at]) if parts == 1 else rows
        rest = np.array(sorted(left), np.int64)
        at = int(rest[(centres[rest] @ centres[at]).argmax()]) if left else at
    return blocks


def narrow(values: pd.Series) -> np.ndarray:
    """``matrix`` in single precision, made piece by piece."""
    return np.concatenate([matrix(values.iloc[x : x + QUERY_BLOCK]).astype(np.float32) for x in range(0, len(values), QUERY_BLOCK)])


def joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each of ``n`` nodes the smallest node that the edges ``u`` to ``v`` join it with."""
    label = np.arange(n)
    while (label[u] != label[v]).any():
        a, b = label[u], label[v]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def at_least(d: np.ndarray, least: float, rows: np.ndarray, columns: np.ndarray, exact: pd.Series, others: pd.Series) -> np.ndarray:
    """Where single-precision cosines ``d`` are ``least`` or more; near it they are made anew in doubles."""
    linked = d >= least
    i, j = np.nonzero(np.abs(d - least) <= ROUNDING)
    for x in range(0, len(i), 4096):
        p, q = i[x : x + 4096], j[x : x + 4096]
        linked[p, q] = np.einsum("ij,ij->i", matrix(exact.iloc[rows[p]]), matrix(others.iloc[columns[q]])) >= least
    return linked


def linked_within(v: np.ndarray, exact: pd.Series, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Component of each record of a block, and its clump: records of a component close to the clump's first."""
    n, us, vs = len(v), [], []
    for x in range(0, n, QUERY_BLOCK):
        for y in range(x, n, INDEX_BLOCK):
            rows, columns = np.arange(x, min(n, x + QUERY_BLOCK)), np.arange(y, min(n, y + INDEX_BLOCK))
            linked = at_least(v[rows] @ v[columns].T, least, rows, columns, exact, exact)
            linked &= rows[:, None] != columns[None, :]
            label, node = np.concatenate(link_components(linked)), np.concatenate([rows, columns])
            node, label = node[label >= 0], label[label >= 0]
            if len(node):
                first = np.full(label.max() + 1, n)
                np.minimum.at(first, label, node)
                us.append(node)
                vs.append(first[label])
    component = joined(n, np.concatenate(us), np.concatenate(vs)) if us else np.arange(n)
    order = np.argsort(component, kind="stable")
    clump, made = np.empty(n, np.int64), 0
    for left in np.split(order, np.flatnonzero(np.diff(component[order])) + 1):
        while len(left):
            near = v[left] @ v[left[0]] >= max(CLOSE, least + ROUNDING)
            near[0] = True
            clump[left[near]] = made
            left, made = left[~near], made + 1
    return component, clump


class Block:
    """Records of a block in the order of their clumps; those of several records with unit centre and angle to the farthest."""

    def __init__(self, row: pd.Series):
        self.ids, self.exact = np.asarray(row["ids"]), pd.Series(list(row["v"]))
        self.v = narrow(self.exact)
        self.component, clump = np.asarray(row["component"]), np.asarray(row["clump"])
        self.components = int(self.component.max()) + 1
        start = np.flatnonzero(np.diff(clump, prepend=-1))
        end = np.append(start[1:], len(clump))
        wide = end - start > 1
        self.single = start[~wide]
        centre = np.add.reduceat(self.v, start, axis=0, dtype=float)
        centre = (centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        far = np.minimum.reduceat(np.einsum("ij,ij->i", self.v, centre[np.repeat(np.arange(len(start)), end - start)]), start)
        self.start, self.end, self.centre = start[wide], end[wide], centre[wide]
        self.radius = np.arccos(np.clip(far[wide] - ROUNDING, -1, 1))

    def first_ids(self) -> np.ndarray:
        """The smallest id of each component."""
        order = np.lexsort((self.ids, self.component))
        return self.ids[order[np.flatnonzero(np.diff(self.component[order], prepend=-1))]]


def linked_between(a: Block, b: Block, least: float) -> np.ndarray:
    """Of each component of ``a``, then of ``b``, the smallest one that links between the two join it with."""
    root = np.arange(a.components + b.components)

    def join(x: np.ndarray, y: int) -> None:
        roots = np.unique(np.append(root[x], root[y]))
        root[np.isin(root, roots)] = roots[0]

    def meet(one: Block, rows: np.ndarray, first: int, other: Block, then: int) -> None:
        """``rows`` of one block against the clumps of several records of the other."""
        bound = np.where(np.arccos(least) + other.radius < np.pi, np.cos(np.arccos(least) + other.radius), -2) - ROUNDING
        for s in range(0, len(bound), 256):
            clumps, at = np.nonzero((one.v[rows] @ other.centre[s : s + 256].T >= bound[s : s + 256]).T)
            ends = np.searchsorted(clumps, np.arange(min(256, len(bound) - s) + 1))
            for c in np.unique(clumps).tolist():
                x = rows[at[ends[c] : ends[c + 1]]]
                y = np.arange(other.start[s + c], other.end[s + c])
                held = then + other.component[y[0]]
                x = x[root[first + one.component[x]] != root[held]]
                if len(x):
                    hit = at_least(one.v[x] @ other.v[y].T, least, x, y, one.exact, other.exact).any(axis=1)
                    if hit.any():
                        join(first + one.component[x[hit]], held)

    meet(a, np.arange(len(a.v)), 0, b, a.components)
    meet(b, b.single, a.components, a, 0)
    for s in range(0, len(a.single), QUERY_BLOCK):
        x = a.single[s : s + QUERY_BLOCK]
        for i, j in zip(*np.nonzero(at_least(a.v[x] @ b.v[b.single].T, least, x, b.single, a.exact, b.exact))):
            join(a.component[x[i : i + 1]], a.components + b.component[b.single[j]])
    return root


def similarity_groups(
    vectors: DataFrame, least: float = 0.57, rows_per_cell: int = 300, cells: int = 512, margin: float | None = None, block_rows: int = 16_384, side: int = 2
) -> DataFrame:
    """``(id, group_first_id)``: every id in a group of two or more, with the smallest id of its group.

    Two ids are in one group if joined, directly or through others, by cosines >= ``least``. ``vectors``
    has distinct ``id`` and ``v``, as unit vectors or packed. Exact: a block leaves out another only if the
    angle of each of its records to the centroid of each cell there, less the cell's radius over all rows,
    is above that of ``least``, and a record leaves out a clump by the same rule. Cells are packed into
    blocks of about ``block_rows``; a task has up to ``side`` blocks on either side, and a pass one such
    side against all the others, which is two copies of the table whose shuffle files go before the next.
    So the disk taken does not grow with the number of blocks; the time, where nothing can be left out,
    does. An explicit ``margin`` gives up exactness: only cells whose centroid's cosine is at most that much
    below that of the own cell are asked. An empty table has no rows.
    """
    spark = vectors.sparkSession
    vectors = cut(vectors)
    release(spark)
    n = vectors.count()
    kind, form = (vectors.schema[c].dataType.simpleString() for c in ("id", "v"))
    k = int(np.clip(n // rows_per_cell, 1, cells))
    if k > 1:
        bucket = F.pmod(F.xxhash64("id"), F.lit(1 << 24)) / (1 << 24)
        points = as_arrays(vectors.where(bucket < min(1.0, SAMPLE / n))).select(array_to_vector("v").alias("features"))
        model = KMeans(k=k, seed=7, initMode="k-means||", initSteps=3, maxIter=6, distanceMeasure="cosine").fit(points)
        centres = np.array(model.clusterCenters())
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        k = len(centres)
    else:
        centres = np.zeros((1, 1))

    def cosines(v: np.ndarray) -> np.ndarray:
        return np.clip(v @ centres.T, -1, 1) if k > 1 else np.zeros((len(v), 1))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, radius = np.zeros(k, np.int64), np.zeros(k)
        for b in batches:
            if len(b):
                s = cosines(matrix(b["v"]))
                home = s.argmax(1)
                sizes += np.bincount(home, minlength=k)
                np.maximum.at(radius, home, np.arccos(s[np.arange(len(s)), home]))
        yield pd.DataFrame({"cell": np.arange(k), "n": sizes, "r": radius})

    # bounded: one row per cell reaches the driver
    sizes, radius = np.zeros(k, np.int64), np.zeros(k)
    for r in vectors.select("v").mapInPandas(measure, "cell int, n bigint, r double").groupBy("cell").agg(F.sum("n").alias("n"), F.max("r").alias("r")).collect():
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["r"]
    blocks = packed_cells(sizes, centres, max(1, min(block_rows, max(2048, -(-n // 4)))))
    count = max(int(b[-1]) for b in blocks) + 1
    holds = np.zeros((k, count), np.float32)
    for c, b in enumerate(blocks):
        holds[c, b] = sizes[c] > 0
    reach = np.arccos(least) + radius + 1e-6  # the last for rounding

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                home = cosines(matrix(b["v"])).argmax(1)
                part = pd.util.hash_array(b["id"].to_numpy(dtype=object)) >> np.uint64(3)
                yield pd.DataFrame({"id": b["id"], "v": b["v"], "block": [blocks[c][int(x % np.uint64(len(blocks[c])))] for c, x in zip(home, part)]})

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asked = np.zeros(k, bool)
        for x in range(0, len(rows), QUERY_BLOCK):
            s = cosines(matrix(rows["v"].iloc[x : x + QUERY_BLOCK]))
            asked |= (np.arccos(s) <= reach if margin is None else s >= s.max(1, keepdims=True) - margin).any(axis=0)
        to = np.flatnonzero(asked.astype(np.float32) @ holds > 0)
        component, clump = linked_within(narrow(rows["v"]), rows["v"], least)
        order = np.argsort(clump, kind="stable")
        component = np.unique(component[order], return_inverse=True)[1]
        return pd.DataFrame({"block": [key[0]], "to": [to], "ids": [rows["id"].to_numpy()[order]], "v": [rows["v"].to_numpy()[order]], "component": [component], "clump": [clump[order]]})

    columns = f"block int, to array<int>, ids array<{kind}>, v array<{form}>, component array<int>, clump array<int>"
    built = cut(vectors.select("id", "v").mapInPandas(place, f"id {kind}, v {form}, block int").groupBy("block").applyInPandas(build, columns))
    release(spark)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids, component in zip(b["ids"], b["component"]):
                out = pd.DataFrame({"src": ids, "l": component})
                out["dst"] = out.groupby("l")["src"].transform("min")
                yield out.loc[out["src"] != out["dst"], ["src", "dst"]]

    links = [cut(built.select("ids", "component").mapInPandas(within, f"src {kind}, dst {kind}"))]
    # bounded: the numbers of the blocks that a block may have links in
    may = np.zeros((count, count), bool)
    for r in built.select("block", "to").collect():
        may[r["block"], r["to"]] = True
    may &= may.T
    np.fill_diagonal(may, False)
    side = max(1, min(side, count // 8))
    sides = -(-count // side)
    meets = np.array([[may[i * side : (i + 1) * side, j * side : (j + 1) * side].any() for j in range(sides)] for i in range(sides)])

    def link(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"src": pd.Series(dtype=object), "dst": pd.Series(dtype=object)})]
        left = [(r["block"], Block(r)) for _, r in rows[rows["block"] // side == key[0]].iterrows()]
        for _, r in rows[rows["block"] // side == key[1]].iterrows():
            near = [(i, a) for i, a in left if i < r["block"] and may[i, r["block"]]]
            b = Block(r) if near else None
            for _, a in near:
                root = linked_between(a, b, least)
                names = np.concatenate([a.first_ids(), b.first_ids()])
                moved = np.flatnonzero(root != np.arange(len(root)))
                out.append(pd.DataFrame({"src": names[moved], "dst": names[root[moved]]}))
        return pd.concat(out)

    held = built.select("block", "ids", "v", "component", "clump")
    wide = max(1, PASS_ROWS // max(n, 1))
    for s in range(0, sides, wide):
        pairs = [(i, j) for i in range(s, min(sides, s + wide)) for j in range(i, sides) if meets[i, j]]
        if not pairs:
            continue
        own: list[list[list[int]]] = [[] for _ in range(sides)]
        for i, j in pairs:
            for x in {i, j}:
                own[x].append([i, j])
        to = spark.createDataFrame([(x, p) for x, p in enumerate(own) if p], "side int, p array<array<int>>")
        sent = held.withColumn("side", F.floor(F.col("block") / side).cast("int")).join(F.broadcast(to.select("side", F.explode("p").alias("p"))), "side")
        sent = sent.select(F.col("p")[0].alias("i"), F.col("p")[1].alias("j"), "block", "ids", "v", "component", "clump")
        links.append(cut(sent.groupBy("i", "j").applyInPandas(link, f"src {kind}, dst {kind}")))
        release(spark)
    return connected_components(reduce(DataFrame.unionByName, links)).select("id", F.col("component").alias("group_first_id"))


def kmeans_clusters(vectors: DataFrame, rows_per_cluster: int = 200, clusters: int = 512, seed: int = 7) -> DataFrame:
    """``(id, cluster)`` of ``vectors (id, v)`` by distributed k-means with parallel oversampled seeding.

    About ``rows_per_cluster`` rows a cluster, at most ``clusters`` of them; cosine distance. An empty
    table has no rows, a table too small for two clusters has cluster 0.
    """
    vectors = cut(vectors)
    k = int(np.clip(vectors.count() // rows_per_cluster, 1, clusters))
    if k < 2:
        return vectors.select("id", F.lit(0).alias("cluster"))
    points = vectors.select("id", array_to_vector("v").alias("features"))
    fit = KMeans(k=k, seed=seed, initMode="k-means||", initSteps=3, maxIter=20, distanceMeasure="cosine", predictionCol="cluster")
    return fit.fit(points).transform(points).select("id", "cluster")


@F.pandas_udf(DoubleType())
def _dot(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", matrix(a), matrix(b)) if len(a) else np.zeros(0))


def _best(df: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """``(group, best)``: the ``k`` items of the highest score, ties by item; first within salts, so that a group of any size never meets in one task."""
    place = Window.partitionBy(group, "_salt").orderBy(F.desc(score), item)
    part = df.withColumn("_salt", F.pmod(F.xxhash64(item), F.lit(64))).withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= k)
    held = F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("far"), F.col(item).alias("item"))))
    return part.groupBy(group).agg(F.transform(F.slice(held, 1, k), lambda s: s["item"]).alias("best"))


def describe_groups(groups: DataFrame, vectors: DataFrame, terms: DataFrame, typical: int = 3, top_terms: int = 5, group: str = "group_first_id") -> DataFrame:
    """``(group, size, typical, keywords)``: members nearest the group's centroid, and its terms.

    ``groups`` is ``(id, group)``, ``terms`` has ``(id, term)``. Centroids are means combined map side; the
    typical members have the largest cosine to it (ties: smaller id); keywords are the most frequent terms
    (ties: alphabetical), possibly none.
    """
    member = groups.join(vectors, "id")
    centre = member.groupBy(group).agg(F.count("*").alias("size"), Summarizer.mean(array_to_vector("v")).alias("m"))
    centre = cut(centre.select(group, "size", vector_to_array("m").alias("m")))
    near = member.join(centre, group).select(group, F.col("id").cast("string").alias("id"), F.round(_dot("v", "m"), 9).alias("near"))
    best = _best(near, group, "id", "near", typical).select(group, F.array_join("best", ",").alias("typical"))
    words = groups.join(terms, "id").groupBy(group, "term").agg(F.count("*").alias("n"))
    words = _best(words, group, "term", "n", top_terms).select(group, F.array_join("best", ",").alias("keywords"))
    return centre.select(group, "size").join(best, group).join(words, group, "left")

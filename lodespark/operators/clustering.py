"""Lloyd steps, cluster statistics, and clustering of data read in rounds with compressed summaries."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.session import cut


def _squares(centres: list[list[float]]) -> Column:
    c = F.array(*[F.array(*[F.lit(float(v)) for v in centre]) for centre in centres])
    return F.transform(c, lambda m: F.aggregate(F.zip_with("x", m, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))


def _place(distances: str) -> Column:
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def nearest(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """``points (id, x)`` with ``cluster`` and squared ``distance`` to the nearest of a bounded list of centres; ties lowest."""
    d = points.withColumn("_d", _squares(centres))
    return d.select("id", "x", _place("_d").alias("cluster"), F.array_min("_d").alias("distance"))


def cluster_stats(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``(cluster, n, sum, sumsq)``: mergeable statistics, summed position by position with map-side partials."""
    e = assigned.select(cluster, F.posexplode("x").alias("at", "v"))
    s = e.groupBy(cluster, "at").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    held = s.groupBy(cluster).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "s", "q"))).alias("p"))
    return held.select(cluster, "n", F.transform("p", lambda p: p["s"]).alias("sum"), F.transform("p", lambda p: p["q"]).alias("sumsq"))


def lloyd(points: DataFrame, centres: list[list[float]], rounds: int = 100) -> tuple[DataFrame, list[list[float]]]:
    """Lloyd iterations from given centres until no label changes; an empty cluster keeps its centre.

    At most ``rounds``; where labels still change after them, a warning says so.
    """
    for _ in range(rounds):
        stats = cluster_stats(nearest(points, centres)).collect()  # one row per centre
        before, centres = centres, list(centres)
        for r in stats:
            centres[r["cluster"]] = [v / r["n"] for v in r["sum"]]
        both = points.select(_squares(before).alias("_a"), _squares(centres).alias("_b"))
        if both.where(_place("_a") != _place("_b")).isEmpty():
            break
    else:
        warnings.warn(f"Lloyd iterations: labels still change after {rounds} rounds", stacklevel=2)
    return nearest(points, centres), centres


class Summary:
    """Clusters as (n, sum, sum of squares): a mergeable monoid, a few rows per cluster."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray):
        self.n, self.s, self.q = n, s, q

    def mean(self) -> np.ndarray:
        return self.s / self.n[:, None]

    def variance(self) -> np.ndarray:
        return np.maximum(self.q / self.n[:, None] - self.mean() ** 2, 1e-10)

    def distance(self, x: np.ndarray) -> np.ndarray:
        """Mahalanobis distances of points (rows) to clusters (columns)."""
        m, w = self.mean(), 1 / self.variance()
        return np.sqrt(np.maximum((x * x) @ w.T - 2 * x @ (m * w).T + (m * m * w).sum(1), 0))


def read_in_rounds(points: DataFrame, k: int, rounds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Bradley-Fayyad-Reina clustering: ``(id, cluster)`` (-1 outlier) and a report row per round.

    The points ``(id, x)`` are divided into ``rounds`` by a hash. The first is clustered into 5k clusters;
    points alone in theirs are retained, the rest clustered into k. In each round a point joins the
    nearest discard cluster within 2 sqrt(d), else the nearest compressed one, else it is retained; the
    statistics are those of the round's start, so the order of rows means nothing. Retained points are
    clustered again, clusters of several become compressed ones, and compressed clusters within 2 sqrt(d)
    of each other merge; after the last round those near a discard cluster join it. Null vectors are
    left out. The driver holds summaries only; their number is bounded by 5k new ones a round.
    """
    p = cut(points.where("x is not null").select("id", "x", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(rounds)).cast("int").alias("round")))
    head = p.limit(1).collect()
    spark = points.sparkSession
    kind = points.schema["id"].dataType.simpleString()
    report_type = "round int, discard bigint, compressed_clusters int, compressed bigint, retained bigint"
    if not head:
        return spark.createDataFrame([], f"id {kind}, cluster int"), spark.createDataFrame([], report_type)
    dim = len(head[0]["x"])
    radius = 2 * np.sqrt(dim)

    def means(df: DataFrame, k: int) -> DataFrame:
        n = df.count()
        if n == 0:
            return df.withColumn("cluster", F.lit(0))
        fit = KMeans(k=max(2, min(k, n)), seed=seed, maxIter=15, featuresCol="_f", predictionCol="cluster")
        v = df.withColumn("_f", array_to_vector("x"))
        return (fit.fit(v).transform(v) if n > 1 else df.withColumn("cluster", F.lit(0))).select("id", "x", "cluster")

    def summary(df: DataFrame) -> tuple[list[int], Summary]:
        rows = cluster_stats(df).orderBy("cluster").collect()
        arr = lambda f: np.array([r[f] for r in rows], float).reshape(len(rows), dim)
        return [r["cluster"] for r in rows], Summary(np.array([r["n"] for r in rows], float), arr("sum"), arr("sumsq"))

    first = cut(means(p.where("round = 0"), 5 * k))
    alone = first.groupBy("cluster").agg(F.count("*").alias("n")).where("n = 1").select("cluster")
    retained = cut(first.join(F.broadcast(alone), "cluster", "left_semi").select("id", "x"))
    core = cut(means(first.join(F.broadcast(alone), "cluster", "left_anti").select("id", "x"), k))
    _, ds = summary(core)
    members = [core.select("id", (F.col("cluster")).alias("ds"), F.lit(None).cast("int").alias("cs"))]
    cs = Summary(np.zeros(0), np.zeros((0, dim)), np.zeros((0, dim)))
    alias: list[int] = []  # compressed cluster number as given out -> where it is now

    def compress() -> None:
        nonlocal retained, cs, alias
        again = cut(means(retained, 5 * k))
        many = again.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
        grouped = again.join(F.broadcast(many), "cluster", "left_semi")
        names, s = summary(grouped)
        retained = cut(again.join(F.broadcast(many), "cluster", "left_anti").select("id", "x"))
        if names:
            base = len(alias)
            number = F.create_map(*[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(base + i))])
            members.append(cut(grouped.select("id", F.lit(None).cast("int").alias("ds"), number[F.col("cluster")].cast("int").alias("cs"))))
            alias = alias + [len(cs.n) + i for i in range(len(names))]
            cs = Summary(np.concatenate([cs.n, s.n]), np.vstack([cs.s, s.s]), np.vstack([cs.q, s.q]))
        while len(cs.n) > 1:
            d = cs.distance(cs.mean())
            np.fill_diagonal(d, np.inf)
            i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
            if d[i, j] >= radius:
                break
            cs.n[i] += cs.n[j]
            cs.s[i] += cs.s[j]
            cs.q[i] += cs.q[j]
            cs = Summary(np.delete(cs.n, j), np.delete(cs.s, j, 0), np.delete(cs.q, j, 0))
            alias = [i if a == j else a - (a > j) for a in alias]

    compress()
    report = [(1, int(ds.n.sum()), len(cs.n), int(cs.n.sum()), retained.count())]
    for r in range(1, rounds):
        held_ds, held_cs = ds, cs

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                x = np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, dim))
                out = b[["id", "x"]].copy()
                for name, s in (("ds", held_ds), ("cs", held_cs)):
                    got = np.full(len(b), -1)
                    if len(s.n) and len(b):
                        d = s.distance(x)
                        got = np.where(d.min(1) < radius, d.argmin(1), -1)
                    out[name] = got
                yield out

        placed = cut(p.where(F.col("round") == r).select("id", "x").mapInPandas(assign, f"id {kind}, x array<double>, ds int, cs int"))
        for name in ("ds", "cs"):
            mine = placed.where("ds >= 0") if name == "ds" else placed.where("ds < 0 and cs >= 0")
            names, s = summary(mine.select("id", "x", F.col(name).alias("cluster")))
            target = ds if name == "ds" else cs
            for i, c in enumerate(names):
                target.n[c] += s.n[i]
                target.s[c] += s.s[i]
                target.q[c] += s.q[i]
        now = {a: i for i, a in reversed(list(enumerate(alias)))}  # a name for each present compressed cluster
        members.append(placed.where("ds >= 0").select("id", "ds", F.lit(None).cast("int").alias("cs")))
        if now:
            name = F.create_map(*[x for c, i in now.items() for x in (F.lit(c), F.lit(i))])
            members.append(placed.where("ds < 0 and cs >= 0").select("id", F.lit(None).cast("int").alias("ds"), name[F.col("cs")].cast("int").alias("cs")))
        retained = cut(retained.unionByName(placed.where("ds < 0 and cs < 0").select("id", "x")))
        compress()
        report.append((r + 1, int(ds.n.sum()), len(cs.n), int(cs.n.sum()), retained.count()))
    final = {}
    if len(cs.n):
        d = ds.distance(cs.mean())
        final = {i: int(d[a].argmin()) if d[a].min() < radius else -1 for i, a in enumerate(alias)}
    out = retained.select("id", F.lit(-1).alias("cluster"))
    joined = F.create_map(*[x for i, c in final.items() for x in (F.lit(i), F.lit(c))])[F.col("cs")] if final else F.lit(-1)
    for m in members:
        out = out.unionByName(m.select("id", F.coalesce(F.col("ds"), joined, F.lit(-1)).alias("cluster")))
    return out, spark.createDataFrame(report, report_type)

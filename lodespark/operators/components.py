"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)``: every vertex of ``edges`` with the smallest vertex of its component.

    A round points each vertex to the smallest of its closed neighbourhood, doubles the pointers until
    they end at the local minima, and contracts the edges along them. Local minima are at most half of
    the vertices that still have an edge, so rounds, and doublings within one, are logarithmic. Maps and
    edges are cut to the shared checkpoint folder. Nulls, self loops and repeated
    edges are allowed; a vertex seen only in self loops is its own component. Rounds go on until no edge
    is left; ``max_rounds`` halvings are enough for any table, and beyond them an error is raised.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    vertices = e.select(F.col("u").alias("id")).union(e.select("v")).distinct()
    live = cut(e.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps = []
    while not live.isEmpty():
        if len(maps) == max_rounds:
            raise RuntimeError(f"components: edges are left after {max_rounds} rounds")
        both = live.union(live.select("v", "u"))
        step = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("id"), "m"))
        while True:
            further = step.select(F.col("id").alias("m"), F.col("m").alias("next"))
            doubled = cut(step.join(further, "m").select("id", F.col("next").alias("m"), (F.col("m") != F.col("next")).alias("moved")))
            step = doubled.select("id", "m")
            if doubled.where("moved").isEmpty():
                break
        maps.append(step)
        left = step.select(F.col("id").alias("u"), F.col("m").alias("a"))
        right = step.select(F.col("id").alias("v"), F.col("m").alias("b"))
        moved = live.join(left, "u").join(right, "v").where("a <> b")
        live = cut(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    out = vertices.select("id", F.col("id").alias("component"))
    for step in maps:
        hop = step.select(F.col("id").alias("component"), "m")
        out = out.join(hop, "component", "left").select("id", F.coalesce("m", "component").alias("component"))
    return out

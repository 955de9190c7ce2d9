"""Problem 3: for each location the locations nearby and the circular regions that contain it.

The circle of every region (a town's, or the one around a well) is a boundary of a left and a right arc.
Boundaries are decomposed into trapezoids: the ordinates at which arcs begin and end, in order, cut the
plane into slabs of latitude; in a slab every arc that crosses it is an edge with its outermost and
innermost longitude there, and the edges lie in order. A point finds its slab by binary search, then its
edges by binary search within the slab; between the innermost edges of a region it is inside, between
innermost and outermost the exact great-circle distance decides.

Slabs are distributed by chunks of the plane, a grid for each power of two of the radius, so that a large
region never widens the search among small ones. Chunks with many points or edges are split into blocks
of both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.session import cut

#: Fixed value: metres of the sphere's radius.
EARTH_M = 6_371_008.8
_PAIRS_AT_ONCE = 2_000_000
#: Degrees that bounds are widened by, against rounding; the distance decides.
_PAD = 1e-6


def valid_location(lat: Column, lon: Column) -> Column:
    """Both present (not NaN), within +-90 and +-180, not both zero."""
    there = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    return there & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))


def great_circle_m(lat1, lon1, lat2, lon2):
    """Haversine distance in metres of numpy arrays in degrees."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _grid(cls: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Row and chunk of a place in the grid of radius class ``cls``: about eight times the class's radius wide and high."""
    height = F.least(F.degrees(F.pow(F.lit(2.0), cls) * 8 / EARTH_M), F.lit(180.0))
    row = F.floor(lat / height)
    return row.cast("int"), F.floor((lon + 180) / _chunk_width(height, row)).cast("int")


def _chunk_width(height: Column, row: Column) -> Column:
    nearest = F.when(row >= 0, row).otherwise(row + 1) * height  # the row's edge nearest the equator
    return F.least(F.lit(360.0), height / F.greatest(F.cos(F.radians(nearest)), F.lit(1e-6)))


def _chunks(regions: DataFrame) -> DataFrame:
    """Each region by the (row, chunk) of its class that its bounding box touches.

    Regions across the antimeridian appear shifted by 360 degrees as well; one that holds a pole spans
    every longitude.
    """
    regions = regions.withColumn("dlat", F.degrees(F.col("r_m") / EARTH_M) * (1 + 1e-9) + _PAD)
    ratio = F.try_divide(F.sin(F.radians("dlat")), F.cos(F.radians("lat")))
    pole = (F.abs("lat") + F.col("dlat") >= 89.999) | (ratio >= 1) | ratio.isNull()
    dlon = F.when(pole, 360.0).otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) + _PAD)
    regions = regions.withColumns({"pole": pole, "dlon": dlon})
    shifts = F.filter(
        F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)),
        lambda s: (F.col("lon") + s - F.col("dlon") <= 180) & (F.col("lon") + s + F.col("dlon") >= -180),
    )
    regions = regions.withColumn("shift", F.explode(F.when(F.col("pole"), F.array(F.lit(0.0))).otherwise(shifts)))
    lo, hi = F.col("lon") + F.col("shift") - F.col("dlon"), F.col("lon") + F.col("shift") + F.col("dlon")
    regions = regions.withColumns({"lo": F.greatest(lo, F.lit(-180.0)), "hi": F.least(hi, F.lit(180.0))})
    south, north = F.greatest(F.col("lat") - F.col("dlat"), F.lit(-90.0)), F.least(F.col("lat") + F.col("dlat"), F.lit(90.0))
    height = F.least(F.degrees(F.pow(F.lit(2.0), F.col("cls")) * 8 / EARTH_M), F.lit(180.0))
    regions = regions.withColumn("row", F.explode(F.sequence(F.floor(south / height).cast("int"), F.floor(north / height).cast("int"))))
    width = _chunk_width(height, F.col("row"))
    at = lambda c: F.floor((F.col(c) + 180) / width).cast("int")
    return regions.withColumn("chunk", F.explode(F.sequence(at("lo"), at("hi")))).select(
        F.col("key").alias("rkey"), F.col("lat").alias("rlat"), (F.col("lon") + F.col("shift")).alias("rlon"), "r_m", "pole", "cls", "row", "chunk"
    )


def _half_width(lat: np.ndarray, c_lat: np.ndarray, rho: np.ndarray) -> np.ndarray:
    """Degrees of longitude from a circle's centre to its arc at ``lat``; 0 where the circle does not reach."""
    a, b = np.radians(c_lat), np.radians(lat)
    down = np.cos(a) * np.cos(b)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = np.where(down > 1e-15, (np.cos(rho) - np.sin(a) * np.sin(b)) / down, 1.0)
    return np.degrees(np.arccos(np.clip(x, -1.0, 1.0)))


class Trapezoids:
    """The decomposition of the circles of some chunks into ordered slabs of ordered edges.

    ``piece`` numbers the chunks from 0. Slabs begin at boundary ordinates: of a chunk's 2m, in order, at
    every so many that about sqrt(2m) slabs arise.
    """

    def __init__(self, piece: np.ndarray, lat: np.ndarray, lon: np.ndarray, r_m: np.ndarray, pole: np.ndarray):
        rho = r_m / EARTH_M
        span = np.degrees(rho) * (1 + 1e-9) + _PAD
        of, y = np.concatenate([piece, piece]), np.concatenate([lat - span, lat + span])
        order = np.lexsort((y, of))
        of, y = of[order], y[order]
        start = np.searchsorted(of, of)
        step = np.maximum(1, np.sqrt(np.bincount(of)[of]).astype(np.int64))
        first = (np.arange(len(of)) - start) % step == 0
        self.slab_of, self.slab_y = of[first], y[first]
        self.slab_key = self.slab_of * 512.0 + self.slab_y
        a = self._slab(piece, lat - span - _PAD)
        a = np.where((a < 0) | (self.slab_of[a] != piece), a + 1, a)
        b = self._slab(piece, lat + span)
        many = b - a + 1
        edge = np.repeat(np.arange(len(piece)), many)
        slab = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many)
        low = self.slab_y[slab]
        high = np.append(self.slab_y, 512.0)[slab + 1]
        high = np.where(np.append(self.slab_of, -1)[slab + 1] == self.slab_of[slab], high, 90.0)
        low, high = np.clip(low - _PAD, -90, 90), np.clip(high + _PAD, -90, 90)
        # an arc is farthest from the centre where sin(lat) = sin(centre) / cos(radius)
        peak = np.degrees(np.arcsin(np.clip(np.sin(np.radians(lat)) / np.maximum(np.cos(rho), 1e-15), -1, 1)))[edge]
        outer = _half_width(np.clip(peak, low, high), lat[edge], rho[edge]) + _PAD
        inner = np.minimum(_half_width(low, lat[edge], rho[edge]), _half_width(high, lat[edge], rho[edge])) - _PAD
        outer, inner = np.where(pole[edge], 360.0, outer), np.where(pole[edge], -1.0, inner)
        lo = lon[edge] - outer
        order = np.lexsort((lo, slab))
        self.edge, self.lo, self.outer, self.inner = edge[order], lo[order], outer[order], inner[order]
        slab = slab[order]
        self.edge_key = slab * 2048.0 + self.lo
        self.widest = np.zeros(len(self.slab_y))
        np.maximum.at(self.widest, slab, 2 * self.outer)
        self.lat, self.lon, self.r_m = lat, lon, r_m

    def _slab(self, piece: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.slab_key, piece * 512.0 + y, "right") - 1

    def locate(self, piece: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the points and of the regions around them."""
        slab = self._slab(piece, lat)
        held = np.flatnonzero((slab >= 0) & (self.slab_of[slab] == piece))
        slab = slab[held]
        first = np.searchsorted(self.edge_key, slab * 2048.0 + lon[held] - self.widest[slab] - _PAD, "left")
        last = np.searchsorted(self.edge_key, slab * 2048.0 + lon[held] + _PAD, "right")
        many = np.maximum(last - first, 0)
        ends = np.cumsum(many)
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        start = 0
        while start < len(held):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + _PAIRS_AT_ONCE, "right")))
            n = many[start:stop]
            i = np.repeat(held[start:stop], n)
            j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:stop], n)
            off = np.abs(lon[i] - self.lon[self.edge[j]])
            near = off <= self.outer[j]
            i, j, off = i[near], j[near], off[near]
            e = self.edge[j]
            good = off < self.inner[j]
            rest = np.flatnonzero(~good)
            good[rest] = great_circle_m(lat[i[rest]], lon[i[rest]], self.lat[e[rest]], self.lon[e[rest]]) <= self.r_m[e[rest]]
            out.append((i[good], e[good]))
            start = stop
        return tuple(np.concatenate(x) for x in zip(*out))


def _search(points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    if not len(points) or not len(edges):
        return pd.DataFrame({"point": pd.Series(dtype=object), "region": pd.Series(dtype=object)})
    known, of = np.unique(edges["piece"].to_numpy(), return_inverse=True)
    at = np.minimum(np.searchsorted(known, points["piece"].to_numpy()), len(known) - 1)
    points = points[known[at] == points["piece"].to_numpy()]
    at = np.searchsorted(known, points["piece"].to_numpy())
    t = Trapezoids(of, *(edges[c].to_numpy() for c in ("rlat", "rlon", "r_m", "pole")))
    i, e = t.locate(at, points["lat"].to_numpy(), points["lon"].to_numpy())
    return pd.DataFrame({"point": points["key"].to_numpy()[i], "region": edges["rkey"].to_numpy()[e]})


def locate(points: DataFrame, regions: DataFrame, block: int = 20_000) -> DataFrame:
    """``(point, region)``: each point (``key, lat, lon``) in each region (``key, lat, lon, r_m``) around it.

    Locations must be valid (see ``valid_location``) and ``r_m`` not null. Repeated keys are kept as
    they are; an empty side gives no rows. A chunk of more than ``block`` points or edges is split into
    blocks of both, and pieces are dealt out to tasks of about that size.
    """
    by = ["cls", "row", "chunk"]
    cls = F.greatest(F.ceil(F.log2(F.greatest("r_m", F.lit(1.0)))), F.lit(0)).cast("int")
    regions = regions.withColumn("cls", cls)
    classes = [r[0] for r in regions.select("cls").distinct().collect()]  # powers of two of a radius on the sphere: 26 at most
    if not classes:
        return points.select(F.col("key").alias("point"), F.col("key").cast(regions.schema["key"].dataType).alias("region")).limit(0)
    edges = _chunks(regions)
    points = points.select("key", "lat", "lon", F.explode(F.array(*map(F.lit, classes))).alias("cls"))
    row, chunk = _grid(F.col("cls"), F.col("lat"), F.col("lon"))
    points = points.withColumns({"row": row, "chunk": chunk})
    blocks = lambda df, n: df.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    filled = cut(blocks(points, "p").join(blocks(edges, "e"), by))  # chunks that hold both
    pieces = filled.agg(F.sum(F.col("p") * F.col("e"))).first()[0] or 1
    least = filled.sparkSession.sparkContext.defaultParallelism
    # a piece is at most a block by a block; small ones share a task
    weight = points.join(filled, by, "left_semi").count() // block
    tasks = int(max(min(pieces, least), min(pieces, weight * 2)))
    own = lambda *c, n: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    points = points.join(filled, by).withColumns({"i": own("key", "lat", "lon", n="p"), "j": every("e")})
    edges = edges.join(filled, by).withColumns({"j": own("rkey", "rlat", "rlon", n="e"), "i": every("p")})
    piece = F.xxhash64(*by, "i", "j")
    task = F.pmod(F.col("piece"), F.lit(tasks)).cast("int")
    points = points.withColumn("piece", piece).select("key", "lat", "lon", "piece", task.alias("task"))
    edges = edges.withColumn("piece", piece).select("rkey", "rlat", "rlon", "r_m", "pole", "piece", task.alias("task"))
    kinds = points.schema["key"].dataType.simpleString(), regions.schema["key"].dataType.simpleString()
    return points.groupBy("task").cogroup(edges.groupBy("task")).applyInPandas(_search, f"point {kinds[0]}, region {kinds[1]}")


def near_and_inside(wells: DataFrame, towns: DataFrame, near_m: float = 400.0) -> DataFrame:
    """``(key_a, key_b)``: pairs of wells at most ``near_m`` apart, smaller key first, and wells in towns' circles.

    Wells: ``api_no, latitude, longitude``; towns: ``town_id, latitude, longitude, radius_km``. Wells
    without a key or a valid location, and towns with a null, count as absent; repeated rows count once.
    """
    w = wells.where(F.col("api_no").isNotNull() & valid_location(F.col("latitude"), F.col("longitude"))).select(
        F.col("api_no").alias("key"), F.col("latitude").cast("double").alias("lat"), F.col("longitude").cast("double").alias("lon")
    ).distinct()
    w = cut(w)
    t = towns.where(F.col("town_id").isNotNull() & valid_location(F.col("latitude"), F.col("longitude")) & (F.col("radius_km") >= 0)).select(
        F.col("town_id").alias("key"),
        F.col("latitude").cast("double").alias("lat"),
        F.col("longitude").cast("double").alias("lon"),
        (F.col("radius_km") * 1000.0).alias("r_m"),
    ).distinct()
    close = locate(w, w.withColumn("r_m", F.lit(float(near_m)))).where("point < region")
    inside = locate(w, t)
    return close.unionByName(inside).select(F.col("point").alias("key_a"), F.col("region").alias("key_b")).distinct()

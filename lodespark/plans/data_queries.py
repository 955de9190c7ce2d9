"""Queries of the general data problems (1, 2, 3, 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators.near_regions import near_and_inside
from lodespark.operators.packed_values import unpack_values
from lodespark.operators.regular_grid import regular_grid
from lodespark.operators.unit_harmony import harmonise_volumes, stated_volumes, unit_model_quality
from lodespark.session import table


def p1_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Every amount with its barrels, or its way to review."""
    return harmonise_volumes(table(spark, d, "well_treatments"), table(spark, d, "raw_well_data"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The amounts whose unit the row states, in barrels."""
    return stated_volumes(table(spark, d, "well_treatments"), table(spark, d, "raw_well_data"))


def p1_quality(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy, coverage and calibration of the classifier on hidden units."""
    return unit_model_quality(table(spark, d, "well_treatments"), table(spark, d, "raw_well_data"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack_values(table(spark, d, "raw_well_data"), "id", "top_bottom_stimulation_stages")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_and_inside(table(spark, d, "clean_well_data"), table(spark, d, "towns"))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return regular_grid(table(spark, d, "ticker_daily"), "ticker_code", "datetime", "close")


def p5_grid(spark: SparkSession, d: str) -> DataFrame:
    """The regular series of every ticker."""
    g = _grid(spark, d).withColumn("value", F.round("value", 6))
    return g.withColumns({c: F.col(c).cast("string") for c in ("day", "prev_day", "next_day")})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    grid = _grid(spark, d)
    return grid.where("status <> 'observed'").select(F.col("source").alias("ticker_code"), F.date_format("day", "yyyy-MM-dd").alias("missing_day"))


QUERIES = {"p1_found": p1_found, "p1_volumes": p1_volumes, "p1_quality": p1_quality, "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p5_grid": p5_grid}

_USABLE = "ticker_code is not null and datetime is not null and close > 0 and isfinite(close)"
_DIST = "2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(b.latitude - a.latitude) / 2), 2) + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2))))"
_PLACED = "latitude between -90 and 90 and longitude between -180 and 180 and not (latitude = 0 and longitude = 0)"

ORACLES = {
    "p3_found": f"""
        with w as (select distinct api_no, latitude, longitude from clean_well_data where api_no is not null and {_PLACED})
        select distinct a.api_no as key_a, b.api_no as key_b from w a join w b on a.api_no < b.api_no and {_DIST} <= 400
        union
        select a.api_no, b.town_id from w a join towns b on {_DIST} <= b.radius_km * 1000""",
    "p5_grid": f"""
        with u as (select ticker_code as s, datetime as t, cast(datetime as date) as d, max(close) as v from ticker_daily where {_USABLE} group by all),
        dl as (select s, d, arg_min(v, t) as v0, min(t) as t0, arg_max(v, t) as v1, max(t) as t1 from u group by all),
        g as (select s, unnest(generate_series(min(d), max(d), interval 1 day))::date as d from dl group by s),
        a as (select g.s, g.d, l.d as pd, l.v1, l.t1 from g asof join dl l on g.s = l.s and g.d >= l.d),
        b as (select a.*, n.d as nd, n.v0, n.t0 from a asof join dl n on a.s = n.s and a.d <= n.d)
        select s as source, d::varchar as day, pd::varchar as prev_day, nd::varchar as next_day,
        case when pd = d then 'observed' when nd - pd <= 7 then 'interpolated' else 'missing' end as status,
        round(case when pd = d then v1 when nd - pd <= 7 then v1 + (v0 - v1) * ((epoch(d::timestamp) + 43200 - epoch(t1)) / (epoch(t0) - epoch(t1))) end, 6) as value from b""",
    "p5_found": f"""
        with u as (select ticker_code, cast(datetime as date) as d from ticker_daily where {_USABLE} group by all),
        s as (select ticker_code, unnest(generate_series(min(d), max(d), interval 1 day))::date as d from u group by ticker_code)
        select s.ticker_code, strftime(s.d, '%Y-%m-%d') as missing_day from s anti join u on s.ticker_code = u.ticker_code and s.d = u.d""",
}

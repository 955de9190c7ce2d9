"""Problem 5: irregular readings of many sources brought onto a regular daily grid.

As-of merge of the grid with the sorted readings of each source: a grid point takes the reading
before it and the reading after it and, where the gap between the two is short enough, gets the
time-weighted linear value between them. The grid is never joined: after a map-side aggregate to one
row per (source, day) every present day knows its right neighbour through ``lead`` and unfolds only
the absent days up to it. A window partition therefore holds days, not readings: a source with a
third of all readings is as small as its calendar span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable_reading(value: Column) -> Column:
    """Not null, finite and above zero."""
    return value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < F.lit(float("inf")))


def regular_grid(df: DataFrame, source: str, ts: str, value: str, max_gap_days: int = 7) -> DataFrame:
    """Regular daily series per source: ``(source, day, status, value, prev_day, next_day)``.

    Status ``observed``: the day has a usable reading, the value is its last one. ``interpolated``:
    the day is absent and its neighbours are at most ``max_gap_days`` days apart; the value at noon is
    weighted by time between the last reading before and the first after. ``missing``: a longer gap,
    the value is null. The series runs from the first to the last usable day, so no end is
    extrapolated. Readings with a null source or time, or an unusable value, count as absent; repeats
    change nothing; of several readings at one instant the largest value counts. An empty input or a
    source without usable readings has no rows. Other columns of ``df`` are not read.
    """
    readings = df.select(
        F.col(source).alias("source"),
        F.col(ts).cast("timestamp_ntz").alias("ts"),
        F.col(value).cast("double").alias("v"),
    ).where(F.col("source").isNotNull() & F.col("ts").isNotNull() & usable_reading(F.col("v")))
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    daily = readings.groupBy("source", F.to_date("ts").alias("day")).agg(
        F.min(F.struct("ts", (-F.col("v")).alias("neg"))).alias("first"), F.max(F.struct("ts", "v")).alias("last")
    )
    daily = daily.select(
        "source",
        "day",
        F.col("first.ts").alias("first_ts"),
        (-F.col("first.neg")).alias("first_v"),
        F.col("last.ts").alias("last_ts"),
        F.col("last.v").alias("last_v"),
    )
    order = Window.partitionBy("source").orderBy("day")
    held = daily.select(
        "source",
        "day",
        "last_ts",
        "last_v",
        F.lead("day").over(order).alias("next_day"),
        F.lead("first_ts").over(order).alias("next_ts"),
        F.lead("first_v").over(order).alias("next_v"),
    )
    unfolded = held.select("*", F.explode(F.sequence("day", F.coalesce(F.date_sub("next_day", 1), "day"))).alias("grid_day"))
    noon = seconds(F.col("grid_day").cast("timestamp_ntz")) + 43200
    left, right = seconds(F.col("last_ts")), seconds(F.col("next_ts"))
    weighted = F.col("last_v") + (F.col("next_v") - F.col("last_v")) * F.try_divide(noon - left, right - left)
    observed = F.col("grid_day") == F.col("day")
    short = F.datediff("next_day", "day") <= max_gap_days
    return unfolded.select(
        "source",
        F.col("grid_day").alias("day"),
        F.when(observed, "observed").when(short, "interpolated").otherwise("missing").alias("status"),
        F.when(observed, F.col("last_v")).when(short, weighted).alias("value"),
        F.col("day").alias("prev_day"),
        F.when(observed, F.col("day")).otherwise(F.col("next_day")).alias("next_day"),
    )

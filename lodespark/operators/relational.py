"""Relational steps: lookups with defaults, anti and semi joins, shares, contingency, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A lookup side is broadcast only below this many rows (checked by a count of at most one row more).
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows; beyond, the optimizer chooses."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, features: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left lookup: the feature columns named in ``defaults``, with their default where key or value is missing.

    ``features`` should have one row per key; a null key never matches and so gets the defaults. Feature
    columns replace columns of the same name.
    """
    right = features.select(F.col(key), *[F.col(c).alias(f"_r_{c}") for c in defaults])
    kept = [c for c in df.columns if c not in defaults]
    joined = df.select(*kept).join(right, key, "left")
    return joined.select(*kept, *[F.coalesce(F.col(f"_r_{c}"), F.lit(v)).alias(c) for c, v in defaults.items()])


def unseen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``known``; rows with a null key count as unseen."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once (nulls are equal), by a semi join with the counted keys."""
    many = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return df.join(many, on, "left_semi")


def value_share(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count and percentage of each value, within ``by``; null is a value. Aggregated before the window."""
    counts = df.groupBy(*(by or []), value).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 6))


def top_values(df: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; ties by value."""
    return df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Contingency of two columns in long form."""
    return df.groupBy(row, column).agg(F.count("*").alias("n"))


def contained(baskets: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(basket, candidate)``: candidates ``(candidate, item)`` whose every item is in the basket ``(basket, item)``.

    Relational division by counting; empty candidates are in no basket.
    """
    size = candidates.distinct().groupBy("candidate").agg(F.count("*").alias("_size"))
    hits = baskets.distinct().join(candidates.distinct(), "item").groupBy("basket", "candidate").agg(F.count("*").alias("_hits"))
    return hits.join(size, "candidate").where("_hits = _size").select("basket", "candidate")


def label_universe(df: DataFrame, universe: DataFrame, label: str, measure: str) -> DataFrame:
    """``df`` on the full universe of labels, 0 where it has none."""
    return universe.select(label).distinct().join(df.select(label, measure), label, "left").withColumn(measure, F.coalesce(measure, F.lit(0)))


def category(value: Column, rules: list[tuple[str, str]], other: str = "Other") -> Column:
    """First matching pattern's category, else ``other``; null is ``other``."""
    out = F.lit(other)
    for pattern, name in reversed(rules):
        out = F.when(value.rlike(pattern), name).otherwise(out)
    return out


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with the same keys."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)

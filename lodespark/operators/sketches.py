"""Sketches over batches of a stream as set-based plans: Bloom false positives, distinct estimates, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodespark.functions.numbers import trailing_zeros

#: Bits of the filter, range of the distinct estimate, and the (a, b) of the hash families.
BLOOM_BITS, FM_RANGE = 69_997, 10_000_000
BLOOM_HASHES = [(31 + 977 * i * i + 17 * i, 101 + 7919 * i) for i in range(15)]
FM_HASHES = [(65_537 + 2 * i * 7_919 + i * i, 12_345 + 6_151 * i) for i in range(50)]


def hashed(c: Column, hashes: list[tuple[int, int]], m: int) -> Column:
    """Array of ``(a x + b) mod m`` of a non-negative integer; x is reduced first, so nothing overflows."""
    x = c % m
    return F.array(*[(x * a + b) % m for a, b in hashes])


def bloom_false_positives(df: DataFrame, batch: str, value: str) -> DataFrame:
    """``(batch, new, false_positives, rate)``: occurrences of unseen values whose bits were all set in earlier batches.

    A batch is looked up before it is inserted, so a bit counts from the batch after its first; that
    first batch per bit and per value is all the state, and needs no order of rows. Rate 0 without new values.
    """
    v = df.select(F.col(batch).alias("b"), F.col(value).alias("v")).where("b is not null and v is not null")
    first = v.groupBy("v").agg(F.min("b").alias("first"))
    bits = first.select("v", "first", F.explode(hashed(F.col("v"), BLOOM_HASHES, BLOOM_BITS)).alias("bit"))
    set_at = bits.groupBy("bit").agg(F.min("first").alias("set_at"))
    known = bits.join(set_at, "bit").groupBy("v").agg(F.max("set_at").alias("all_set"))
    new = v.groupBy("b", "v").agg(F.count("*").alias("n")).join(first, "v").where("b = first").join(known, "v")
    per = new.groupBy("b").agg(F.sum("n").alias("new"), F.sum(F.when(F.col("all_set") < F.col("b"), F.col("n")).otherwise(0)).alias("false_positives"))
    all_batches = v.select("b").distinct().join(per, "b", "left").na.fill(0, ["new", "false_positives"])
    rate = F.coalesce(F.try_divide("false_positives", "new"), F.lit(0.0))
    return all_batches.select(F.col("b").alias("batch"), "new", "false_positives", F.round(rate, 6).alias("rate"))


def distinct_estimate(df: DataFrame, batch: str, value: str, groups: int = 5) -> DataFrame:
    """``(batch, truth, estimate)``: Flajolet-Martin; the median over groups of the mean of 2^R, cut to an integer."""
    v = df.select(F.col(batch).alias("b"), F.col(value).alias("v")).where("b is not null and v is not null")
    h = v.select("b", F.posexplode(hashed(F.col("v"), FM_HASHES, FM_RANGE)).alias("i", "h"))
    longest = h.groupBy("b", "i").agg(F.max(trailing_zeros(F.col("h"))).alias("r"))
    size = len(FM_HASHES) // groups
    means = longest.groupBy("b", F.floor(F.col("i") / size).alias("g")).agg(F.avg(F.pow(F.lit(2.0), F.col("r"))).alias("m"))
    middle = means.groupBy("b").agg(F.get(F.array_sort(F.collect_list("m")), F.lit(groups // 2)).alias("m"))
    truth = v.groupBy("b").agg(F.count_distinct("v").alias("truth"))
    return truth.join(middle, "b").select(F.col("b").alias("batch"), "truth", F.floor("m").cast("bigint").alias("estimate"))


def reservoir(df: DataFrame, key: str, size: int = 100, seed: int = 7) -> DataFrame:
    """A uniform sample of ``min(n, size)`` rows: those of lowest keyed hash, as one distributed top-k.

    Same distribution as replacing slots one by one, but without an order of rows and mergeable. Rows
    with a null key are left out; a repeated key is one candidate per row.
    """
    draw = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    return df.where(F.col(key).isNotNull()).withColumn("draw", draw).orderBy("draw", key).limit(size)

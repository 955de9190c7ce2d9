"""Structured Streaming: event-time windows, and sketches kept as keyed state across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodespark.operators.sketches import BLOOM_BITS, BLOOM_HASHES
from lodespark.session import scratch


def file_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Stream over the Parquet files of a folder whose name fits ``pattern``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def in_order(df: DataFrame, by: str, files: int) -> str:
    """``df`` as a folder of ``files`` Parquet parts, written one after another in ranges of ``by``; its path."""
    spark = df.sparkSession
    path = scratch(spark, "incoming")
    low, high = df.agg(F.min(by), F.max(by)).first()
    for i in range(files if low is not None else 0):
        cut = [low + (high + 1 - low) * k // files for k in (i, i + 1)]
        df.where((F.col(by) >= cut[0]) & (F.col(by) < cut[1])).coalesce(1).write.mode("append").parquet(path)
    return path


def drain(df: DataFrame) -> DataFrame:
    """Run a stream over all that is available into Parquet files of the shared folder, in append mode, and return them."""
    spark = df.sparkSession
    path = scratch(spark, "drained")
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "stream")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def window_counts(events: DataFrame, ts: str, by: str, width: str, late: str = "1 hour") -> DataFrame:
    """Counts per event-time window and key, given out once the newest time is ``late`` past the window's end.

    Rows that come later than that are dropped and the state of closed windows with them. ``ts`` must be a
    timestamp with zone; rows with a null time are left out.
    """
    w = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), by, "n")


def session_counts(events: DataFrame, ts: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Events per session of a key, which ends after ``gap`` without one and is given out when ``late`` has passed as well."""
    w = events.where(F.col(ts).isNotNull()).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), by, "n")


def bloom_stream(values: DataFrame, value: str, shards: int = 1) -> DataFrame:
    """Per micro-batch ``(shard, seq, seen, maybe_known)``: values looked up in the filter, then inserted.

    The filter is state of bounded size per shard (bits packed); values are sharded by a hash, so the
    filter can be spread over tasks without changing what it answers per shard. Nulls are left out.
    """
    v = values.select(F.col(value).cast("bigint").alias("v")).where("v is not null").withColumn("shard", F.pmod("v", F.lit(shards)).cast("int"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, packed = state.get if state.exists else (0, bytes((BLOOM_BITS + 7) // 8))
        bits = np.unpackbits(np.frombuffer(packed, np.uint8))
        x = np.concatenate([b["v"].to_numpy() for b in batches])
        at = np.stack([(x % BLOOM_BITS * a + b) % BLOOM_BITS for a, b in BLOOM_HASHES], axis=1)
        known = int(bits[at].all(axis=1).sum())
        bits[at] = 1
        state.update((seq + 1, np.packbits(bits).tobytes()))
        yield pd.DataFrame({"shard": [key[0]], "seq": [seq], "seen": [len(x)], "maybe_known": [known]})

    return v.groupBy("shard").applyInPandasWithState(
        step, "shard int, seq int, seen bigint, maybe_known bigint", "seq int, bits binary", "append", GroupStateTimeout.NoTimeout
    )


def reservoir_stream(values: DataFrame, value: str, size: int = 100, seed: int = 7, shards: int = 8) -> DataFrame:
    """Per micro-batch and shard ``(shard, n, value, draw)``: a uniform sample of ``size`` of all values so far.

    A value's draw is a hash of seed and value; the smallest draws are the sample, so shards are filled
    apart from each other and merged by ``merged_reservoir``, and a batch run again gives the same. The
    state of a shard is its sample and a count. Nulls are left out; a repeated value counts once.
    """
    v = values.select(F.col(value).cast("string").alias("value")).where("value is not null")
    v = v.withColumn("draw", F.md5(F.concat_ws("/", F.lit(str(seed)), "value"))).withColumn("shard", F.pmod(F.xxhash64("draw"), F.lit(shards)).cast("int"))

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held, draws = state.get if state.exists else (0, [], [])
        best = pd.DataFrame({"value": pd.Series(list(held), dtype=object), "draw": pd.Series(list(draws), dtype=object)})
        for b in batches:
            n += len(b)
            best = pd.concat([best, b[["value", "draw"]]]).drop_duplicates().sort_values(["draw", "value"]).head(size)
        state.update((n, best["value"].tolist(), best["draw"].tolist()))
        yield best.assign(shard=key[0], n=n)[["shard", "n", "value", "draw"]]

    return v.groupBy("shard").applyInPandasWithState(
        step, "shard int, n bigint, value string, draw string", "n bigint, held array<string>, draws array<string>", "append", GroupStateTimeout.NoTimeout
    )


def merged_reservoir(drained: DataFrame, size: int = 100) -> DataFrame:
    """``(value, draw)``: the sample of all shards at their latest."""
    latest = drained.groupBy("shard").agg(F.max("n").alias("n"))
    return drained.join(latest, ["shard", "n"], "left_semi").select("value", "draw").distinct().orderBy("draw", "value").limit(size)


def refresh_once(incoming: DataFrame, target: str, key: str) -> None:
    """Append the rows of each micro-batch whose key the Parquet folder ``target`` does not hold yet, then stop.

    For a poll every few minutes run it with ``processingTime`` instead; each batch is an anti join.
    """

    def add(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates([key])
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(target)
            fresh = fresh.join(known.select(key), key, "left_anti")
        except Exception as e:  # the first batch: no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(target)

    incoming.writeStream.foreachBatch(add).trigger(availableNow=True).start().awaitTermination()

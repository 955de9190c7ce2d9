"""Writers: sorted CSV, reports, GeoJSON, keyed upserts into Parquet, models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.operators.relational import upsert


def predictions_csv(df: DataFrame, path: str, digits: int | None = 6) -> None:
    """``user_id, business_id, prediction`` sorted by pair, as a folder of CSV parts in order."""
    value = F.format_string(f"%.{digits}f", "prediction") if digits is not None else F.col("prediction")
    df.select("user_id", "business_id", value.alias("prediction")).orderBy("user_id", "business_id").write.mode("overwrite").option("header", True).csv(path)


def pairs_csv(df: DataFrame, path: str, digits: int | None = None) -> None:
    """Pairs with their similarity, sorted by pair; with ``digits`` decimals, or in full."""
    a, b, value = df.columns[:3]
    shown = F.format_string(f"%.{digits}f", value) if digits is not None else F.col(value)
    df.select(a, b, shown.alias(value)).orderBy(a, b).write.mode("overwrite").option("header", True).csv(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file at ``path`` of any file system that Spark reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def text_lines(df: DataFrame, column: str, path: str, by: str | None = None) -> None:
    """One text per line, partitioned by a column if given."""
    w = (df.select(column, by) if by else df.select(column)).write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def feature_collection(df: DataFrame, key: str, lat: str, lon: str, properties: list[str]) -> DataFrame:
    """A GeoJSON feature per located row, as text; null properties are N/A."""
    props = F.struct(F.col(key), *[F.coalesce(F.col(p).cast("string"), F.lit("N/A")).alias(p) for p in properties])
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    f = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), props.alias("properties")))
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(key), f.alias("feature"))


def upsert_parquet(changes: DataFrame, path: str, keys: list[str], staging: str) -> None:
    """Replace or add rows of a keyed Parquet table by way of a staging folder, so that it never reads what it overwrites."""
    spark = changes.sparkSession
    repeated = changes.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        raise ValueError(f"the keys {keys} are not unique in the changes")
    upsert(spark.read.parquet(path), changes, keys).write.mode("overwrite").parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Append the rows whose key the table lacks, one per key."""
    known = df.sparkSession.read.parquet(path).select(key)
    df.dropDuplicates([key]).join(known, key, "left_anti").write.mode("append").parquet(path)

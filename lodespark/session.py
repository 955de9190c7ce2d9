"""Session helpers shared by every operator: table access and lineage cuts."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir`` of the session.

    Where it is unset a temporary one stands in on one machine; on a cluster that is an error, since no
    other machine would see it.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="lodespark-")
        context.setCheckpointDir(folder)
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage. The files outlive a lost executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have shuffle and checkpoint files that nothing refers to any more deleted now; else they stay until the
    driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def slots(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the number of pieces to aim for in own splits."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has slots, for work per row that costs far
    more than moving the row; left alone where the scan already gives enough."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once per context, as a zip of its sources."""
    context = spark.sparkContext
    if getattr(context, "_lodespark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodespark-"), "lodespark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("lodespark", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._lodespark_shipped = True

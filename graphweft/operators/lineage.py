"""Cutting the lineage of iterative operators in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Where spark.checkpoint.dir says.

    Only a local session without that setting (a test) gets a folder of its own; on a cluster, where executors
    wouldn't see each other's files there, a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="graphweft-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def scratch_path(spark: SparkSession, label: str = "graph") -> str:
    """A new folder in the shared folder; it goes with the driver's JVM."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(frame: DataFrame) -> DataFrame:
    """The frame, written once as a table in the shared folder and read back.

    Unlike a checkpoint, the last stage runs once, and the planner knows the table's size.
    """
    spark = frame.sparkSession
    path = scratch_path(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def counted(frame: DataFrame, **sums: Column) -> tuple[DataFrame, dict]:
    """The frame, cut, and the named aggregates of its rows, counted while it is written."""
    seen = Observation()
    level = cut(frame.observe(seen, *[c.alias(name) for name, c in sums.items()]))
    return level, seen.get

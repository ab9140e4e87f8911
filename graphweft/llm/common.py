"""Shared helpers: input tables, cut lineage, learning folds and bounded labelled samples."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def once_per_worker(key: tuple, make: Callable):
    """make() of the first call with this key in a Python worker, which serves many tasks.

    Of each kind (the first part of the key) only the last is kept, so that a worker that outlives
    many queries holds one automaton and one vocabulary.
    """
    kept = sys.modules.setdefault("_graphweft_worker", types.ModuleType("_graphweft_worker")).__dict__
    if kept.get(key[0], (None,))[0] != key:
        kept.pop(key[0], None)
        kept[key[0]] = key, make()
    return kept[key[0]][1]


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: str = "4m") -> None:
    """Whole texts cross to Python in batches of about this size, unless the session names its own.

    A batch exists up to four times (in and out of Python, on both sides) for each task of an executor.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, most)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, a function for mapInArrow, that gives back at its end the memory it no longer needs.

    An idle worker otherwise holds what its allocators kept, beside the executor's next stage.
    """

    def tidied(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
        if trim:
            trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    A local session without that setting (a test) gets a temporary folder of its own. On a cluster
    executors wouldn't see each other's files there, so that a missing setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="graphweft-")
    context.setCheckpointDir(own)
    return own


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder; it goes with `discard`, or when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/graphweft/{label}-{uuid.uuid4().hex}"
    hadoop, system = _file_system(spark, path)
    system.deleteOnExit(hadoop)
    _scratch.append(path)
    return path


def scratch_mark() -> int:
    """Names the scratch folders made so far."""
    return len(_scratch)


def discard(spark: SparkSession, since: int, keep: str | None = None) -> None:
    """Delete the scratch folders made since a mark, but for `keep`: for who has written what was read from them."""
    for path in _scratch[since:]:
        if path != keep:
            hadoop, system = _file_system(spark, path)
            system.delete(hadoop, True)
    _scratch[since:] = [path for path in _scratch[since:] if path == keep]


def materialise(spark: SparkSession, frame: DataFrame, label: str) -> DataFrame:
    """Write the frame as a table in the shared folder and read it back: lineage ends there."""
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def materialise_last(spark: SparkSession, frame: DataFrame, label: str, since: int) -> DataFrame:
    """materialise, after which the scratch folders made since a mark are no longer needed and go."""
    done = materialise(spark, frame, label)
    discard(spark, since, keep=_scratch[-1])
    return done


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for the rows that no model may learn from; a null id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(True))


def bounded_labels(labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """(doc_id, label): the learnable rows, thinned by a hash of the id to about `most` rows.

    One count decides the share that is kept, so that the sample can be broadcast whatever the
    size of the table. A document that is labelled more than once counts once, with the largest.
    """
    rows = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isNotNull() & ~held_out(F.col("doc_id"), folds, fold))
    )
    n = rows.count()
    if n > most:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def distinct_text_sample(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, label): of sampled documents with equal texts only the first, so that copies weigh once."""
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    return (
        own.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
        .agg(F.min("doc_id").alias("doc_id"), F.max("label").alias("label"))
        .drop("h")
    )

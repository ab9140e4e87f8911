"""Incremental refresh: a stream of file changes, debounced, merged batch by batch into a table.

The table is a folder: a base, which holds the files as of some batch, and a delta for each later batch that
changed anything; a file's state is its row in the latest of them. Rows lie in buckets of a file's hash, so that a
batch reads the buckets that it touches. `compact` makes a new base, from which on older deltas aren't read. A batch
that is run again after a failure overwrites its own delta.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGE = "file string, fingerprint string, deleted boolean, ts timestamp"
BUCKETS = 64


def changes(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The change records that arrive as JSON lines in a folder."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).json(folder)


def debounced(stream: DataFrame, quiet: str = "1500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """One row for each burst of changes of a file: its last state, and n, how many there were.

    A burst ends when the file was quiet for `quiet`. The watermark bounds the state: records later than `late`
    don't come through, and are what `reconcile` is for.
    """
    last = F.max_by(F.struct("fingerprint", F.coalesce("deleted", F.lit(False)).alias("deleted"), "ts"), "ts")
    bursts = stream.withWatermark("ts", late).groupBy("file", F.session_window("ts", quiet)).agg(last.alias("last"), F.count("*").alias("n"))
    return bursts.select("file", "last.fingerprint", "last.deleted", "last.ts", "n")


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _base_batch(spark: SparkSession, folder: str) -> int:
    """The batch up to which the newest whole base goes; -1 without one."""
    path, system = _path(spark, f"{folder}/base")
    if not system.exists(path):
        return -1
    whole = [s.getPath() for s in system.listStatus(path) if system.exists(_path(spark, f"{s.getPath().toString()}/_SUCCESS")[0])]
    return max((int(p.getName().partition("=")[2]) for p in whole), default=-1)


def _rows(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The rows that count: those of the newest base and of the deltas after it, with batch and bucket."""
    schema = CHANGE + ", batch bigint, bucket int"
    upto = _base_batch(spark, folder)
    found = spark.createDataFrame([], schema)
    if upto >= 0:
        found = found.unionByName(spark.read.schema(CHANGE + ", bucket int").parquet(f"{folder}/base/upto={upto}").withColumn("batch", F.lit(upto).cast("bigint")))
    path, system = _path(spark, f"{folder}/deltas")
    if system.exists(path):
        deltas = spark.read.schema(schema).parquet(f"{folder}/deltas").filter(F.col("batch") > upto)
        found = found.unionByName(deltas if before is None else deltas.filter(F.col("batch") < before))
    return found


def _latest(rows: DataFrame, *order: str) -> DataFrame:
    """The last row of each file; equal times are settled by the other columns, whatever the order of arrival."""
    own = F.struct(*order, "ts", "deleted", "fingerprint")
    return rows.groupBy("file").agg(F.max(own).alias("last")).select("file", "last.fingerprint", "last.deleted", "last.ts")


def _bucket():
    return F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("int")


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """(file, fingerprint, ts): the files that exist, as the table knows them."""
    return _latest(_rows(spark, folder), "batch").filter(~F.col("deleted")).drop("deleted")


def merge(batch: DataFrame, batch_id: int, folder: str) -> None:
    """Write the batch's real changes as its delta; equal fingerprints and unknown deleted files change nothing.

    Rows without a file are ignored, and a null `deleted` means that the file exists. Only the buckets of the
    batch's files are read: their numbers prune the table's partitions.
    """
    spark = batch.sparkSession
    own = batch.filter("file is not null").select("file", "fingerprint", F.coalesce("deleted", F.lit(False)).alias("deleted"), "ts")
    new = _latest(own).withColumn("bucket", _bucket())
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
    earlier = _rows(spark, folder, batch_id).filter(F.col("bucket").isin(touched)).join(new.select("bucket", "file"), ["bucket", "file"], "left_semi")
    old = _latest(earlier, "batch").select("file", F.col("fingerprint").alias("was"), F.col("deleted").alias("was_deleted"))
    joined = new.join(old, "file", "left").withColumn("gone", F.coalesce("was_deleted", F.lit(True)))
    same = (F.col("deleted") & F.col("gone")) | (~F.col("deleted") & ~F.col("gone") & F.col("was").eqNullSafe(F.col("fingerprint")))
    real = joined.filter(~same).select("file", "fingerprint", "deleted", "ts", "bucket")
    real.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/deltas/batch={batch_id}")


def compact(spark: SparkSession, folder: str) -> None:
    """Make a base of the files that exist now; later reads begin there. Deltas that it covers are deleted, older bases too.

    A base counts once it is whole. What a reader planned before may need the old files: run it between batches.
    """
    rows = _rows(spark, folder)
    last = rows.agg(F.max("batch").alias("last")).first()["last"]
    if last is None or last == _base_batch(spark, folder):
        return
    own = snapshot(spark, folder).select("file", "fingerprint", F.lit(False).alias("deleted"), "ts", _bucket().alias("bucket"))
    own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/base/upto={last}")
    for kind, keeps in (("base", lambda n: n >= last), ("deltas", lambda n: n > last)):
        path, system = _path(spark, f"{folder}/{kind}")
        for status in system.listStatus(path) if system.exists(path) else []:
            number = status.getPath().getName().partition("=")[2]
            if number.isdigit() and not keeps(int(number)):
                system.delete(status.getPath(), True)


def reconcile(listing: DataFrame, batch_id: int, folder: str) -> None:
    """Bring the table in line with a whole listing (file, fingerprint, ts): for when what changed isn't known, or came too late.

    Files that the listing doesn't name are deleted ones.
    """
    spark = listing.sparkSession
    now = listing.select("file", "fingerprint", F.lit(False).alias("deleted"), "ts")
    latest = now.agg(F.max("ts").alias("ts"))  # one row
    gone = snapshot(spark, folder).select("file").join(now, "file", "left_anti").crossJoin(F.broadcast(latest))
    merge(now.unionByName(gone.select("file", F.lit(None).cast("string").alias("fingerprint"), F.lit(True).alias("deleted"), "ts")), batch_id, folder)


def start(stream: DataFrame, folder: str, checkpoint: str, quiet: str | None = "1500 milliseconds", late: str = "10 minutes", **trigger) -> StreamingQuery:
    """Keep the table up to date from a stream of changes, debounced by `quiet` (None: as they come).

    Batches run one after another, so that changes that arrive meanwhile wait for the next, and resume at the checkpoint.
    """
    own = stream if quiet is None else debounced(stream, quiet, late).drop("n")
    writer = own.writeStream.foreachBatch(lambda batch, batch_id: merge(batch, batch_id, folder)).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()

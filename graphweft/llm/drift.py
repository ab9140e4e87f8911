"""A table written as files whose schemas drift, and the report on how they were rewritten."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphweft.llm import schema_rewrite
from graphweft.llm.common import materialise, shared_dir

FILES = 500
MISSING = {"nation_id": -1, "source": "none"}
SWAPPED, REVERSED, WITHOUT, NARROW = 1, 2, 4, 8  # bits of a version


def numbered(spark: SparkSession, rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `_r`, their number from 0 in the order of these columns.

    Ranges are sorted side by side; what is summed up in one place is a count for each range.
    """
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = ranges.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.col("_range").cast("bigint"), 33))
    ranges = materialise(spark, ranges, "sorted-ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("before"))
    return ranges.join(F.broadcast(before), "_range").withColumn("_r", F.col("before") + F.col("_at")).drop("_range", "_at", "before")


def version_of(file_no: Column) -> Column:
    version = F.crc32(F.concat(F.lit("42:"), file_no.cast("string")).cast("binary")) % 24
    return F.when(version > 15, 0).otherwise(version).cast("bigint")


def drifted_schema(target: T.StructType, version: int) -> list[tuple[T.StructField, str]]:
    """The columns of a version: what each is called and of which type, and the target's column that it holds."""
    first, *rest = target.fields
    fields = [first, *(reversed(rest) if version & REVERSED else rest)]
    if version & WITHOUT:
        fields = [f for f in fields if f.name not in MISSING]
    swap = {"name": "email", "email": "name"} if version & SWAPPED else {}
    narrow = {"balance": T.FloatType(), "nation_id": T.IntegerType()} if version & NARROW else {}
    return [(T.StructField(swap.get(f.name, f.name), narrow.get(f.name, f.dataType), True, f.metadata), f.name) for f in fields]


def target_of(clients: DataFrame) -> T.StructType:
    wide = [T.StructField(f.name, T.LongType() if f.name == "nation_id" else f.dataType) for f in clients.schema.fields]
    return schema_rewrite.with_ids(T.StructType(wide))


def write_files(spark: SparkSession, clients: DataFrame, folder: str, key: str, target: T.StructType) -> None:
    """The rows in order as files of equal length, a folder each, of which each has the schema of its version."""
    n = clients.count()
    order = [F.crc32(F.col("client_id").cast("string").cast("binary")).alias("_crc"), F.col("client_id").alias("_id"), F.xxhash64(*(f"`{c}`" for c in clients.columns)).alias("_tie")]
    rows = numbered(spark, clients.select(*order, F.struct(*(f"`{c}`" for c in clients.columns)).alias("_row")), ["_crc", "_id", "_tie"])
    placed = rows.select(F.floor(F.col("_r") / (1 + n // FILES)).alias(key), "_r", "_row").withColumn("_version", version_of(F.col(key)))
    path = f"{shared_dir(spark)}/graphweft/placed-{uuid.uuid4().hex}"
    placed.write.partitionBy("_version").parquet(path)
    for version in sorted(r["_version"] for r in spark.read.parquet(path).select("_version").distinct().collect()):  # 16 at most
        own = spark.read.schema(placed.schema).parquet(path).filter(F.col("_version") == version).repartition(key).sortWithinPartitions(key, "_r")
        columns = [F.col(f"_row.`{source}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f, source in drifted_schema(target, version)]
        own.select(*columns, key).write.mode("append").partitionBy(key).parquet(folder)


def _micros(column: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970, for timestamps without a zone whatever the session's zone is."""
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(column.cast("date")) * F.lit(86400).cast("bigint") + F.hour(column) * 3600 + F.minute(column) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), column) * 1_000_000).cast("bigint")
    return F.unix_micros(column)


def report(spark: SparkSession, clients: DataFrame) -> DataFrame:
    """(file_no, version, n_rows, n_nulls, ids_sha256, rows_sha256, start_columns, columns, path, rewritten) of every file of clients, after their rewrite.

    The files lie in a new folder under spark.checkpoint.dir and stay there. Rows with a null client_id come first; rows of equal ids are ordered
    by a hash of the row. Columns beyond those of the contract are kept, with ids from 11 on. No clients give no files and no rows.
    """
    target = target_of(clients)
    key = "file_no"
    while key in clients.columns:
        key += "_"
    folder = f"{shared_dir(spark)}/graphweft/drift-{uuid.uuid4().hex}"
    columns = "file_no bigint, version bigint, n_rows bigint, n_nulls bigint, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"
    if clients.isEmpty():
        return spark.createDataFrame([], columns)
    write_files(spark, clients, folder, key, target)
    before = schema_rewrite.rewrite(spark, folder, key, target, MISSING)
    after = schema_rewrite.footers(spark, folder).select(F.regexp_extract("path", f"/{key}=([^/]*)/[^/]*$", 1).alias(key), "path", "columns")
    texts = {f.name: F.col(f"`{f.name}`").cast("string") for f in target.fields}
    texts["updated_at"] = _micros(F.col("updated_at"), target["updated_at"].dataType).cast("string")
    texts["balance"] = F.floor(F.lit(1048576) * F.col("balance")).cast("bigint").cast("string")
    known = [F.coalesce(text, F.lit("?")) for text in texts.values()]
    parts = {"ids": (F.coalesce(texts["client_id"], F.lit("?")), ","), "rows": (F.concat_ws("|", *known), "\n")}
    found = schema_rewrite.digests(spark, folder, key, target, parts)
    start = before.select(key, F.col("path").alias("start_path"), F.col("columns").alias("start_columns"))
    found = found.join(start, key).join(after, key).withColumn("file_no", F.col(key).cast("bigint"))
    return found.withColumn("version", version_of(F.col("file_no"))).withColumn("rewritten", F.col("path") != F.col("start_path")).select(
        "file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten"
    )

"""Files of drifted schemas rewritten to one schema, matched by Parquet field ids.

The footers are read where the files are, by tasks; what comes back is a row for each distinct schema. For each of those
one projection is compiled that names the columns by their ids; the plans are united, shuffled by file, sorted by the
row's place in its file and written in one job, which replaces just the folders of these files. Files that have the schema
already aren't touched.

A table is a folder in which every data file has a folder of its own, `key=value`.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from graphweft.llm.common import materialise

FIELD_ID = "parquet.field.id"
MOST_PATHS = 10_000  # files of one projection, whose paths the driver holds


def with_ids(schema: T.StructType, first: int = 1) -> T.StructType:
    """The schema, all nullable, with Parquet field ids counted from `first`."""
    return T.StructType([T.StructField(f.name, f.dataType, True, {FIELD_ID: first + i}) for i, f in enumerate(schema.fields)])


def _spark_schema(arrow: pa.Schema) -> T.StructType:
    found = from_arrow_schema(arrow, prefer_timestamp_ntz=True)
    ids = [int((f.metadata or {}).get(b"PARQUET:field_id", b"-1")) for f in arrow]
    return T.StructType([T.StructField(f.name, f.dataType, True, {FIELD_ID: i} if i >= 0 else {}) for f, i in zip(found.fields, ids)])


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the data files; their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select("path", "length")


def footers(spark: SparkSession, folder: str) -> DataFrame:
    """(path, schema, columns, n_rows) of every data file: the schema of its footer as JSON, and its names in order.

    Tasks read the footers only. The folder's store must be one that pyarrow opens (local and shared folders, S3, HDFS, ...).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                system, inner = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
                with system.open_input_file(inner) as file:
                    footer = pq.ParquetFile(file)
                    rows.append((path, _spark_schema(footer.schema_arrow).json(), ",".join(footer.schema_arrow.names), footer.metadata.num_rows))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns[:3]), pa.array(columns[3], pa.int64())], names=["path", "schema", "columns", "n_rows"])

    return _listed(spark, folder).select("path").mapInArrow(scan, "path string, schema string, columns string, n_rows bigint")


def projection(start: T.StructType, target: T.StructType, missing: dict[str, object]) -> list[Column]:
    """The target's columns from those of `start` that have their ids; a column that no file column has gets its value in `missing`, else null."""
    by_id = {f.metadata.get(FIELD_ID): f for f in start.fields}
    columns = []
    for field in target.fields:
        own = by_id.get(field.metadata[FIELD_ID])
        value = F.col(f"`{own.name}`") if own else F.lit(missing.get(field.name))
        columns.append(value.cast(field.dataType).alias(field.name, metadata=field.metadata))
    return columns


def rewrite(spark: SparkSession, folder: str, key: str, target: T.StructType, missing: dict[str, object]) -> DataFrame:
    """Turn every file of the table into one of the target schema, in place; (key, path, columns, drifted) of what was found, from before.

    Rows keep their order and nulls stay null. Files of the target's schema, and files without rows, stay as they are. Two data files in one
    folder are an error, as they would become one. If the job fails before its end no file has changed; it can be run again at any time.
    At most MOST_PATHS paths of files are held by the driver at once: larger tables are rewritten in several jobs, by the hash of the path.
    """
    value = F.regexp_extract("path", f"/{key}=([^/]*)/[^/]*$", 1)
    before = footers(spark, folder).withColumn(key, value).withColumn("drifted", (F.col("schema") != target.json()) & (F.col("n_rows") > 0))
    before = materialise(spark, before, "footers")
    if not before.groupBy(key).count().filter("count > 1").isEmpty():
        raise ValueError(f"two data files share a folder {key}=...")
    parts = -(-before.filter("drifted").count() // MOST_PATHS)
    for part in range(parts):
        own = before.filter("drifted").filter(F.pmod(F.xxhash64("path"), F.lit(parts)) == part)
        plans = []
        for schema, paths in own.groupBy("schema").agg(F.collect_list("path")).collect():
            start = T.StructType.fromJson(json.loads(schema))
            place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
            plans.append(spark.read.schema(start).parquet(*paths).select(place.alias("_place"), F.struct(*projection(start, target, missing)).alias("_row")))
        if plans:
            one = reduce(DataFrame.union, plans).withColumn(key, F.regexp_extract("_place.path", f"/{key}=([^/]*)/[^/]*$", 1))
            one = one.repartition(key).sortWithinPartitions(key, "_place.row")
            columns = [F.col(f"_row.`{f.name}`").alias(f.name, metadata=f.metadata) for f in target.fields]
            one.select(*columns, key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)
    return before.select(key, "path", "columns", "drifted")


def digests(spark: SparkSession, folder: str, key: str, target: T.StructType, parts: dict[str, tuple[Column, str]]) -> DataFrame:
    """(key, n_rows, n_nulls and, for each of `parts`, the SHA-256 of its values in order of the rows) of every file.

    parts: by name, text columns made from the target's columns, and what the values of a file are joined by.
    A file's rows pass through one task one by one.
    """
    ends = [end for _, end in parts.values()]
    names = [key, "n_rows", "n_nulls", *(f"{name}_sha256" for name in parts)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, nulls, hashes = None, 0, 0, []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([n]), pa.array([nulls]), *(pa.array([h.hexdigest()]) for h in hashes)], names=names)
        for batch in batches:
            keys, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [c.to_pylist() for c in batch.columns[2:]]
            for i, own in enumerate(keys):
                if own != now:
                    if n:
                        yield done()
                    now, n, nulls, hashes = own, 0, 0, [hashlib.sha256() for _ in texts]
                for h, end, values in zip(hashes, ends, texts):
                    h.update((end * (n > 0) + values[i]).encode("utf-8", "surrogatepass"))
                n += 1
                nulls += counts[i]
        if n:
            yield done()

    read = spark.read.schema(T.StructType([*target.fields, T.StructField(key, T.StringType())])).parquet(folder)
    n_nulls = reduce(lambda a, b: a + b, [F.col(f"`{f.name}`").isNull().cast("int") for f in target.fields])
    rows = read.select(F.col(key), F.col("_metadata.row_index").alias("row"), n_nulls.alias("n_nulls"), *(c.alias(f"p{i}") for i, (c, _) in enumerate(parts.values())))
    rows = rows.repartition(key).sortWithinPartitions(key, "row").drop("row")
    return rows.mapInArrow(scan, f"`{key}` string, n_rows bigint, n_nulls bigint" + "".join(f", `{name}` string" for name in names[3:]))

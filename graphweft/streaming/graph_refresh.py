"""A graph that follows its files: symbols, references and resolved edges kept up to date batch by batch.

Five tables lie in a folder: nodes, refs and edges in buckets of their file, keys (what nodes are called) and asks (what
references ask for) in buckets of the key. A batch of changed files

- replaces the nodes and refs of these files, and with them their rows of keys and asks;
- looks which keys have other nodes now, and which references elsewhere ask for such a key;
- resolves these and the changed files' own references anew, against the nodes that have the keys they ask for.

So it reads the buckets that it touches, and no others. Every batch writes new versions of its buckets, and then, last, which
version of each bucket counts. A batch that failed on its way has changed nothing, and can be run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphweft.operators import resolver
from graphweft.operators.lineage import cut
from graphweft.streaming.refresh import _path

BUCKETS = 64
NODES = "id string, type string, label string, qname string, file_path string, language string"
REFS = "ref_id string, source_file string, from_id string, relation string, target string, extractor string"
_TABLES = {
    "nodes": NODES, "refs": REFS, "edges": REFS + ", rule int, to_id string, provenance string",
    "keys": "rule int, key string, id string, family string, file_path string", "asks": "ref_id string, source_file string, rule int, key string",
}
_BUCKETED = {"nodes": ["file_path"], "refs": ["source_file"], "edges": ["source_file"], "keys": ["rule", "key"], "asks": ["rule", "key"]}
_ABSENT = -1

Extract = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def _bucket(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


def _touched(frame: DataFrame, columns: list[str]) -> set[int]:
    """The numbers of the buckets of a frame's rows: BUCKETS at most."""
    return {r[0] for r in frame.select(_bucket(columns)).distinct().collect()}


def versions(spark: SparkSession, folder: str, before: int | None = None) -> dict[tuple[str, int], int]:
    """The batch that wrote each bucket of each table last, as of the newest whole batch (before a given one)."""
    path, system = _path(spark, f"{folder}/versions")
    found = [s.getPath() for s in system.listStatus(path)] if system.exists(path) else []
    whole = [int(p.getName().partition("=")[2]) for p in found if system.exists(_path(spark, f"{p.toString()}/_SUCCESS")[0])]
    newest = max((n for n in whole if before is None or n < before), default=None)
    if newest is None:
        return {}
    return {(r.name, r.bucket): r.version for r in spark.read.parquet(f"{folder}/versions/batch={newest}").collect()}  # BUCKETS rows a table at most


def _read(spark: SparkSession, folder: str, known: dict[tuple[str, int], int], name: str, buckets: set[int] | None = None) -> DataFrame:
    wanted = [(b, v) for (n, b), v in sorted(known.items()) if n == name and v != _ABSENT and (buckets is None or b in buckets)]
    if not wanted:
        return spark.createDataFrame([], _TABLES[name])
    return spark.read.schema(_TABLES[name]).parquet(*(f"{folder}/{name}/batch={v}/bucket={b}" for b, v in wanted))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of nodes, refs, edges, keys and asks, as of the newest batch; an edge whose to_id is null is a reference that is open."""
    return _read(spark, folder, versions(spark, folder), name)


def refresh(changed: DataFrame, batch_id: int, folder: str, extract: Extract) -> None:
    """Bring the tables in line with changed files (file, deleted); `extract` gives the nodes and refs of those that exist.

    Of a file that comes several times in a batch a deletion counts only if it is all that came: what exists now is what `extract` finds.
    Rows without a file are ignored. Unknown deleted files change nothing. No changes write no version.
    """
    spark = changed.sparkSession
    known = versions(spark, folder, batch_id)
    files = changed.filter("file is not null").groupBy("file").agg(F.min(F.coalesce("deleted", F.lit(False))).alias("deleted"))
    files = cut(files)
    if files.isEmpty():
        return
    nodes, refs = (cut(x.select(*(c.split()[0] for c in kind.split(", ")))) for x, kind in zip(extract(files.filter(~F.col("deleted")).select("file")), (NODES, REFS)))
    own = _touched(files, ["file"])
    gone = lambda frame, column: frame.join(files.select(F.col("file").alias(column)), column, "left_anti")
    of = lambda frame, column: frame.join(files.select(F.col("file").alias(column)), column, "left_semi")
    old_nodes, old_refs = _read(spark, folder, known, "nodes", own), _read(spark, folder, known, "refs", own)

    def differing(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
        return cut(both.groupBy(*old.columns).agg(F.sum("sign").alias("sign")).filter("sign <> 0").select("rule", "key").distinct())

    new_keys, new_asks = cut(resolver.node_keys(nodes)), cut(resolver.asked_keys(refs))
    other_keys = differing(resolver.node_keys(of(old_nodes, "file_path")), new_keys)
    other_asks = differing(resolver.asked_keys(of(old_refs, "source_file")), new_asks)
    key_buckets, ask_buckets = _touched(other_keys, ["rule", "key"]), _touched(other_asks, ["rule", "key"])

    asking = gone(_read(spark, folder, known, "asks", key_buckets), "source_file").join(other_keys, ["rule", "key"], "left_semi").select("ref_id", "source_file").distinct()
    asking = cut(asking)
    elsewhere = _touched(asking, ["source_file"])
    open_ = cut(refs.unionByName(_read(spark, folder, known, "refs", elsewhere).join(asking, ["ref_id", "source_file"], "left_semi")))
    asked = cut(resolver.asked_keys(open_).select("rule", "key").distinct())
    keys = gone(_read(spark, folder, known, "keys", _touched(asked, ["rule", "key"])), "file_path").unionByName(new_keys)
    answers = resolver.resolve_by_keys(open_, keys.join(asked, ["rule", "key"], "left_semi"))

    kept = gone(_read(spark, folder, known, "edges", own | elsewhere), "source_file").join(asking, ["ref_id", "source_file"], "left_anti")
    within = lambda frame, columns, buckets: frame.filter(_bucket(columns).isin(sorted(buckets)))
    after = {
        "nodes": (own, gone(old_nodes, "file_path").unionByName(nodes)),
        "refs": (own, gone(old_refs, "source_file").unionByName(refs)),
        "edges": (own | elsewhere, kept.unionByName(answers.select(kept.columns))),
        "keys": (key_buckets, gone(_read(spark, folder, known, "keys", key_buckets), "file_path").unionByName(within(new_keys, ["rule", "key"], key_buckets))),
        "asks": (ask_buckets, gone(_read(spark, folder, known, "asks", ask_buckets), "source_file").unionByName(within(new_asks, ["rule", "key"], ask_buckets))),
    }
    now = dict(known)
    for name, (buckets, frame) in after.items():
        if not buckets:
            continue
        target = f"{folder}/{name}/batch={batch_id}"
        frame.withColumn("bucket", _bucket(_BUCKETED[name])).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        path, system = _path(spark, target)
        there = {s.getPath().getName() for s in system.listStatus(path)}
        now |= {(name, b): batch_id if f"bucket={b}" in there else _ABSENT for b in buckets}
    rows = spark.createDataFrame([(n, b, v) for (n, b), v in now.items()], "name string, bucket int, version bigint")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/batch={batch_id}")


def start(stream: DataFrame, folder: str, checkpoint: str, extract: Extract, **trigger) -> StreamingQuery:
    """Keep the graph up to date from a stream of changed files (file, deleted), which `refresh.debounced` may have thinned."""
    own = stream.select("file", "deleted")
    writer = own.writeStream.foreachBatch(lambda batch, batch_id: refresh(batch, batch_id, folder, extract)).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()

"""A stored graph: nodes by id and edges by each of their ends, written once and read by every query.

Each table is dealt into ranges of its key and sorted by it, so that a filter on the key skips the files
and row groups that can't hold it. Edges are kept twice, by target for who asks for incoming ones and by
source for outgoing ones.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    incoming: DataFrame
    outgoing: DataFrame


_TABLES = {"nodes": "id", "incoming": "to_id", "outgoing": "from_id"}


def save(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "errorifexists", told: dict[str, Column] | None = None, names: Sequence[str] = tuple(_TABLES)) -> None:
    """Write the graph's tables, or those named, under path, side by side: each by itself leaves executors idle at its end.

    `told` gives the columns of an edge by those of `edges`, if these hold numbers and codes in place of ids and names: only numbers are moved then, and sorted with the key alone.
    """

    def write(name: str, key: str, frame: DataFrame) -> None:
        whole = told if told and frame is edges else {c: F.col(c) for c in frame.columns}
        dealt = frame.repartitionByRange(whole[key]).withColumn("_key", whole[key]).sortWithinPartitions("_key")
        dealt.select(*[(F.col("_key") if c == key else column).alias(c) for c, column in whole.items()]).write.mode(mode).parquet(f"{path}/{name}")

    with ThreadPoolExecutor(len(_TABLES)) as pool:
        done = [pool.submit(write, name, _TABLES[name], nodes if name == "nodes" else edges) for name in names]
        for one in done:
            one.result()


def load(spark: SparkSession, path: str) -> Graph:
    return Graph(*(spark.read.parquet(f"{path}/{name}") for name in _TABLES))

"""Inverted cells of vectors: the nearest rows for many queries, proven by the cells' radii instead of a full scan."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphweft.functions.scalars import cosine
from graphweft.operators.lineage import cut
from graphweft.operators.relational import top_per_group

MOST_FITTED = 200_000  # rows that the cells are fitted on, by a hash of the id; all rows are dealt into them
MOST_CELLS = 4096
MEMBERS, ASKED, AT_ONCE = 8192, 4096, 64  # rows and queries of a block: what one task holds of a cell, however full; AT_ONCE queries are compared at a time
_SLACK = 1e-5  # covers the rounding of similarities to six digits
_FAR = 2.0  # squared distance of unit vectors at a right angle: similarity 0


@dataclass(frozen=True)
class VectorIndex:
    """members (cell, block, id, unit), blocks (cell, blocks), and per cell its center and radius, MOST_CELLS rows at most."""

    members: DataFrame
    blocks: DataFrame
    centers: np.ndarray
    radii: np.ndarray


def units(vectors: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """(id, unit): vectors of `dim` finite numbers scaled to length 1; others, which are near nothing, drop out."""
    own = vectors.select(F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).filter((F.size("v") == dim) & F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    long = own.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).filter("norm > 0 and norm < double('Infinity')")
    return long.select("id", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def _nearest_cell(centers: np.ndarray):
    @F.pandas_udf("cell int, off double")
    def nearest(unit: pd.Series) -> pd.DataFrame:
        own = np.array(unit.tolist(), dtype=float).reshape(len(unit), -1)
        away = np.maximum((own**2).sum(1)[:, None] + (centers**2).sum(1)[None] - 2 * own @ centers.T, 0) if len(own) else np.zeros((0, len(centers)))
        cell = away.argmin(1)
        return pd.DataFrame({"cell": cell.astype("int32"), "off": np.sqrt(away[np.arange(len(own)), cell])})

    return nearest


def build(vectors: DataFrame, key: str, column: str, dim: int, cells: int | None = None, seed: int = 7) -> VectorIndex | None:
    """The index of the rows, written to the shared folder; None if no row can be near another.

    Cells are centers of k-means (by rows: by blocks it fails on fewer different rows than centers), by default the
    square root of the rows. They start from random rows: choosing them by k-means|| ends in clustering candidates on the driver, which grows with the
    square of the cells. Each cell keeps the distance of its
    farthest member. A cell's rows lie in blocks of about MEMBERS, so that a cell with a third of all rows is many tasks.
    """
    own = cut(units(vectors, key, column, dim))
    rows = own.count()
    if rows == 0:
        return None
    share = min(1.0, MOST_FITTED / rows)
    sample = own.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else own
    k = min(cells or int(rows**0.5) + 1, MOST_CELLS)
    model = KMeans(k=k, seed=seed, maxIter=8, featuresCol="features", solver="row", initMode="random").fit(sample.select(array_to_vector("unit").alias("features"))) if k > 1 else None
    centers = np.array(model.clusterCenters()) if model else np.zeros((1, dim))
    placed = cut(own.withColumn("at", _nearest_cell(centers)("unit")).select("id", "unit", "at.cell", "at.off"))
    sizes = placed.groupBy("cell").agg(F.max("off").alias("radius"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
    told = cut(sizes)
    radii = np.full(len(centers), -1.0)  # of cells without members
    for r in told.collect():  # a row a cell, MOST_CELLS at most
        radii[r["cell"]] = r["radius"]
    blocks = F.broadcast(told.select("cell", "blocks"))
    members = placed.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "id", "unit")
    return VectorIndex(cut(members.repartitionByRange("cell", "block").sortWithinPartitions("cell", "block")), told.select("cell", "blocks"), centers, radii)


def _probes(index: VectorIndex, done: int, width: int):
    centers, radii = index.centers, index.radii

    def probe(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), 1024):
                some = part.iloc[at : at + 1024]
                own = np.array(some["unit"].tolist(), dtype=float)
                away = np.sqrt(np.maximum(1 + (centers**2).sum(1)[None] - 2 * own @ centers.T, 0))
                least = np.where(radii[None] < 0, np.inf, np.maximum(away - radii[None], 0))
                order = np.lexsort((np.broadcast_to(away, least.shape), least), axis=1)[:, done : done + width]
                bound = np.sqrt(some["far"].to_numpy(float))[:, None] + 1e-7
                row, place = np.nonzero(np.take_along_axis(least, order, 1) <= bound)
                yield pd.DataFrame({"query_id": some["query_id"].to_numpy()[row], "cell": order[row, place].astype("int32"), "far": some["far"].to_numpy(float)[row]})

    return probe


def _best_of(k: int):
    def best(asked: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or members.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        members = members.sort_values("id", kind="stable")
        ids, rows = members["id"].to_numpy(), np.array(members["unit"].tolist(), dtype=float)
        out = []
        for at in range(0, len(asked), AT_ONCE):
            some = asked.iloc[at : at + AT_ONCE]
            near, queries = np.array(some["unit"].tolist(), dtype=float) @ rows.T, some["query_id"].to_numpy()
            least = 1 - some["far"].to_numpy(float) / 2
            many = (near >= least[:, None]).sum(1) > 4 * k
            if many.any() and len(ids) > k + 1:  # itself and k others, and what is rounded to the last one's similarity
                least[many] = np.maximum(least[many], np.partition(near[many], len(ids) - k - 1, axis=1)[:, len(ids) - k - 1] - _SLACK)
            row, place = np.nonzero(near >= least[:, None])
            similarity = np.round(near[row, place], 6)
            other = (similarity > 0) & (ids[place] != queries[row])
            row, place, similarity = row[other], place[other], similarity[other]
            order = np.lexsort((place, -similarity, row))  # ties by id
            row, place, similarity = row[order], place[order], similarity[order]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append(pd.DataFrame({"query_id": queries[row[first]], "id": ids[place[first]], "similarity": similarity[first]}))
        return pd.concat(out)

    return best


def nearest_many(index: VectorIndex, queries: DataFrame, k: int, first: int = 4) -> DataFrame:
    """(query_id, id, similarity): the k rows of similarity over 0 that are nearest to each query (query_id, unit), itself left out; exact.

    Each query looks into its `first` nearest cells, then into four times as many each round, but only into
    those that the triangle inequality doesn't rule out: a cell whose center is farther than its radius and
    the k-th row found so far. The rounds end when no query has a cell left, at most the logarithm of the cells. A cell's queries
    and rows meet in blocks, each of which gives k rows a query. Ties by id.
    """
    kind = index.members.schema["id"].dataType.simpleString()
    own = cut(queries.select("query_id", "unit").dropDuplicates(["query_id"]))
    spread = own.withColumn("lane", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(1 << 20)))
    found = own.sparkSession.createDataFrame([], f"query_id {kind}, id {kind}, similarity double")
    done, width = 0, first
    while done < len(index.centers):
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("similarity").alias("least")).filter(F.col("n") >= k)
        far = F.coalesce(2 - 2 * (F.col("least") - _SLACK), F.lit(_FAR))
        limits = own.join(kth, "query_id", "left").select("query_id", "unit", far.alias("far"))
        pairs = cut(limits.mapInPandas(_probes(index, done, width), f"query_id {kind}, cell int, far double"))
        if pairs.isEmpty():
            break
        lanes = pairs.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("lanes"))  # a row a cell
        sizes = lanes.join(index.blocks, "cell")
        asked = pairs.join(F.broadcast(sizes), "cell").join(spread, "query_id").withColumn("lane", F.pmod("lane", "lanes").cast("int"))
        asked = asked.select("cell", "lane", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query_id", "unit", "far")
        rows = index.members.join(F.broadcast(sizes.select("cell", "lanes")), "cell")
        rows = rows.select("cell", "block", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), "id", "unit")
        keys = ["cell", "lane", "block"]
        met = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(_best_of(k), f"query_id {kind}, id {kind}, similarity double")
        found = cut(top_per_group(found.unionByName(met), "query_id", [F.desc("similarity"), "id"], k).drop("rn"))
        done, width = done + width, width * 4
    return found


def recall(found: DataFrame, vectors: DataFrame, query_ids: list, k: int) -> float:
    """The share of the true nearest rows of some queries (a short list) that were found, by a full scan for these alone."""
    asked = F.broadcast(vectors.filter(F.col("id").isin(query_ids)).select(F.col("id").alias("query_id"), F.col("unit").alias("q")))
    every = vectors.join(asked, F.col("id") != F.col("query_id")).select("query_id", "id", F.round(cosine(F.col("unit"), F.col("q")), 6).alias("similarity")).filter("similarity > 0")
    true = top_per_group(every, "query_id", [F.desc("similarity"), "id"], k).select("query_id", "id")
    total = true.count()
    return 1.0 if total == 0 else true.join(found, ["query_id", "id"], "left_semi").count() / total

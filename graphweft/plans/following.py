"""The graph that follows its files, over parts as symbols and orders as references."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphweft.operators import lineage
from graphweft.plans.base import query
from graphweft.sources import testgraph as tg
from graphweft.streaming import graph_refresh


def _symbols(spark, d, edited: bool):
    """Parts by files of a brand; in edited trees some files have other symbols, and some are gone."""
    f, k = "p_partkey % 8", "p_partkey % 120 + if(p_partkey % 8 = 3, 7, 0)" if edited else "p_partkey % 120"
    own = tg.table(spark, d, "part").filter(f"{f} <> 5" if edited else "true")
    return own.selectExpr("concat('P', p_partkey) as id", "'Function' as type", f"concat('part', {k}) as label", f"concat(translate(p_brand, '#', ''), '.part', {k}) as qname", f"concat('src/', translate(p_brand, '#', ''), '/f', {f}, '.py') as file_path", "'python' as language")


def _calls(spark, d, edited: bool):
    f, k = "o_orderkey % 97", "(o_custkey + if(o_orderkey % 97 < 3, 1, 0)) % 150" if edited else "o_custkey % 150"
    return tg.table(spark, d, "orders").selectExpr("concat('o', o_orderkey) as ref_id", f"concat('src/Brand', {f} % 30, '/o', {f}, '.py') as source_file", "concat('O', o_orderkey) as from_id", "'CALLS' as relation", f"concat('part', {k}) as target", "if(o_orderkey % 5 = 4, 'php', 'python') as extractor")


@query(
    """with n as (select 'P' || p_partkey as id, 'part' || (p_partkey % 120 + case when p_partkey % 8 = 3 then 7 else 0 end) as label, 'src/' || replace(p_brand, '#', '') || '/' as folder from part where p_partkey % 8 <> 5),
    r as (select 'o' || o_orderkey as ref_id, 'src/Brand' || (o_orderkey % 97 % 30) || '/' as folder, 'part' || ((o_custkey + case when o_orderkey % 97 < 3 then 1 else 0 end) % 150) as target, o_orderkey % 5 = 4 as other from orders),
    m as (select ref_id, count(*) as k, min(id) as one, count(*) filter (n.folder = r.folder) as kf, min(id) filter (n.folder = r.folder) as near from r join n on label = target and not other group by 1)
    select ref_id, case when k = 1 then one when kf = 1 then near end as to_id from r left join m using (ref_id)""",
    graph=False,
)
def r4_refreshed_graph(spark, d):
    """Edges after two batches of changes on a graph that was built from the files as they were before."""
    folder = f"{lineage.shared_dir(spark)}/followed-{uuid.uuid4().hex}"
    edited = [False, False]

    def extract(files):
        nodes, calls = _symbols(spark, d, edited[0]), _calls(spark, d, edited[1])
        return tuple(x.join(files.select(F.col("file").alias(c)), c, "left_semi") for x, c in ((nodes, "file_path"), (calls, "source_file")))

    paths = [_symbols(spark, d, False).select(F.col("file_path").alias("file")), _calls(spark, d, False).select(F.col("source_file").alias("file"))]
    graph_refresh.refresh(paths[0].union(paths[1]).distinct().withColumn("deleted", F.lit(False)), 0, folder, extract)
    edited[0] = True
    symbols = paths[0].distinct().filter(F.col("file").rlike("/f[35][.]py$"))
    graph_refresh.refresh(symbols.withColumn("deleted", F.col("file").endswith("/f5.py")), 1, folder, extract)
    edited[1] = True
    calls = paths[1].distinct().filter(F.col("file").rlike("/o[012][.]py$"))
    graph_refresh.refresh(calls.withColumn("deleted", F.lit(False)), 2, folder, extract)
    return graph_refresh.table(spark, folder, "edges").select("ref_id", "to_id")

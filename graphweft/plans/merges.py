"""Queries that merge, promote, prune and carry forward."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphweft import model
from graphweft.operators import merge
from graphweft.plans.base import query
from graphweft.sources import testgraph as tg


@query(
    """, incoming as (select from_id, to_id, relation, 'LSP_VERIFIED' as provenance, 1 as seq from edges where relation = 'CALLS' and source_line % 2 = 0
    union all select from_id, to_id, relation, 'INFERRED', 1 from edges where relation = 'CALLS' and source_line % 2 = 1)
    select from_id, to_id, relation, arg_min(provenance, (case when provenance = 'LSP_VERIFIED' then 0 else 1 end, seq)) as provenance from
    (select from_id, to_id, relation, provenance, 0 as seq from edges where relation = 'CALLS' union all select * from incoming) group by 1, 2, 3"""
)
def m2_insert_or_promote(spark, d):
    old = tg.calls(spark, d)
    verified = F.when(F.col("source_line") % 2 == 0, model.VERIFIED).otherwise("INFERRED")
    keys = ["from_id", "to_id", "relation"]
    return merge.insert_or_promote(old.select(*keys, "provenance"), old.select(*keys, verified.alias("provenance")), keys)


@query("select from_id, to_id, 'LSP_VERIFIED' as provenance, case when provenance = 'LSP_VERIFIED' then null else provenance end as was from edges where relation = 'CALLS' and confidence < 1")
def m3_promotion_with_stash(spark, d):
    own = tg.calls(spark, d).filter("confidence < 1").select("from_id", "to_id", "provenance")
    once = merge.promote(own)
    return merge.promote(once)  # a second promotion keeps the first origin


@query("select from_id, to_id, provenance from edges where relation = 'CALLS' and confidence < 1")
def m5_restore_promoted(spark, d):
    own = tg.calls(spark, d).filter("confidence < 1").select("from_id", "to_id", "provenance")
    return merge.restore(merge.promote(own))


@query("select user_id, count(*) as n, min(event_id) as first_id from events join (select user_id, max(ts::date) as day from events group by 1) using (user_id) where ts::date = day group by 1", graph=False)
def m9_latest_collection(spark, d):
    e = tg.table(spark, d, "events").withColumn("day", F.to_date("ts"))
    kept = merge.latest_only(e, "user_id", "day")
    return kept.groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("select relation, count(*) as n from edges where from_id not in (select id from nodes where type = 'External') and to_id not in (select id from nodes where type = 'External') group by 1")
def m10_delete_cascade(spark, d):
    gone = tg.nodes(spark, d).filter("type = 'External'").select("id")
    return merge.without_nodes(tg.edges(spark, d), gone).groupBy("relation").agg(F.count("*").alias("n"))


@query(
    "select user_id, event_id, event_type from (select *, lag(event_type) over (partition by user_id order by ts, event_id) as before from events) where before is distinct from event_type",
    graph=False,
)
def r5_equal_fingerprints_dropped(spark, d):
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return tg.table(spark, d, "events").withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("event_type"))).select("user_id", "event_id", "event_type")


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 = 0) and o_custkey in (select c_custkey from customer where c_acctbal > 0)", graph=False)
def r6_carried_forward(spark, d):
    c = tg.table(spark, d, "customer").select(F.col("c_custkey").alias("file"), "c_acctbal")
    unresolved = tg.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("file"))
    return merge.carry_forward(unresolved, c.filter("file % 3 = 0").select("file"), c.filter("c_acctbal > 0").select("file")).select("o_orderkey")


@query("select c_custkey as file from customer where c_custkey not in (select o_custkey from orders where o_orderpriority like '1%')", graph=False)
def u8_salvageable(spark, d):
    changed = tg.table(spark, d, "orders").filter("o_orderpriority like '1%'").select(F.col("o_custkey").alias("file"))
    return tg.table(spark, d, "customer").select(F.col("c_custkey").alias("file")).join(changed, "file", "left_anti")


@query("select user_id, event_id from events e where not exists (select 1 from events f where f.user_id = e.user_id and f.event_type = e.event_type and f.event_type = 'click' and f.ts > e.ts)", graph=False)
def events_not_superseded(spark, d):
    e = tg.table(spark, d, "events")
    last = e.filter("event_type = 'click'").groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    return e.join(last, ["user_id", "event_type"], "left").filter("last is null or ts >= last").select("user_id", "event_id")

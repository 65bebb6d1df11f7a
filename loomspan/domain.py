"""Projections of the stored tables onto the canonical tables sources, sessions and ops.

``load`` reads the star schema: orders are sessions, line items the operations in
them, nations the sources. ``recorded_sessions`` reads the recorded sessions table
itself, one row per id in its latest state. All are plain projections, so filters
and column pruning reach the Parquet scans.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.runtime import table

US = 1_000_000


class Domain(NamedTuple):
    sources: DataFrame
    sessions: DataFrame
    ops: DataFrame


def micros(c: str):
    """Microseconds UTC of a zoneless timestamp column."""
    return F.unix_micros(F.col(c).cast("timestamp"))


def load(spark: SparkSession, d: str) -> Domain:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    lineitem, part = table(spark, d, "lineitem"), table(spark, d, "part")
    sources = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey"), F.col("n_name").alias("id"), F.col("r_name").alias("source_format")
    )
    i = F.col("o_orderkey") % 100
    start = micros("o_orderdate")
    sessions = (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(sources.select("n_nationkey", F.col("id").alias("source_id")), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("id"),
            "source_id",
            F.when(i > 0, F.col("o_orderkey") - i + F.floor(i / 3)).cast("bigint").alias("parent_session_id"),
            F.when(i > 0, "sub_agent").otherwise("root").alias("kind"),
            F.col("c_mktsegment").alias("agent_name"),
            F.col("o_orderpriority").alias("cwd"),
            F.when(F.col("o_orderstatus") == "F", "completed")
            .when(F.col("o_orderstatus") == "O", "running")
            .otherwise("failed")
            .alias("status"),
            start.alias("start_ts"),
            F.when(F.col("o_orderstatus") != "O", start + (F.col("o_orderkey") % 1000 + 1) * US).alias("end_ts"),
        )
    )
    failed, running = F.col("l_returnflag") == "R", F.col("l_returnflag") == "N"
    llm = F.col("l_linestatus") == "O"
    begun = micros("l_shipdate")
    ops = lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"]).select(
        F.col("l_orderkey").alias("session_id"),
        F.col("l_linenumber").cast("bigint").alias("turn_seq"),
        F.col("l_suppkey").alias("op_seq"),
        F.when(llm, "llm").otherwise("tool").alias("kind"),
        F.when(failed, "failed").when(running, "running").otherwise("completed").alias("status"),
        F.when(llm, F.col("p_brand")).alias("model"),
        F.when(llm, F.concat(F.lit("P"), F.col("p_size") % 5)).alias("provider"),
        F.when(~llm, F.col("p_type")).alias("tool"),
        F.when(~llm, F.when(F.col("p_size") % 2 == 0, "builtin").otherwise("mcp")).alias("namespace"),
        F.col("l_quantity").cast("bigint").alias("tokens_in"),
        (F.col("l_quantity") * 2).cast("bigint").alias("tokens_out"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("cost_usd"),
        begun.alias("start_ts"),
        F.when(~running, begun + F.col("l_linenumber").cast("bigint") * 1000 * US).alias("end_ts"),
    )
    return Domain(sources.drop("n_nationkey"), sessions, ops)


def recorded_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of each session; start_ts in microseconds, NULL if it is no time."""
    s = table(spark, d, "sessions").where("id <> ''")
    latest = s.groupBy("id").agg(F.max_by(F.struct(*[c for c in s.columns if c != "id"]), F.struct("ingested_at", "row_id")).alias("s"))
    t = F.col("start_ts")
    n = F.length(t.cast("string"))
    us = F.when(t <= 0, None).when(n == 16, t).when(n == 13, t * 1000).when(n == 10, t * US).when(n == 19, F.expr("start_ts div 1000"))
    return latest.select("id", "s.*").withColumn("start_ts", us)


#: The same projections for the SQL checks, as common table expressions.
SQL = """
sources_ as (select n_name as id, r_name as source_format from nation join region on n_regionkey = r_regionkey),
sessions_ as (
  select o_orderkey as id, n_name as source_id,
    case when o_orderkey % 100 > 0 then o_orderkey - o_orderkey % 100 + (o_orderkey % 100) // 3 end as parent_session_id,
    case when o_orderkey % 100 > 0 then 'sub_agent' else 'root' end as kind,
    c_mktsegment as agent_name, o_orderpriority as cwd,
    case o_orderstatus when 'F' then 'completed' when 'O' then 'running' else 'failed' end as status,
    epoch_us(o_orderdate) as start_ts,
    case when o_orderstatus <> 'O' then epoch_us(o_orderdate) + (o_orderkey % 1000 + 1) * 1000000 end as end_ts
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
ops_ as (
  select l_orderkey as session_id, cast(l_linenumber as bigint) as turn_seq, l_suppkey as op_seq,
    case when l_linestatus = 'O' then 'llm' else 'tool' end as kind,
    case l_returnflag when 'R' then 'failed' when 'N' then 'running' else 'completed' end as status,
    case when l_linestatus = 'O' then p_brand end as model,
    case when l_linestatus = 'O' then 'P' || (p_size % 5) end as provider,
    case when l_linestatus <> 'O' then p_type end as tool,
    case when l_linestatus <> 'O' then case when p_size % 2 = 0 then 'builtin' else 'mcp' end end as namespace,
    cast(l_quantity as bigint) as tokens_in, cast(l_quantity * 2 as bigint) as tokens_out,
    l_extendedprice * (1 - l_discount) as cost_usd, epoch_us(l_shipdate) as start_ts,
    case when l_returnflag <> 'N' then epoch_us(l_shipdate) + cast(l_linenumber as bigint) * 1000000000 end as end_ts
  from lineitem join part on l_partkey = p_partkey),
recorded_ as (
  select * replace (case when start_ts <= 0 then null when length(cast(start_ts as varchar)) = 16 then start_ts
      when length(cast(start_ts as varchar)) = 13 then start_ts * 1000 when length(cast(start_ts as varchar)) = 10 then start_ts * 1000000
      when length(cast(start_ts as varchar)) = 19 then start_ts // 1000 end as start_ts)
  from sessions where id <> '' qualify row_number() over (partition by id order by ingested_at desc, row_id desc) = 1)
"""

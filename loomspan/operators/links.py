"""Links between operations, sessions, payloads and logs that are found afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def child_sessions(ops: DataFrame, sessions: DataFrame) -> DataFrame:
    """ops with ``child_session_id``: as it is stored, else the session the operation names, else the one that names its call.

    ops: session_id, child_session_id, child_native_id, tool_use_id, ...; sessions: id, source_id, native_id, parent_session_id,
    parent_native_id, tool_use_id. A named child is looked for in the source of the operation's session; a call's child must
    also be a child of that session, by its stored parent or by the native id of it. Ties go to the smaller id.
    """
    parent = sessions.select(F.col("id").alias("_p"), F.col("source_id").alias("_ps"), F.col("native_id").alias("_pn"))
    o = ops.join(parent, ops["session_id"] == parent["_p"], "left")
    named = sessions.where("native_id <> ''").groupBy(F.col("source_id").alias("_cs"), F.col("native_id").alias("_cn")).agg(F.min("id").alias("_named"))
    o = o.join(named, (o["_ps"] == named["_cs"]) & (o["child_native_id"] == named["_cn"]) & (F.col("child_native_id") != ""), "left")
    # the two kinds of parentage are two equi-joins, not one with an OR
    calls = sessions.where("tool_use_id <> ''")
    by_id = calls.where("parent_session_id is not null").select("source_id", "tool_use_id", F.col("parent_session_id").alias("up"), "id")
    by_native = calls.where("parent_native_id <> ''").join(parent, (F.col("source_id") == F.col("_ps")) & (F.col("parent_native_id") == F.col("_pn"))).select("source_id", "tool_use_id", F.col("_p").alias("up"), "id")
    called = by_id.unionByName(by_native).where("id <> up").groupBy(F.col("source_id").alias("_ks"), F.col("tool_use_id").alias("_kt"), F.col("up").alias("_ku")).agg(F.min("id").alias("_called"))
    o = o.join(called, (o["_ps"] == called["_ks"]) & (o["tool_use_id"] == called["_kt"]) & (o["session_id"] == called["_ku"]), "left")
    return o.withColumn("child_session_id", F.coalesce("child_session_id", "_named", "_called")).select(*ops.columns)


def first_payloads(refs: DataFrame, op_key: list[str], order: list[str]) -> DataFrame:
    """The first payload of each operation, by partial aggregation."""
    rest = [c for c in refs.columns if c not in op_key]
    g = refs.groupBy(*op_key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*op_key, *[F.col("_r")[c].alias(c) for c in rest])


def log_id() -> Column:
    """A stable id of what makes a log entry: source, session, turn, operation, time, severity and message."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_id", "session", "turn_seq", "op_seq", "ts", "severity", "message")]
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 32)


def log_entries(ev: DataFrame) -> DataFrame:
    """id, source_id, session, turn_seq, op_seq, ts, severity, message, extras: each entry once."""
    rows = ev.where("kind = 'log_entry'").withColumn("id", log_id())
    return rows.select("id", "source_id", "session", "turn_seq", "op_seq", "ts", "severity", "message", "extras").dropDuplicates(["id"])


def log_page(logs: DataFrame, severities: tuple[str, ...], limit: int, after: tuple[int, str] | None = None) -> DataFrame:
    """One keyset page of log entries by time and id, and the row behind it; extras decoded as a map."""
    from loomspan.operators.filters import SEVERITIES, BadRequest

    if bad := [s for s in severities if s not in SEVERITIES]:
        raise BadRequest(f"severity {bad[0]}")
    if severities:
        logs = logs.where(F.col("severity").isin(*severities))
    logs = logs.where("ts is not null")
    if after is not None:
        logs = logs.where(F.struct("ts", "id") > F.struct(F.lit(after[0]).cast("bigint").alias("ts"), F.lit(after[1]).alias("id")))
    return logs.orderBy("ts", "id").limit(limit + 1).withColumn("extras", F.from_json("extras", "map<string,string>"))


def placed_logs(logs: DataFrame, sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """Logs with the source they belong to: their own, else that of their session; entries of no source are left out.

    logs: id, session_id, source_id, ...; sessions: id, source_id.
    """
    own = logs.where("source_id is not null")
    lent = logs.where("source_id is null").drop("source_id").join(sessions.select(F.col("id").alias("session_id"), "source_id"), "session_id")
    s = sources.select(F.col("id").alias("source_id"), "source_format")
    # two scoped joins instead of one over a coalesced key, so each is an equi-join on stored columns
    return own.select(*logs.columns).unionByName(lent.select(*logs.columns)).join(s, "source_id")


def recent_source_errors(logs: DataFrame, now_us: int, span_us: int = 3_600_000_000) -> DataFrame:
    """source_id, n: entries of severity ERR of a source itself, not of a session, in the last hour."""
    own = logs.where((F.col("source_id").isNotNull()) & F.col("session_id").isNull() & (F.col("severity") == "ERR"))
    return own.where((F.col("ts") > now_us - span_us) & (F.col("ts") <= now_us)).groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def in_order(rows: DataFrame, ids: list, key: str = "id") -> DataFrame:
    """The rows of the given ids in the order in which they were asked for; ``pos`` from 0."""
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    asked = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], f"_key {kind}, pos int")
    return rows.join(F.broadcast(asked), rows[key] == asked["_key"]).drop("_key").orderBy("pos")  # as many as were asked for


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows of each table, from one aggregate a table."""
    out = None
    for name, t in tables.items():
        c = t.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = c if out is None else out.unionByName(c)
    return out


def op_details(ops: DataFrame, sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """Operations with their session, its source, the number of operations in their turn, and the child session if there is one.

    ops: session_id, turn_seq, op_seq, kind, child_session_id.
    """
    turns = ops.groupBy(F.col("session_id").alias("_ts"), F.col("turn_seq").alias("_tt")).agg(F.count(F.lit(1)).alias("turn_ops"))
    s = sessions.select(F.col("id").alias("_s"), "source_id", "agent_name", F.col("kind").alias("session_kind"))
    child = sessions.select(F.col("id").alias("_c"), F.col("agent_name").alias("child_agent"))
    x = ops.join(turns, (ops["session_id"] == turns["_ts"]) & (ops["turn_seq"] == turns["_tt"])).join(s, ops["session_id"] == s["_s"])
    x = x.join(sources.select(F.col("id").alias("source_id"), "source_format"), "source_id").join(child, x["child_session_id"] == child["_c"], "left")
    return x.select("session_id", "turn_seq", "op_seq", "kind", "source_id", "source_format", "agent_name", "session_kind", "turn_ops", "child_session_id", "child_agent")

"""Totals, breakdowns, rankings and entity aggregates over sessions and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.filters import SessionFilter, apply


def money(c: Column | str) -> Column:
    """A sum of doubles that doesn't depend on the order of addition."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(38,6)")).cast("double")


def count_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))


def with_share(g: DataFrame, c: str, name: str) -> DataFrame:
    """Adds a group's part of the whole result, 0 where there is none. The total is a scalar subquery, not a window."""
    total = g.agg(F.sum(c)).scalar()
    return g.withColumn(name, F.when(total > 0, F.round(F.col(c) / total, 9)).otherwise(0.0))


def totals(sessions: DataFrame, ops: DataFrame, f: SessionFilter) -> DataFrame:
    """One row: sessions, operations, tokens, cost, failures and summed wall-clock time of closed sessions."""
    s = apply(sessions, f, ops)
    a = s.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.sum(F.when(F.col("end_ts") > F.col("start_ts"), F.col("end_ts") - F.col("start_ts"))), F.lit(0)).alias("span_us"),
    )
    b = ops.join(s.select(F.col("id").alias("session_id")), "session_id", "left_semi").agg(
        F.count(F.lit(1)).alias("ops"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.coalesce(money("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        count_if(F.col("status") == "failed").alias("failures"),
    )
    return b.select(a.select("sessions").scalar().alias("sessions"), a.select("span_us").scalar().alias("span_us"), "*")


def by_status(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("status").agg(F.count(F.lit(1)).alias("sessions")).orderBy(F.desc("sessions"), "status")


def by_source(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    src = sources.select(F.col("id").alias("source_id"), "source_format")
    return (
        sessions.join(src, "source_id", "left")
        .groupBy("source_id", F.coalesce("source_format", F.lit("")).alias("source_format"))
        .agg(F.count(F.lit(1)).alias("sessions"), count_if(F.col("status") == "failed").alias("failures"))
    )


def by_agent(sessions: DataFrame) -> DataFrame:
    g = sessions.groupBy(F.coalesce("agent_name", F.lit("")).alias("agent_name")).agg(
        F.count(F.lit(1)).alias("sessions"), count_if(F.col("status") == "failed").alias("failures")
    )
    return with_share(g, "sessions", "pct_of_sessions")


def by_model(ops: DataFrame, scope: DataFrame) -> DataFrame:
    """Model operations of the sessions in ``scope``; NULL and '' are one model."""
    g = (
        ops.where(F.col("kind") == "llm")
        .join(scope.select(F.col("id").alias("session_id")), "session_id", "left_semi")
        .groupBy(F.coalesce("model", F.lit("")).alias("model"), F.coalesce("provider", F.lit("")).alias("provider"))
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("tokens_in").alias("tokens_in"),
            F.sum("tokens_out").alias("tokens_out"),
            money("cost_usd").alias("cost_usd"),
            count_if(F.col("status") == "failed").alias("failures"),
        )
    )
    return with_share(g, "cost_usd", "pct_of_cost")


def by_tool(ops: DataFrame, scope: DataFrame) -> DataFrame:
    g = (
        ops.where(F.col("kind") == "tool")
        .join(scope.select(F.col("id").alias("session_id")), "session_id", "left_semi")
        .groupBy(F.coalesce("namespace", F.lit("")).alias("namespace"), F.coalesce("tool", F.lit("")).alias("tool"))
        .agg(F.count(F.lit(1)).alias("calls"), count_if(F.col("status") == "failed").alias("failures"))
    )
    return with_share(g, "calls", "pct_of_calls")


def by_error_class(sessions: DataFrame, most: int = 50) -> DataFrame:
    """The most frequent error classes of failed sessions (a report of the top ``most``)."""
    cls = F.coalesce(F.expr("nullif(error_class, '')"), F.lit("unknown"))
    return (
        sessions.where(F.col("status") == "failed")
        .groupBy(cls.alias("error_class"))
        .agg(F.count(F.lit(1)).alias("sessions"))
        .orderBy(F.desc("sessions"), "error_class")
        .limit(most)
    )


def turn_totals(ops: DataFrame) -> DataFrame:
    return ops.groupBy("session_id", "turn_seq").agg(
        F.count(F.lit(1)).alias("op_count"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        money("cost_usd").alias("cost_usd"),
        F.min("start_ts").alias("start_ts"),
        F.max("end_ts").alias("end_ts"),
        count_if(F.col("status") == "failed").alias("failures"),
    )


def session_totals(sessions: DataFrame, ops: DataFrame) -> DataFrame:
    """Session aggregates from turns, failures from operations, last activity as the greatest of all."""
    t = turn_totals(ops).groupBy(F.col("session_id").alias("id")).agg(
        F.count(F.lit(1)).alias("turn_count"),
        F.sum("op_count").alias("op_count"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("failures").alias("failure_count"),
        F.max("end_ts").alias("last_op"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sessions.join(t, "id", "left").select(
        "id", zero("turn_count"), zero("op_count"), zero("tokens_in"), zero("failure_count"),
        F.greatest("start_ts", "end_ts", "last_op").alias("last_activity_ts"),
    )


def _entry(kind: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("entry"), name.alias("name"))


def catalog(sessions: DataFrame, ops: DataFrame) -> DataFrame:
    """First and last sight and number of uses of agents, directories, models, providers and tools."""
    s = sessions.select(F.explode(F.array(_entry("agent", F.col("agent_name")), _entry("cwd", F.col("cwd")))).alias("e"), F.col("start_ts"))
    tool = F.concat_ws(".", "namespace", "tool")
    o = ops.select(
        F.explode(
            F.array(
                _entry("model", F.col("model")), _entry("provider", F.col("provider")), _entry("tool", F.when(F.col("kind") == "tool", tool))
            )
        ).alias("e"),
        F.col("start_ts"),
    )
    return (
        s.unionByName(o)
        .where("e.name <> ''")
        .groupBy("e.entry", "e.name")
        .agg(F.min("start_ts").alias("first_seen"), F.max("start_ts").alias("last_seen"), F.count(F.lit(1)).alias("uses"))
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def health(sources: DataFrame, errors: int = 1) -> DataFrame:
    """down if a source is off, degraded with parse errors, else ok; one row per status."""
    s = F.when(F.col("enabled") == 0, "down").when(F.col("parse_errors") >= errors, "degraded").otherwise("ok")
    return sources.groupBy(s.alias("health")).agg(F.count(F.lit(1)).alias("n_sources"), F.sum("parse_errors").alias("parse_errors"))


def cache_hit_rate(read: str, fresh: str, write: str) -> Column:
    """Cached part of all input tokens; NULL where there were none."""
    total = sum((F.coalesce(c, F.lit(0)) for c in (read, fresh, write)), F.lit(0))
    return F.when(total > 0, F.round(F.coalesce(read, F.lit(0)) / total, 9))


def source_list(sources: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every source with its sessions and last activity, also those without any."""
    a = sessions.groupBy("source_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("last_activity_ts").alias("last_activity_ts"))
    return sources.join(a, sources["id"] == a["source_id"], "left").select(
        "id", "source_format", "enabled", F.coalesce("sessions", F.lit(0)).alias("sessions"), "last_activity_ts"
    )


def lineage(sessions: DataFrame) -> DataFrame:
    """Each session with the kinds of its parent and root, NULL where they don't exist."""
    k = sessions.select(F.col("id").alias("_i"), "kind")
    p, r = k.toDF("_p", "parent_kind"), k.toDF("_r", "root_kind")
    s = sessions.select("id", "kind", "parent_session_id", "root_session_id")
    s = s.join(p, s["parent_session_id"] == p["_p"], "left")
    return s.join(r, s["root_session_id"] == r["_r"], "left").select("id", "kind", "parent_kind", "root_kind")

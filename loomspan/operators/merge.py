"""Event log to entity tables: upsert semantics as folds.

Every rule of a mutable table becomes an aggregate over the immutable log in
arrival order: last non-empty value, least start, first parent, overwriting
finalize. All are partial aggregates, so a session with a third of all events is
combined map-side, and replaying events changes nothing.

Defined results: events without a key are left out; NULL and '' mean no change;
repeated events fold to the same row; extra columns are ignored; an empty log
gives empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(name: str, path: str = "payload") -> Column:
    """A payload field; '' is NULL."""
    x = F.get_json_object(path, f"$.{name}")
    return F.when(x != "", x)


def number(name: str) -> Column:
    return F.get_json_object("payload", f"$.{name}").cast("bigint")


def last_set(value: Column | str, order: Column) -> Column:
    """The last non-null value in arrival order."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max_by(v, F.when(v.isNotNull(), order))


def first_set(value: Column | str, order: Column) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.min_by(v, F.when(v.isNotNull(), order))


SESSION_TEXTS = {"agent_name": "AgentName", "model": "Model", "cwd": "Cwd", "provider": "Provider", "provider_alias": "ProviderAlias", "call_path": "CallPath", "kind": "Kind"}


def session_events(events: DataFrame) -> DataFrame:
    """The session events with their fields as columns; ``ord`` is the arrival order."""
    return events.where(F.col("kind").isin("session_started", "session_updated", "session_finalized")).select(
        F.col("kind").alias("event_kind"),
        field("SourceID").alias("source_id"),
        F.coalesce(field("NativeID"), field("SessionNativeID")).alias("native_id"),
        F.col("event_id").alias("ord"),
        number("Ts").alias("ts"),
        *[field(p).alias(c) for c, p in SESSION_TEXTS.items()],
        field("ParentNativeID").alias("parent_native_id"),
        field("RootNativeID").alias("root_native_id"),
        field("Status").alias("status"),
        field("ErrorClass").alias("error_class"),
        field("ErrorMessage").alias("error_message"),
        number("EndTs").alias("end_ts"),
        F.get_json_object("payload", "$.Extras").alias("extras"),
        F.coalesce(F.get_json_object("payload", "$.Extras.synthetic") == "true", F.lit(False)).alias("synthetic"),
    ).where("native_id is not null")


def fold_sessions(ev: DataFrame) -> DataFrame:
    """One row per session: texts last non-empty, start least, parent first, finalize overwrites.

    A synthetic hint ranks below every real event. A session that is only
    updated or finalized is a stub: it has no start.
    """
    ord_ = F.struct(~F.col("synthetic"), F.col("ord"))
    started, final = F.col("event_kind") == "session_started", F.col("event_kind") == "session_finalized"
    return ev.groupBy("source_id", "native_id").agg(
        F.min(F.when(started, F.col("ts"))).alias("start_ts"),
        F.max("ts").alias("last_activity_ts"),
        *[last_set(c, ord_).alias(c) for c in SESSION_TEXTS],
        first_set("parent_native_id", F.col("ord")).alias("parent_native_id"),
        last_set("root_native_id", F.col("ord")).alias("root_native_id"),
        F.max_by(F.when(final, F.struct("status", "error_class", "error_message", "end_ts")), F.when(final, F.col("ord"))).alias("f"),
        (~F.bool_or(started)).alias("is_stub"),
        F.count(F.lit(1)).alias("n_events"),
    ).select(
        "source_id", "native_id", "parent_native_id", "root_native_id", "start_ts", "last_activity_ts", *SESSION_TEXTS,
        F.coalesce("f.status", F.lit("running")).alias("status"), F.col("f.error_class").alias("error_class"),
        F.col("f.end_ts").alias("end_ts"), "is_stub", "n_events",
    )


def session_id() -> Column:
    """A stable id of (source, native id)."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce("source_id", F.lit("")), "native_id"), 256), 1, 32)


def linked(sessions: DataFrame) -> DataFrame:
    """Adds id and the resolved parent and root ids; a link to an unknown session stays NULL."""
    s = sessions.withColumn("id", session_id())
    known = s.select(F.col("source_id").alias("_s"), F.col("native_id").alias("_n"), F.col("id").alias("_id"))
    for col in ("parent", "root"):
        k = known.select("_s", "_n", F.col("_id").alias(f"{col}_session_id"))
        s = s.join(k, (s["source_id"] == k["_s"]) & (s[f"{col}_native_id"] == k["_n"]), "left").drop("_s", "_n")
    return s


def merge_extras(ev: DataFrame) -> DataFrame:
    """Extras of each session as one map: keys patched in arrival order, a null value deletes its key."""
    kv = ev.where("extras is not null").select(
        "source_id", "native_id", "ord", F.explode(F.from_json("extras", "map<string,string>")).alias("k", "v")
    )
    last = kv.groupBy("source_id", "native_id", "k").agg(F.max_by(F.struct("v"), F.col("ord")).alias("x"))
    return last.where("x.v is not null").select("source_id", "native_id", F.col("k").alias("extra_key"), F.col("x.v").alias("extra_value"))


# ---- turns and operations of the wide event form (see sources.adapters) -------------------------------------
_ORD = ["file", "rec", "sub"]


def fold_turns(ev: DataFrame) -> DataFrame:
    """Start is the least, finalize overwrites as a whole; a turn only finalized has the finalize's time."""
    o = F.struct(*_ORD)
    fin = F.col("kind") == "turn_finalized"
    return (
        ev.where(F.col("kind").isin("turn_started", "turn_finalized"))
        .groupBy("source_id", "session", "turn_seq")
        .agg(
            F.coalesce(F.min(F.when(~fin, F.col("ts"))), F.min("ts")).alias("start_ts"),
            F.max_by(F.when(fin, F.struct("status", "error_class", "end_ts", "tokens_in", "tokens_out", "cost_usd")), F.when(fin, o)).alias("f"),
        )
        .select("source_id", "session", "turn_seq", "start_ts", F.coalesce("f.status", F.lit("running")).alias("status"), "f.error_class", "f.end_ts", "f.tokens_in", "f.tokens_out", "f.cost_usd")
    )


def fold_ops(ev: DataFrame) -> DataFrame:
    """Operations: names overwrite, optional texts last non-empty, links first, finalize overwrites.

    A finalize without a start makes no operation; an end before the start makes no duration.
    """
    o = F.struct(*_ORD)
    st, fin = F.col("kind") == "op_started", F.col("kind") == "op_finalized"
    at = lambda c: F.when(st, F.col(c))
    g = ev.where(st | fin).groupBy("source_id", "session", "turn_seq", "op_seq").agg(
        F.bool_or(st).alias("begun"),
        F.min(at("ts")).alias("start_ts"),
        F.max_by(at("op_kind"), F.when(st, o)).alias("op_kind"),
        F.max_by(at("name"), F.when(st, o)).alias("name"),
        *[last_set(F.when(F.col(c) != "", F.col(c)), o).alias(c) for c in ("namespace", "model", "provider")],
        *[first_set(F.when(F.col(c) != "", F.col(c)), o).alias(c) for c in ("child_session",)],
        first_set(F.when(F.col("parent_op_seq") >= 0, F.col("parent_op_seq")), o).alias("parent_op_seq"),
        F.max_by(
            F.when(fin, F.struct("status", "error_class", "error_message", "end_ts", "tokens_in", "tokens_out", "tokens_cache_read", "tokens_cache_write", "cost_usd", "ctx_used", "bytes_in", "bytes_out")),
            F.when(fin, o),
        ).alias("f"),
    )
    ok = (F.col("f.end_ts") > 0) & (F.col("start_ts") > 0) & (F.col("f.end_ts") >= F.col("start_ts"))
    return g.where("begun").select(
        "source_id", "session", "turn_seq", "op_seq", "parent_op_seq", "op_kind", "name", "namespace", "model", "provider", "child_session",
        "start_ts", F.when(ok, F.col("f.end_ts")).alias("end_ts"), F.when(ok, F.col("f.end_ts") - F.col("start_ts")).alias("duration_us"),
        F.coalesce("f.status", F.lit("running")).alias("status"), "f.error_class", "f.error_message",
        *[F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "tokens_cache_read", "tokens_cache_write")],
        F.coalesce("f.cost_usd", F.lit(0.0)).alias("cost_usd"), F.nullif(F.col("f.bytes_in"), F.lit(0)).alias("bytes_in"), F.nullif(F.col("f.bytes_out"), F.lit(0)).alias("bytes_out"), F.nullif(F.col("f.ctx_used"), F.lit(0)).alias("ctx_used"),
    )


def insert_ignore(rows: DataFrame, identity: Sequence[str]) -> DataFrame:
    """One row per identity; NULL and '' are equal."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_i{k}") for k, c in enumerate(identity)]
    return rows.select("*", *keys).dropDuplicates([f"_i{k}" for k in range(len(identity))]).drop(*[f"_i{k}" for k in range(len(identity))])


def payload_refs(ev: DataFrame) -> DataFrame:
    refs = ev.where("kind = 'payload_ref'").select("source_id", "session", "turn_seq", "op_seq", "payload_kind", "format", "location", "bytes_in", "sha256")
    return insert_ignore(refs, ["source_id", "session", "turn_seq", "op_seq", "payload_kind", "location"])


def orphan_refs(refs: DataFrame, ops: DataFrame) -> DataFrame:
    """Warnings for payloads of unknown operations."""
    lost = refs.join(ops.select("source_id", "session", "turn_seq", "op_seq"), ["source_id", "session", "turn_seq", "op_seq"], "left_anti")
    return lost.select("source_id", "session", F.lit("WRN").alias("severity"), F.concat(F.lit("payload of an unknown operation: "), F.coalesce("payload_kind", F.lit(""))).alias("message")).distinct()


def stubs(declared: DataFrame, referenced: DataFrame) -> DataFrame:
    """(source_id, session) that events refer to but none declares."""
    return referenced.select("source_id", "session").where("session <> ''").distinct().join(declared.select("source_id", F.col("native_id").alias("session")), ["source_id", "session"], "left_anti")


def wide_session_events(ev: DataFrame) -> DataFrame:
    """The session events of the wide form in the shape of ``session_events``; arrival order is (file, record, place in it)."""
    none = F.lit(None).cast("string")
    return ev.where(F.col("kind").isin("session_started", "session_updated", "session_finalized") & (F.col("session") != "")).select(
        F.col("kind").alias("event_kind"),
        "source_id",
        F.col("session").alias("native_id"),
        F.struct(*_ORD).alias("ord"),
        "ts",
        *[(F.col(w) if w else none).alias(c) for c, w in zip(SESSION_TEXTS, ("agent", "model", "cwd", "provider", None, "call_path", "session_kind"))],
        F.col("parent").alias("parent_native_id"),
        F.col("root").alias("root_native_id"),
        *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("status", "error_class", "error_message")],
        "end_ts",
        "extras",
        F.coalesce(F.get_json_object("extras", "$.synthetic") == "true", F.lit(False)).alias("synthetic"),
    )

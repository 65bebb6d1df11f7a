"""Rollout files as canonical events: (timestamp, type, payload) lines, and legacy ones of a session and its items.

Rules: task_started opens a turn and ends one that is still open as replaced;
task_complete ends it completed, turn_aborted failed with a class. Messages of
the user are inputs, those of the assistant model operations, calls are tools that end at the output
with their call id. A tool that nobody ended takes the end of its turn: completed, or cancelled where the turn failed.
Token counts are per call; their sum over a turn goes to its last model operation. A file without
any new line for an hour, whose turn is still open, is incomplete and failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.bad_rows import valid_rollouts, with_zone
from loomspan.operators.instants import first_reading
from loomspan.operators.windows import carry_last, numbered_turns, positions
from loomspan.runtime import stage
from loomspan.sources.adapters import as_events, register

STALE_US = 3_600_000_000
CALLS = ("function_call", "custom_tool_call", "local_shell_call", "tool_search_call")
OUTPUTS = ("function_call_output", "custom_tool_call_output")
# Signs of a failed call, classes of an aborted turn, names of tools by namespace.
DENIED = ("denied by sandbox", "operation not permitted", "sandbox deny")
FAILED = ('"error"', "exit code 1", "command failed")
ABORTED = {"interrupted": "user_interrupt", "replaced": "replaced", "review_ended": "review_ended", "budget_limited": "rate_limit"}
FILE_TOOLS = ("apply_patch", "read", "write", "edit", "list_dir", "view_image")


def namespace(ptype: Column, name: Column) -> Column:
    return (
        F.when(ptype.isin("custom_tool_call", "tool_search_call"), "custom")
        .when(ptype == "local_shell_call", "shell")
        .when(name.isin("shell", "shell_command") | name.startswith("exec"), "shell")
        .when(name.isin(*FILE_TOOLS), "fs")
        .otherwise("custom")
    )


def output_class(output: Column) -> Column:
    """The error class of a call's output, NULL if it went well."""
    low = F.lower(F.coalesce(output, F.lit("")))
    some = lambda signs: F.array_contains(F.array(*[F.contains(low, F.lit(s)) for s in signs]), True)
    return F.when(some(DENIED), "sandbox_denied").when(some(FAILED) | low.startswith("error:"), "tool_error")


def abort_class(reason: Column) -> Column:
    out = reason
    for k, v in ABORTED.items():
        out = F.when(reason == k, v).otherwise(out)
    return out


def read_lines(lines: DataFrame) -> DataFrame:
    """lines: file, line_no, raw_text and, if known, ts. The fields that events need; texts end here."""
    j = lambda p: F.get_json_object("raw_text", f"$.{p}")
    n = lambda p: F.coalesce(j(f"payload.info.{p}").cast("bigint"), F.lit(0))
    ts = F.col("ts") if "ts" in lines.columns else F.unix_micros(F.try_to_timestamp(j("timestamp")))
    used = "last_token_usage."
    source = F.col("source_id") if "source_id" in lines.columns else F.lit(None).cast("string")
    return lines.select(
        source.alias("source_id"), "file", "line_no", ts.alias("ts"), j("type").alias("type"), j("payload.type").alias("ptype"), j("payload.name").alias("name"), j("payload.call_id").alias("call_id"),
        j("payload.role").alias("role"), j("payload.reason").alias("reason"), output_class(j("payload.output")).alias("bad"),
        F.when(j("type") == "turn_context", j("payload.model")).alias("set_model"), F.when(j("type") == "session_meta", j("payload")).alias("meta"), j("payload.cwd").alias("cwd"),
        n(used + "input_tokens").alias("ti"), n(used + "cached_input_tokens").alias("tc"), n(used + "output_tokens").alias("to"), n(used + "cache_creation_input_tokens").alias("tw"),
        n("total_token_usage.total_tokens").alias("ctx"),
    )


def _kind() -> Column:
    message = F.col("ptype") == "message"
    return (
        F.when(message & (F.col("role") == "user"), "internal").when(message & (F.col("role") == "assistant"), "llm")
        .when(F.col("ptype") == "reasoning", "reasoning").when(F.col("ptype").isin(*CALLS), "tool")
    )


def turns_of(t: DataFrame) -> DataFrame:
    """file, turn_seq, start_ts, started, end_ts, status, error_class: a turn's own end, the next one's start, or none yet."""
    own = F.when(F.col("ptype").isin("task_complete", "turn_aborted"), F.struct("line_no", "ts", "ptype", "reason"))
    g = t.where("turn_seq > 0").groupBy("file", "turn_seq").agg(
        F.min("source_id").alias("source_id"), F.min_by("ts", "line_no").alias("start_ts"), F.min("line_no").alias("line_no"), F.max(F.coalesce(F.col("ptype") == "task_started", F.lit(False))).alias("started"),
        F.min(own).alias("own"), F.max("ts").alias("last_ts"),
    )
    nxt = g.select(F.col("file").alias("_f"), (F.col("turn_seq") - 1).alias("_n"), F.col("start_ts").alias("next_ts"), F.col("line_no").alias("next_line"))
    g = g.join(nxt, (g["file"] == nxt["_f"]) & (g["turn_seq"] == nxt["_n"]), "left")
    return g.select(
        "source_id", "file", "turn_seq", "start_ts", "line_no", "started", "last_ts",
        F.coalesce("own.ts", "next_ts").alias("end_ts"), F.coalesce("own.line_no", "next_line").alias("end_line"),
        F.when(F.col("own.ptype") == "task_complete", "completed").when(F.col("own").isNotNull() | F.col("next_line").isNotNull(), "failed").otherwise("running").alias("status"),
        F.when(F.col("own.ptype") == "turn_aborted", abort_class(F.col("own.reason"))).when(F.col("own").isNull() & F.col("next_line").isNotNull(), "replaced").alias("error_class"),
    )


def _parts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with turn and model, operations with their turn's fate)."""
    base = read_lines(lines)
    t = numbered_turns(base.withColumn("p", F.coalesce(F.col("ptype") == "task_started", F.lit(False))), ["file"], ["line_no"], "p")
    t = stage(carry_last(t, ["file"], ["line_no"], "set_model", "model", include_row=True))
    ops = t.where(F.col("type") == "response_item").withColumn("op_kind", _kind()).where("op_kind is not null")
    ops = positions(ops.drop("meta"), ["file", "turn_seq"], ["line_no"], "op_seq")
    out = t.where(F.col("ptype").isin(*OUTPUTS)).groupBy(F.col("file").alias("_f"), F.col("call_id").alias("_c")).agg(
        F.min("ts").alias("out_ts"), F.min("line_no").alias("out_line"), F.min_by(F.struct("bad"), "line_no")["bad"].alias("out_bad")
    )
    zero = lambda c: F.greatest(c, F.lit(0))
    cached = zero(F.col("tc"))
    use = t.where("ptype = 'token_count'").groupBy(F.col("file").alias("_uf"), F.col("turn_seq").alias("_ut")).agg(
        F.sum(zero(F.col("ti") - cached)).alias("ti_"), F.sum(cached).alias("tc_"), F.sum(zero(F.col("to"))).alias("to_"), F.sum(zero(F.col("tw"))).alias("tw_"),
        F.max_by("ctx", F.when(F.col("ctx") > 0, F.col("line_no"))).alias("ctx_"),
    )
    last = ops.where("op_kind = 'llm'").groupBy(F.col("file").alias("_lf"), F.col("turn_seq").alias("_lt")).agg(F.max("op_seq").alias("_lo"))
    fate = turns_of(t).select(F.col("file").alias("_tf"), F.col("turn_seq").alias("_tt"), F.col("end_ts").alias("turn_end"), F.col("end_line").alias("turn_line"), F.col("status").alias("turn_status"))
    x = ops.join(out, (ops["file"] == out["_f"]) & (ops["call_id"] == out["_c"]) & (ops["op_kind"] == "tool"), "left")
    x = x.join(last, (x["file"] == last["_lf"]) & (x["turn_seq"] == last["_lt"]) & (x["op_seq"] == last["_lo"]), "left")
    x = x.join(use, (x["_lf"] == use["_uf"]) & (x["_lt"] == use["_ut"]), "left")
    x = x.join(fate, (x["file"] == fate["_tf"]) & (x["turn_seq"] == fate["_tt"]), "left")
    tool, open_ = F.col("op_kind") == "tool", F.col("out_line").isNull()
    n = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return t, x.select(
        "source_id", "file", "line_no", "turn_seq", "op_seq", "op_kind",
        F.when(tool, F.coalesce(F.expr("nullif(name, '')"), F.when(F.col("ptype") == "local_shell_call", "shell").when(F.col("ptype") == "tool_search_call", "tool_search"))).otherwise(F.col("name")).alias("name"),
        F.when(tool, namespace(F.col("ptype"), F.coalesce("name", F.lit("")))).alias("namespace"), F.when(F.col("op_kind") == "llm", F.col("model")).alias("model"), F.col("ts").alias("start_ts"),
        F.when(~tool, F.col("ts")).when(open_, F.col("turn_end")).otherwise(F.col("out_ts")).alias("end_ts"), F.coalesce("out_line", F.when(tool, F.col("turn_line")), "line_no").alias("end_line"),
        F.when(~tool, "completed").when(~open_, F.when(F.col("out_bad").isNotNull(), "failed").otherwise("completed"))
        .when(F.col("turn_status") == "completed", "completed").when(F.col("turn_status") == "failed", "cancelled").otherwise("running").alias("status"),
        F.when(tool & ~open_, F.col("out_bad")).alias("error_class"),
        n("ti_", "tokens_in"), n("to_", "tokens_out"), n("tc_", "tokens_cache_read"), n("tw_", "tokens_cache_write"), n("ctx_", "ctx_used"),
    )


def rollout_ops(lines: DataFrame) -> DataFrame:
    """Operations of rollout lines; lines: file, line_no, raw_text."""
    return _parts(lines)[1]


def rollout_sessions(t: DataFrame) -> DataFrame:
    """One row per file: its session, from the first session_meta line."""
    j = lambda p: F.get_json_object("meta", f"$.{p}")
    g = t.groupBy("file").agg(
        F.min("source_id").alias("source_id"), F.min("ts").alias("ts"), F.min("line_no").alias("line_no"), F.min_by("meta", F.when(F.col("meta").isNotNull(), F.col("line_no"))).alias("meta"), F.max("ts").alias("last_ts"),
        F.min_by("set_model", F.when(F.col("set_model").isNotNull(), F.col("line_no"))).alias("model"),
    )
    sub = j("source.subagent").isNotNull()
    void = lambda x: F.nullif(x, F.lit(""))
    up = F.coalesce(F.get_json_object("meta", "$.source.subagent.thread_spawn.parent_thread_id"), void(j("parent_thread_id")))
    x = g.select(
        "*", F.coalesce(void(j("id")), "file").alias("session"), void(j("cwd")).alias("cwd"),
        F.when(sub, up).when(void(j("forked_from_id")).isNotNull(), j("forked_from_id")).when(j("thread_source") == "subagent", up).alias("parent"),
        F.when(sub, "sub_agent").when(void(j("forked_from_id")).isNotNull(), "fork").when(j("source").contains("internal"), "internal")
        .when(j("thread_source") == "subagent", "sub_agent").when(j("thread_source") == "memory_consolidation", "internal").otherwise("root").alias("session_kind"),
        F.coalesce(void(j("agent_nickname")), void(j("agent_role")), F.concat_ws(":", F.lit("codex"), void(j("originator")))).alias("agent"),
    )
    return x.withColumn("root", F.coalesce("parent", "session"))


@register("codex")
def rollouts(raw: DataFrame, sources: DataFrame, now_us: int | None = None) -> DataFrame:
    """raw: source_id, file, line_no, raw_text. ``now_us`` tells which files are stale; without it none is."""
    timed = with_zone(raw, sources).withColumn("ts", first_reading(F.get_json_object("raw_text", "$.timestamp"), F.col("_tz"))).drop("_tz")
    t, ops = _parts(timed)
    c = F.col
    s = rollout_sessions(t)
    names = s.select(c("file").alias("_file"), "session")
    own = lambda df: df.join(names, df["file"] == names["_file"]).drop("_file")
    ev = lambda df, kind, sub, **f: as_events(df.select("source_id", "file", "session", F.lit(kind).alias("kind"), F.lit(sub).alias("sub"), *[x.alias(n) for n, x in f.items()]))
    turns = own(turns_of(t))
    out = ev(s, "session_started", 0, rec=c("line_no"), ts=c("ts"), root=c("root"), parent=c("parent"), session_kind=c("session_kind"), agent=c("agent"), cwd=c("cwd"))
    more = [ev(s.where("model is not null"), "session_updated", 1, rec=c("line_no"), ts=c("ts"), model=c("model"))]
    more.append(ev(turns, "turn_started", 2, rec=c("line_no"), ts=c("start_ts"), turn_seq=c("turn_seq")))
    stale = F.lit(False) if now_us is None else (F.lit(now_us) - c("last_ts") >= STALE_US)
    ended = turns.withColumn("_stale", (c("status") == "running") & stale)
    at = F.when(c("_stale"), F.greatest(F.lit(now_us or 0).cast("bigint"), c("start_ts"))).otherwise(c("end_ts"))
    more.append(
        ev(ended.where("status <> 'running' or _stale"), "turn_finalized", 4, rec=F.coalesce("end_line", "line_no"), ts=at, end_ts=at, turn_seq=c("turn_seq"),
           status=F.when(c("_stale"), "failed").otherwise(c("status")), error_class=F.when(c("_stale"), "incomplete").otherwise(c("error_class")))
    )
    more.append(ev(ended.where("_stale"), "session_finalized", 9, rec=c("line_no"), ts=at, end_ts=at, status=F.lit("failed"), error_class=F.lit("incomplete")))
    o = own(ops)
    where = {"turn_seq": c("turn_seq"), "op_seq": c("op_seq")}
    more.append(ev(o, "op_started", 3, rec=c("line_no"), ts=c("start_ts"), op_kind=c("op_kind"), name=c("name"), namespace=c("namespace"), model=c("model"), parent_op_seq=F.lit(-1), **where))
    gone = ended.where("_stale").select(c("file").alias("_f"), c("turn_seq").alias("_t"), at.alias("_at"))
    o = o.join(gone, (o["file"] == gone["_f"]) & (o["turn_seq"] == gone["_t"]), "left")
    state = F.when((c("status") == "running") & c("_at").isNotNull(), "cancelled").otherwise(c("status"))
    more.append(
        ev(o.where("status <> 'running' or _at is not null"), "op_finalized", 5, rec=c("end_line"), ts=F.coalesce("end_ts", "_at"), end_ts=F.coalesce("end_ts", "_at"), status=state, error_class=c("error_class"),
           **{n: c(n) for n in ("tokens_in", "tokens_out", "tokens_cache_read", "tokens_cache_write", "ctx_used")}, **where)
    )
    for x in more:
        out = out.unionByName(x)
    return out


def legacy_ops(legacy: DataFrame) -> DataFrame:
    """Operations of legacy rollouts: one turn 1 per file, closed completed; outputs pair by call id."""
    items = valid_rollouts(legacy)
    j = lambda p: F.get_json_object("item", f"$.{p}")
    # a file delivered twice is one file
    once = items.groupBy("source_id", "file_name", "item_no").agg(F.min_by(F.struct("session_id", "item"), "row_id").alias("x")).select("source_id", "file_name", "item_no", "x.*")
    base = once.select(
        "source_id", "file_name", "session_id", "item_no", j("type").alias("ptype"), j("role").alias("role"), j("name").alias("name"), j("call_id").alias("call_id"), output_class(j("output")).alias("bad")
    )
    ops = base.withColumn("op_kind", _kind()).where("op_kind is not null")
    ops = positions(ops, ["source_id", "file_name"], ["item_no"], "op_seq")
    out = base.where(F.col("ptype").isin(*OUTPUTS)).groupBy(F.col("source_id").alias("_s"), F.col("file_name").alias("_f"), F.col("call_id").alias("_c")).agg(F.min_by(F.struct("bad"), "item_no").alias("o"))
    x = ops.join(out, (ops["source_id"] == out["_s"]) & (ops["file_name"] == out["_f"]) & (ops["call_id"] == out["_c"]) & (ops["op_kind"] == "tool"), "left")
    return x.select(
        "source_id", "file_name", "session_id", F.lit(1).cast("bigint").alias("turn_seq"), "op_seq", "op_kind", "name",
        F.when(F.col("op_kind") == "tool", namespace(F.col("ptype"), F.coalesce("name", F.lit("")))).alias("namespace"),
        F.when(F.col("o.bad").isNotNull(), "failed").otherwise("completed").alias("status"), F.col("o.bad").alias("error_class"),
    )

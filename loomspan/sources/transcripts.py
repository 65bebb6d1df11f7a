"""Chat transcripts as canonical events.

A transcript's turns follow from the order of its lines, so this is a DataFrame
plan over distributed ordered computations: a conversation may be of any length.

Rules: a prompt is a user line whose content is one text and that is neither meta
nor a compaction summary; it opens a turn and ends the one before. Text and image
blocks of a user line are inputs within the turn. An assistant line with a model is
a model operation, its thinking blocks reasoning operations below it, its tool_use
blocks tool operations; they end at the result that names their id and stay running
without one. What comes before the first prompt is a turn of its own. Lines
delivered twice (same uuid) count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.bad_rows import with_zone
from loomspan.operators.instants import first_reading
from loomspan.operators.windows import numbered_turns, positions
from loomspan.sources.adapters import as_events, register

_BLOCK = "struct<type:string,text:string,thinking:string,id:string,name:string,tool_use_id:string,is_error:boolean>"
_USAGE = "struct<input_tokens:string,output_tokens:string,cache_read_input_tokens:string,cache_creation_input_tokens:string>"
# The model name of lines that no model wrote, the provider of all others, the tool that starts a session.
SYNTHETIC, PROVIDER, AGENT_TOOL = "<synthetic>", "anthropic", "Agent"
KEY = ["session_id", "agent"]
_OP = "struct<op_kind:string,name:string,tool_use_id:string,block:int,bytes_out:bigint>"
_USED = {"input_tokens": "tokens_in", "output_tokens": "tokens_out", "cache_read_input_tokens": "tokens_cache_read", "cache_creation_input_tokens": "tokens_cache_write"}


def tool_namespace(name: Column) -> Column:
    """``mcp__server__tool`` belongs to ``mcp:server``, every other tool to ``builtin``."""
    srv = F.regexp_extract(name, r"^mcp__(.+?)__", 1)
    return F.when(srv != "", F.concat(F.lit("mcp:"), srv)).otherwise("builtin")


def tool_name(name: Column) -> Column:
    return F.coalesce(F.expr("nullif(regexp_extract(name, '^mcp__.+?__(.+)$', 1), '')"), name)


def _same_line():
    """A line delivered twice has the same uuid; its copies are few."""
    return Window.partitionBy("session_id", F.coalesce("uuid", F.col("line_id").cast("string"))).orderBy("line_id")


def read_lines(lines: DataFrame) -> DataFrame:
    """One row per line: its operations and results as arrays of names and ids; texts end here, before the first shuffle."""
    have = lambda c, t: F.col(c) if c in lines.columns else F.lit(None).cast(t)
    parsed = lines.select(
        "session_id",
        F.coalesce("agent_id", F.lit("")).alias("agent"),
        "line_id",
        "uuid",
        have("source_id", "string").alias("source_id"),
        have("cwd", "string").alias("cwd"),
        have("ts", "bigint").alias("ts"),
        have("subtype", "string").alias("subtype"),
        F.lower(F.trim("line_type")).alias("kind"),
        F.coalesce("is_meta", F.lit(False)).alias("meta"),
        F.coalesce("is_compact_summary", F.lit(False)).alias("compact"),
        # a content that is one text leaves the array NULL
        F.from_json("message", f"struct<model:string,content:array<{_BLOCK}>,usage:{_USAGE}>").alias("m"),
        "message",
    )
    plain = F.when(F.col("m.content").isNull(), F.from_json("message", "struct<content:string>")["content"])
    blocks = F.coalesce("m.content", F.expr(f"cast(array() as array<{_BLOCK}>)"))
    at = F.transform(blocks, lambda b, i: F.struct(b.alias("b"), i.alias("i")))
    heard = (F.col("kind") == "user") & ~F.col("meta") & ~F.col("compact")
    spoken = (F.col("kind") == "assistant") & (F.coalesce("m.model", F.lit("")) != "") & (F.col("m.model") != SYNTHETIC)

    def ops(wanted: tuple[str, ...], kind: Column, name, tool=None, size=None) -> Column:
        none = lambda b: F.lit(None).cast("string")
        return F.transform(
            F.filter(at, lambda x: x["b"]["type"].isin(*wanted)),
            lambda x: F.struct(
                (kind(x["b"]) if callable(kind) else kind).alias("op_kind"), name(x["b"]).alias("name"), (tool or none)(x["b"]).alias("tool_use_id"), x["i"].alias("block"),
                (size(x["b"]) if size else F.lit(None)).cast("bigint").alias("bytes_out"),
            ),
        ).cast(f"array<{_OP}>")

    one = lambda k, name: F.array(F.struct(F.lit(k).alias("op_kind"), name.alias("name"), F.lit(None).cast("string").alias("tool_use_id"), F.lit(-1).alias("block"), F.lit(None).cast("bigint").alias("bytes_out"))).cast(f"array<{_OP}>")
    text = F.lit("user_input")
    base = parsed.select(
        *KEY, "line_id", "uuid", "source_id", "cwd", "ts", "kind", "subtype", "meta", "compact", F.col("m.model").alias("model"), "m.usage", spoken.alias("spoken"),
        (heard & F.coalesce(F.trim(plain) != "", F.lit(False))).alias("p"),
        F.when(heard & F.coalesce(F.trim(plain) != "", F.lit(False)), one("internal", text))
        .when(heard, ops(("text", "image"), F.lit("internal"), lambda b: text))
        .when(
            spoken,
            F.concat(
                one("llm", F.col("m.model")),
                ops(("thinking",), F.lit("reasoning"), lambda b: F.lit(None).cast("string"), None, lambda b: F.octet_length(b["thinking"])),
                ops(("tool_use",), lambda b: F.when(b["name"] == AGENT_TOOL, "session").otherwise("tool"), lambda b: b["name"], lambda b: b["id"]),
            ),
        ).alias("ops"),
        F.when(heard, F.transform(F.filter(at, lambda x: (x["b"]["type"] == "tool_result") & x["b"]["tool_use_id"].isNotNull()), lambda x: F.struct(x["b"]["tool_use_id"].alias("id"), F.coalesce(x["b"]["is_error"], F.lit(False)).alias("bad"), x["i"].alias("block")))).alias("results"),
        F.when(spoken, F.transform(F.filter(at, lambda x: x["b"]["type"] == "text"), lambda x: x["i"])).alias("texts"),
    )
    return base.withColumn("_copy", F.row_number().over(_same_line())).where("_copy = 1").drop("_copy", "uuid")


def _operations(base: DataFrame) -> DataFrame:
    turns = numbered_turns(base, KEY, ["line_id"], "p")
    ops = turns.select(
        *KEY, "turn_seq", "line_id", "source_id", "ts", "model", "usage", F.posexplode("ops").alias("k", "op")
    ).select(*KEY, "turn_seq", "line_id", "source_id", "ts", "k", "op.*", "model", "usage.*")
    # operations in front of the first prompt make a turn of their own, so the others come one later
    early = ops.where("turn_seq = 0").select(F.col("session_id").alias("_s"), F.col("agent").alias("_a")).distinct()
    ops = ops.join(early, (ops["session_id"] == early["_s"]) & (ops["agent"] == early["_a"]), "left")
    ops = ops.withColumn("turn_seq", F.col("turn_seq") + F.when(F.col("_s").isNotNull(), 1).otherwise(0)).drop("_s", "_a")
    numbered = positions(ops, [*KEY, "turn_seq"], ["line_id", "k"], "op_seq")
    results = (
        base.select("session_id", "agent", F.explode("results").alias("b"), "line_id", "ts")
        .groupBy(F.col("session_id").alias("_s"), F.col("agent").alias("_a"), F.col("b.id").alias("_t"))
        .agg(F.min_by(F.struct("line_id", "ts", "b.bad", "b.block"), F.struct("line_id", "b.block")).alias("r"))
    )
    j = numbered.join(results, (numbered["session_id"] == results["_s"]) & (numbered["agent"] == results["_a"]) & (numbered["tool_use_id"] == results["_t"]), "left")
    called = F.col("op_kind").isin("tool", "session")
    llm = F.col("op_kind") == "llm"
    return j.select(
        *KEY, "source_id", "turn_seq", "op_seq", "op_kind",
        F.when(F.col("op_kind") == "tool", tool_name(F.col("name"))).otherwise(F.col("name")).alias("name"),
        F.when(called, tool_namespace(F.col("name"))).alias("namespace"),
        F.when(llm, F.col("model")).alias("model"), "line_id", F.col("r.line_id").alias("result_line"), F.col("ts").alias("start_ts"),
        F.when(called, F.col("r.ts")).otherwise(F.col("ts")).alias("end_ts"), "block", F.col("r.block").alias("result_block"), "tool_use_id", "bytes_out",
        F.when(~called, "completed").when(F.col("r.bad"), "failed").when(F.col("r").isNotNull(), "completed").otherwise("running").alias("status"),
        F.when(called & F.col("r.bad"), "tool_error").alias("error_class"),
        *[F.when(llm, F.coalesce(F.col(a).try_cast("bigint"), F.lit(0))).otherwise(0).alias(b) for a, b in _USED.items()],
    )


def transcript_ops(lines: DataFrame) -> DataFrame:
    """Operations of transcript lines: session, agent, turn_seq, op_seq, op_kind, name, namespace, model, line_id, status, tokens."""
    return _operations(read_lines(lines))


def native_id() -> Column:
    """A conversation's own id: the session, with its agent for a side conversation."""
    return F.when(F.col("agent") == "", F.col("session_id")).otherwise(F.concat_ws(":agent:", "session_id", "agent"))


def transcript_turns(ops: DataFrame) -> DataFrame:
    """session_id, agent, source_id, turn_seq, start_ts, line_id, opened (by an input), end_ts (start of the next turn; the last one stays open)."""
    t = ops.groupBy(*KEY, "turn_seq").agg(
        F.min("source_id").alias("source_id"), F.min("line_id").alias("line_id"), F.min_by("start_ts", F.struct("line_id", "op_seq")).alias("start_ts"),
        (F.min_by("op_kind", F.struct("line_id", "op_seq")) == "internal").alias("opened"),
    )
    nxt = t.select(F.col("session_id").alias("_s"), F.col("agent").alias("_a"), (F.col("turn_seq") - 1).alias("_n"), F.col("start_ts").alias("end_ts"), F.col("line_id").alias("end_line"))
    return t.join(nxt, (t["session_id"] == nxt["_s"]) & (t["agent"] == nxt["_a"]) & (t["turn_seq"] == nxt["_n"]), "left").drop("_s", "_a", "_n")


@register("claude_code")
def transcripts(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """raw: transcript lines. ``rec`` is the line id."""
    timed = with_zone(raw, sources).withColumn("ts", first_reading(F.col("line_timestamp"), F.col("_tz")))
    base = read_lines(timed)
    ops = _operations(base)
    me = native_id()
    who = {"session": me, "file": F.col("session_id"), "source_id": F.col("source_id")}
    ev = lambda df, kind, sub, **f: as_events(df.select(*[c.alias(n) for n, c in (who | {"kind": F.lit(kind), "sub": F.lit(sub)} | f).items()]))
    c = F.col
    first = base.groupBy(*KEY).agg(
        F.min("source_id").alias("source_id"), F.min_by("ts", F.when(c("ts").isNotNull(), c("line_id"))).alias("ts"), F.min("line_id").alias("line_id"),
        F.min_by("cwd", F.when(c("cwd") != "", c("line_id"))).alias("cwd"), F.min_by("model", F.when(c("spoken"), c("line_id"))).alias("model"), F.min(F.when(c("spoken"), c("line_id"))).alias("model_line"),
    )
    parent = F.when(c("agent") != "", c("session_id"))
    started = ev(first, "session_started", 0, rec=c("line_id"), ts=c("ts"), root=c("session_id"), parent=parent, session_kind=F.when(c("agent") == "", "root").otherwise("sub_agent"), agent=F.expr("nullif(agent, '')"), cwd=c("cwd"))
    named = ev(first.where("model is not null"), "session_updated", 1, rec=c("model_line"), ts=c("ts"), model=c("model"))
    t = transcript_turns(ops)
    turns = ev(t.where("opened"), "turn_started", 2, rec=c("line_id"), ts=c("start_ts"), turn_seq=c("turn_seq"))
    ended = ev(t.where("end_line is not null"), "turn_finalized", 3, rec=c("end_line"), ts=c("end_ts"), end_ts=c("end_ts"), turn_seq=c("turn_seq"), status=F.lit("completed"))
    at = {"turn_seq": c("turn_seq"), "op_seq": c("op_seq")}
    below = F.when(c("op_kind") == "reasoning", F.lit(1)).otherwise(F.lit(-1))
    begun = ev(ops, "op_started", 4, rec=c("line_id"), ts=c("start_ts"), op_kind=c("op_kind"), name=c("name"), namespace=c("namespace"), model=c("model"), provider=F.when(c("op_kind") == "llm", PROVIDER), parent_op_seq=below, extras=F.when(c("op_kind") == "session", F.to_json(F.struct(c("tool_use_id").alias("toolUseId")))), **at)
    done = ev(
        ops.where("status <> 'running'"), "op_finalized", 5, rec=F.coalesce("result_line", "line_id"), ts=c("end_ts"), end_ts=c("end_ts"), status=c("status"), error_class=c("error_class"), bytes_out=c("bytes_out"),
        **{n: c(n) for n in _USED.values()}, ctx_used=F.when(c("op_kind") == "llm", c("tokens_in") + c("tokens_out") + c("tokens_cache_read") + c("tokens_cache_write")), **at,
    )
    place = lambda line, pointer: F.concat(F.lit("line://"), line.cast("string"), F.lit("?json_pointer=/message/content"), pointer)
    inside = F.when(c("block") >= 0, F.concat(F.lit("/"), c("block").cast("string"))).otherwise("")
    sent = ev(
        ops.where("op_kind <> 'llm'"), "payload_ref", 6, rec=c("line_id"), ts=c("start_ts"),
        payload_kind=F.when(c("op_kind") == "reasoning", "llm_reasoning").otherwise("tool_request"), format=F.when(c("op_kind").isin("tool", "session"), "json").otherwise("text"), location=place(c("line_id"), inside), **at,
    )
    got = ev(ops.where("result_line is not null"), "payload_ref", 7, rec=c("result_line"), ts=c("end_ts"), payload_kind=F.lit("tool_response"), format=F.lit("json"), location=place(c("result_line"), F.concat(F.lit("/"), c("result_block").cast("string"), F.lit("/content"))), **at)
    note = (
        F.when((c("kind") == "user") & c("meta"), "meta-user").when((c("kind") == "user") & c("compact"), "compaction-summary").when((c("kind") == "assistant") & ~c("spoken"), "synthetic-assistant")
        .when(c("kind") == "system", F.concat_ws(":", F.lit("system"), F.expr("nullif(subtype, '')")))
    )
    logs = ev(base.withColumn("note", note).where("note is not null"), "log_entry", 8, rec=c("line_id"), ts=c("ts"), severity=F.when(c("note") == "meta-user", "DBG").otherwise("INF"), message=c("note"))
    out = started
    for x in (named, turns, ended, begun, done, sent, got, logs):
        out = out.unionByName(x)
    return out

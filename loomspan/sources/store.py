"""The session store (SQLite tables session, message, part) as canonical events.

Rules: an assistant message is a turn; its token counters are cumulative over the
turns of a session, those of its step-finish parts over the steps of the message. A
step-start part opens a model operation that the next step-finish ends; one that the next
step-start finds open is cancelled. Reasoning and tool parts are operations of their own. A session with a
parent is a sub-agent; archived is completed, an error of its last turn failed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import graph
from loomspan.operators.windows import carry_last, next_value, positions
from loomspan.sources.adapters import as_events, register

RAW = "source_id string, tbl string, id string, session_id string, message_id string, time_created bigint, time_updated bigint, data string"
#: Columns of a session row that go into its JSON; those that a file lacks are NULL.
SESSION_COLUMNS = ("parent_id", "project_id", "slug", "directory", "title", "version", "agent", "model", "time_archived")
_COUNTS = {"tokens_in": "input", "tokens_out": "output", "tokens_cache_read": "cache.read", "tokens_cache_write": "cache.write"}
_MAX = 2**63 - 1


def read_store(spark: SparkSession, path: str, source_id: str, since: int | None = None, sessions: list[str] | None = None) -> DataFrame:
    """Rows of the three tables in one form; ``since`` reads what changed from then on, ``sessions`` only those."""
    more = {"since": str(since)} if since is not None else {}
    if sessions is not None:
        more["ids"] = "\x1f".join(sessions)
    read = lambda t, cols, **o: spark.read.format("sqlite_table").options(path=path, table=t, columns=cols, **more, **o).load()
    s = read("session", "id:string,time_created:bigint,time_updated:bigint," + ",".join(f"{c}:string" for c in SESSION_COLUMNS), required="id,time_created", key="id")
    m = read("message", "id:string,session_id:string,time_created:bigint,time_updated:bigint,data:string", required="id,session_id,data", key="session_id")
    p = read("part", "id:string,session_id:string,message_id:string,time_created:bigint,time_updated:bigint,data:string", required="id,message_id,data", key="session_id")
    none = F.lit(None).cast("string")
    src = F.lit(source_id).alias("source_id")
    s = s.select(src, F.lit("session").alias("tbl"), "id", F.col("id").alias("session_id"), none.alias("message_id"), "time_created", "time_updated", F.to_json(F.struct(*SESSION_COLUMNS)).alias("data"))
    m = m.select(src, F.lit("message").alias("tbl"), "id", "session_id", F.col("id").alias("message_id"), "time_created", "time_updated", "data")
    p = p.select(src, F.lit("part").alias("tbl"), "id", "session_id", "message_id", "time_created", "time_updated", "data")
    return s.unionByName(m).unionByName(p)


def change_probe(rows: DataFrame) -> DataFrame:
    """tbl, last_id, last_updated, n_rows of each table: whether anything is new, from a single aggregate."""
    return rows.groupBy("tbl").agg(F.max("id").alias("last_id"), F.max("time_updated").alias("last_updated"), F.count(F.lit(1)).alias("n_rows"))


def _us(ms: Column) -> Column:
    return F.when(ms > 0, ms * 1000)


def _j(path: str, c: str = "data") -> Column:
    return F.get_json_object(c, f"$.{path}")


def _minus(a: Column, b: Column) -> Column:
    """What a counter grew by: never below 0, at most what a column holds."""
    d = F.try_subtract(a, b)
    return F.when(d.isNull(), F.when(a > 0, F.lit(_MAX)).otherwise(F.lit(0))).otherwise(F.greatest(d, F.lit(0)))


def _counters(root: str) -> Column:
    return F.struct(*[F.coalesce(_j(f"{root}.{p}").cast("bigint"), F.lit(0)).alias(n) for n, p in _COUNTS.items()])


def _deltas(now: str, before: str) -> list[Column]:
    return [_minus(F.col(f"{now}.{n}"), F.coalesce(F.col(f"{before}.{n}"), F.lit(0))).alias(n) for n in _COUNTS]


def store_turns(raw: DataFrame) -> DataFrame:
    """source_id, session, message, turn_seq, times, status, error and tokens of every assistant message."""
    m = raw.where((F.col("tbl") == "message") & (_j("role") == "assistant"))
    m = m.dropDuplicates(["source_id", "id"])
    finished = raw.where((F.col("tbl") == "part") & (_j("type") == "step-finish")).select(F.col("source_id").alias("_s"), F.col("message_id").alias("_m")).distinct()
    err = _j("error").isNotNull()
    x = m.select(
        "source_id", F.col("session_id").alias("session"), F.col("id").alias("message"), F.col("time_created").alias("at"), _us(F.col("time_created")).alias("start_ts"),
        _us(_j("time.completed").cast("bigint")).alias("done_ts"), _counters("tokens").alias("now"), F.coalesce(_j("cost").cast("double"), F.lit(0.0)).alias("cost_usd"),
        F.when(err, "failed").otherwise("completed").alias("status"), F.when(err, F.coalesce(F.nullif(_j("error.name"), F.lit("")), F.lit("error"))).alias("error_class"),
        _j("error.data.message").alias("error_message"), _j("modelID").alias("model"), _j("providerID").alias("provider"),
    )
    x = x.join(finished, (x["source_id"] == finished["_s"]) & (x["message"] == finished["_m"]), "left")
    x = x.withColumn("ended", F.col("done_ts").isNotNull() | (F.col("status") == "failed") | F.col("_m").isNotNull()).drop("_s", "_m")
    x = positions(x, ["source_id", "session"], ["at", "message"], "turn_seq")
    # only turns that ended move the counter on
    x = carry_last(x.withColumn("_now", F.when(F.col("ended"), F.col("now"))), ["source_id", "session"], ["at", "message"], "_now", "before")
    return x.select(
        "source_id", "session", "message", "at", "turn_seq", "start_ts", F.when(F.col("ended"), F.coalesce("done_ts", "start_ts")).alias("end_ts"), "ended",
        F.when(F.col("ended"), F.col("status")).otherwise("running").alias("status"), "error_class", "error_message", "model", "provider", "cost_usd", *_deltas("now", "before"),
    )


def store_ops(raw: DataFrame, turns: DataFrame) -> DataFrame:
    """Operations of the parts, numbered within their turn."""
    p = raw.where(F.col("tbl") == "part").dropDuplicates(["source_id", "id"]).select(
        "source_id", F.col("message_id").alias("message"), F.col("id").alias("part"), F.col("time_created").alias("at"), _us(F.col("time_created")).alias("ts"),
        _j("type").alias("type"), "data",
    )
    p = p.where(F.col("type").isin("step-start", "step-finish", "reasoning", "tool"))
    kind = F.when(F.col("type") == "step-start", "llm").when(F.col("type") == "reasoning", "reasoning").when(F.col("type") == "tool", F.when(_j("tool") == "task", "session").otherwise("tool"))
    key, order = ["source_id", "message"], ["at", "part"]
    p = p.withColumn("op_kind", kind)
    ops = positions(p.where("op_kind is not null"), key, order, "op_seq")
    # the operation that a step-finish ends, and the counters it adds to
    marks = ops.select("source_id", "message", "part", "at", "ts", "type", "data", "op_kind", "op_seq").unionByName(
        p.where("type = 'step-finish'").select("source_id", "message", "part", "at", "ts", "type", "data", F.lit(None).cast("string").alias("op_kind"), F.lit(None).cast("bigint").alias("op_seq"))
    )
    llm = F.when(F.col("op_kind") == "llm", F.col("op_seq"))
    marks = carry_last(marks.withColumn("_llm", llm), key, order, "_llm", "of_llm")
    fin = marks.where("type = 'step-finish'").withColumn("now", _counters("tokens"))
    fin = carry_last(fin, key, order, "now", "before")
    ended = fin.where("of_llm is not null").select(
        F.col("source_id").alias("_s"), F.col("message").alias("_m"), F.col("of_llm").alias("_o"), F.col("ts").alias("fin_ts"), "at", "part", F.coalesce(_j("cost").cast("double"), F.lit(0.0)).alias("cost"),
        F.struct(*_deltas("now", "before")).alias("d"), (F.col("now.tokens_in") + F.col("now.tokens_out") + F.col("now.tokens_cache_read") + F.col("now.tokens_cache_write")).alias("ctx"),
    ).groupBy("_s", "_m", "_o").agg(F.min_by(F.struct("fin_ts", "cost", "d", "ctx"), F.struct("at", "part")).alias("fin"))
    opened = marks.where("op_kind = 'llm'").select("source_id", "message", "op_seq", "ts")
    opened = next_value(opened, key, ["op_seq"], "ts", "next_ts").select(F.col("source_id").alias("_ns"), F.col("message").alias("_nm"), F.col("op_seq").alias("_no"), "next_ts")
    own = marks.where("op_kind is not null")
    x = own.join(ended, (own["source_id"] == ended["_s"]) & (own["message"] == ended["_m"]) & (own["op_seq"] == ended["_o"]), "left")
    x = x.join(opened, (x["source_id"] == opened["_ns"]) & (x["message"] == opened["_nm"]) & (x["op_seq"] == opened["_no"]), "left")
    t = turns.select(F.col("source_id").alias("_ts"), F.col("message").alias("_tm"), "session", "turn_seq", "model", "provider")
    x = x.join(t, (x["source_id"] == t["_ts"]) & (x["message"] == t["_tm"]))
    is_llm, is_tool = F.col("op_kind") == "llm", F.col("type") == "tool"
    state, tool = _j("state.status"), _j("tool")
    end = _us(_j("state.time.end").cast("bigint"))
    status = (
        F.when(is_llm, F.when(F.col("fin").isNotNull(), "completed").when(F.col("next_ts").isNotNull(), "cancelled").otherwise("running"))
        .when(~is_tool, "completed").when(state == "completed", "completed").when(state == "error", "failed")
        .when(state.isin("running", "pending") | state.isNull(), "running").when(end.isNotNull(), "completed").otherwise("running")
    )
    start = F.when(is_tool, F.coalesce(_us(_j("state.time.start").cast("bigint")), F.col("ts"))).otherwise(F.col("ts"))
    n = lambda c: F.when(is_llm, F.coalesce(F.col(f"fin.d.{c}"), F.lit(0))).otherwise(0).alias(c)
    split = F.regexp_extract(tool, "^([^_]+)_(.+)$", 1)
    return x.select(
        "source_id", "session", "turn_seq", "op_seq", "op_kind", start.alias("start_ts"), status.alias("status"),
        F.when(status != "running", F.greatest(start, F.when(is_llm, F.coalesce("fin.fin_ts", "next_ts")).when(is_tool, F.coalesce(end, start)).otherwise(F.coalesce(_us(_j("time.end").cast("bigint")), F.col("ts"))))).alias("end_ts"),
        F.when(is_llm, F.col("model")).when(is_tool & (split != ""), F.regexp_extract(tool, "^([^_]+)_(.+)$", 2)).when(is_tool, tool).alias("name"),
        F.when(is_tool & (split != ""), split).alias("namespace"), F.when(is_llm, F.col("model")).alias("model"), F.when(is_llm, F.col("provider")).alias("provider"),
        F.when(F.col("op_kind") == "reasoning", F.coalesce("of_llm", F.lit(-1))).otherwise(F.lit(-1)).alias("parent_op_seq"),
        F.when(F.col("op_kind") == "session", F.coalesce(_j("state.metadata.sessionId"), _j("state.metadata.sessionID"))).alias("child_session"),
        F.when(state == "error", _j("state.error")).alias("error_message"), *[n(c) for c in _COUNTS], F.when(is_llm, F.coalesce("fin.cost", F.lit(0.0))).otherwise(0.0).alias("cost_usd"),
        F.when(is_llm, F.col("fin.ctx")).alias("ctx_used"), F.when(is_tool, F.octet_length(_j("state.input"))).alias("bytes_in"), F.when(is_tool, F.octet_length(_j("state.output"))).alias("bytes_out"), F.col("part"),
    )


@register("opencode")
def store(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """raw: rows of ``read_store``."""
    c = F.col
    s = raw.where("tbl = 'session'").dropDuplicates(["source_id", "id"]).select("source_id", "id", "time_created", *[F.nullif(_j(x), F.lit("")).alias(x) for x in SESSION_COLUMNS])
    key = lambda x: F.concat_ws("\x1f", "source_id", x)
    roots = graph.roots(s.select(key("id").alias("id"), F.when(c("parent_id").isNotNull(), key("parent_id")).alias("parent_session_id"))).select(c("id").alias("_k"), c("root_id").alias("_r"))
    s = s.join(roots, key("id") == roots["_k"]).withColumn("root", F.coalesce(F.element_at(F.split("_r", "\x1f"), -1), "id")).drop("_k", "_r")
    turns = store_turns(raw)
    ops = store_ops(raw, turns)
    ev = lambda df, kind, sub, **f: as_events(df.select("source_id", F.lit(kind).alias("kind"), F.lit(sub).alias("sub"), *[x.alias(n) for n, x in f.items()]))
    ms = c("time_created")
    out = ev(
        s, "session_started", 0, file=c("id"), rec=ms, session=c("id"), root=c("root"), parent=c("parent_id"), session_kind=F.when(c("parent_id").isNull(), "root").otherwise("sub_agent"), agent=c("agent"), ts=_us(ms),
        model=F.coalesce(_j("modelID", "model"), _j("id", "model")), provider=_j("providerID", "model"), cwd=c("directory"), extras=F.to_json(F.struct("version", "slug", "title", "project_id")),
    )
    last = turns.groupBy(c("source_id").alias("_s"), c("session").alias("_i")).agg(F.max_by(F.struct("status", "error_class", "error_message", "end_ts"), "turn_seq").alias("t"))
    f = s.join(last, (s["source_id"] == last["_s"]) & (s["id"] == last["_i"]), "left").withColumn("gone", _us(c("time_archived").cast("bigint")))
    f = f.where("gone is not null or t.status = 'failed'")
    end = F.coalesce("gone", "t.end_ts")
    lost = F.when(c("gone").isNull(), c("t.error_class"))
    more = [ev(f, "session_finalized", 9, file=c("id"), rec=end, session=c("id"), ts=end, end_ts=end, status=F.when(c("gone").isNotNull(), "completed").otherwise("failed"), error_class=lost, error_message=F.when(c("gone").isNull(), c("t.error_message")))]
    me = {"file": c("session"), "session": c("session"), "turn_seq": c("turn_seq")}
    used = {n: c(n) for n in (*_COUNTS, "cost_usd")}
    more.append(ev(turns, "turn_started", 1, rec=c("at"), ts=c("start_ts"), **me))
    more.append(ev(turns.where("ended"), "turn_finalized", 8, rec=c("at"), ts=c("end_ts"), end_ts=c("end_ts"), status=c("status"), error_class=c("error_class"), error_message=c("error_message"), **used, **me))
    at = me | {"op_seq": c("op_seq")}
    more.append(ev(ops, "op_started", 2, rec=c("start_ts"), ts=c("start_ts"), op_kind=c("op_kind"), name=c("name"), namespace=c("namespace"), model=c("model"), provider=c("provider"), parent_op_seq=c("parent_op_seq"), child_session=c("child_session"), **at))
    more.append(ev(ops.where("status <> 'running'"), "op_finalized", 3, rec=c("end_ts"), ts=c("end_ts"), end_ts=c("end_ts"), status=c("status"), error_message=c("error_message"), ctx_used=c("ctx_used"), bytes_in=c("bytes_in"), bytes_out=c("bytes_out"), **used, **at))
    for x in more:
        out = out.unionByName(x)
    return out

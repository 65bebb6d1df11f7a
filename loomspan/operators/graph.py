"""Session trees, traces, timelines and call topologies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.hierarchy import resolve
from loomspan.operators.stats import count_if, money
from loomspan.runtime import stage, unstage


def child_counts(sessions: DataFrame) -> DataFrame:
    """id, children of every session."""
    c = sessions.where("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    return sessions.join(c, sessions["id"] == c["_p"], "left").select("id", F.coalesce("n", F.lit(0)).alias("children"))


def descendants(sessions: DataFrame, roots: DataFrame, max_depth: int = 20) -> DataFrame:
    """id, ancestor, depth (1 = child) below each of ``roots`` (column id), down to ``max_depth``.

    Level by level: a level joins only the frontier, and an empty frontier ends it,
    so loops are cut at max_depth.
    """
    edges = sessions.where("parent_session_id is not null").select("id", "parent_session_id")
    frontier = roots.select("id", F.col("id").alias("ancestor"))
    out = None
    for depth in range(1, max_depth + 1):
        up = frontier.select(F.col("id").alias("_up"), "ancestor")
        frontier = stage(edges.join(up, edges["parent_session_id"] == up["_up"]).select("id", "ancestor"))
        if frontier.isEmpty():
            break
        level = frontier.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
    return out if out is not None else frontier.withColumn("depth", F.lit(0)).limit(0)


def roots(sessions: DataFrame) -> DataFrame:
    """id, root_id by pointer doubling; a session of a loop has NULL.

    A round halves the remaining distance, so even a deep tree needs few.
    """
    base = sessions.select("id", F.col("parent_session_id").alias("ptr"))
    known = base.select(F.col("id").alias("_k"))
    cur = stage(base.join(known, base["ptr"] == known["_k"], "left").select("id", F.coalesce("_k", "id").alias("ptr"), F.col("_k").isNull().alias("done")))
    bound, jumps = cur.count(), 1
    while jumps <= 2 * bound and not cur.where("not done").isEmpty():
        up = cur.select(F.col("id").alias("_u"), F.col("ptr").alias("_p"), F.col("done").alias("_d"))
        nxt = stage(
            cur.join(up, ~cur["done"] & (cur["ptr"] == up["_u"]), "left").select(
                "id", F.coalesce("_p", "ptr").alias("ptr"), (F.col("done") | F.coalesce("_d", F.lit(False))).alias("done")
            )
        )
        unstage(cur)
        cur, jumps = nxt, 2 * jumps
    return cur.select("id", F.when(F.col("done"), F.col("ptr")).alias("root_id"))


def trace(ops: DataFrame, with_root: DataFrame, root: object) -> DataFrame:
    """All operations below one root, in trace order."""
    inside = with_root.where(F.col("root_id") == F.lit(root)).select(F.col("id").alias("session_id"))
    return ops.join(inside, "session_id", "left_semi").orderBy("start_ts", "session_id", "turn_seq", "op_seq")


def timeline(sessions: DataFrame, ops: DataFrame) -> DataFrame:
    """Lane of every session: bounds and number of spans."""
    s = sessions.select(F.col("id").alias("session_id"), F.col("start_ts").alias("s0"))
    return ops.join(s, "session_id").groupBy("session_id").agg(
        F.min(F.least("start_ts", "s0")).alias("lane_start"),
        F.max(F.coalesce("end_ts", "start_ts")).alias("lane_end"),
        F.count(F.lit(1)).alias("spans"),
    )


def topology_nodes(sessions: DataFrame, ops: DataFrame) -> DataFrame:
    """Agents and tools with calls, cost, time and failures."""
    s = sessions.select(F.col("id").alias("session_id"), "agent_name")
    took = F.when(F.col("end_ts") > F.col("start_ts"), F.col("end_ts") - F.col("start_ts")).otherwise(0)
    o = ops.join(s, "session_id").select(
        F.explode(
            F.array(
                F.struct(F.lit("agent").alias("node_kind"), F.col("agent_name").alias("node")),
                F.struct(F.lit("tool").alias("node_kind"), F.when(F.col("kind") == "tool", F.col("tool")).alias("node")),
            )
        ).alias("n"),
        took.alias("took"),
        "cost_usd",
        "status",
        "tokens_in",
    )
    return (
        o.where("n.node <> ''")
        .groupBy("n.node_kind", "n.node")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("took").alias("total_us"),
            money("cost_usd").alias("cost_usd"),
            count_if(F.col("status") == "failed").alias("failures"),
            F.max("tokens_in").alias("max_tokens_in"),
        )
    )


def topology_edges(sessions: DataFrame, ops: DataFrame, with_root: DataFrame | None = None) -> DataFrame:
    """agent -> tool calls and agent -> agent spawns; edges whose end is no node are dropped by the joins."""
    s = sessions.select(F.col("id").alias("session_id"), "agent_name", "parent_session_id")
    took = F.when(F.col("end_ts") > F.col("start_ts"), F.col("end_ts") - F.col("start_ts")).otherwise(0)
    calls = (
        ops.where((F.col("kind") == "tool") & (F.col("tool") != ""))
        .join(s, "session_id")
        .groupBy(F.col("agent_name").alias("source"), F.col("tool").alias("target"))
        .agg(F.count(F.lit(1)).alias("calls"), F.sum(took).alias("total_us"))
        .withColumn("edge_kind", F.lit("calls"))
    )
    parent = s.select(F.col("session_id").alias("_p"), F.col("agent_name").alias("source"))
    spawns = (
        s.join(parent, s["parent_session_id"] == parent["_p"])
        .groupBy("source", F.col("agent_name").alias("target"))
        .agg(F.count(F.lit(1)).alias("calls"), F.lit(0).cast("bigint").alias("total_us"))
        .withColumn("edge_kind", F.lit("spawns"))
    )
    return calls.unionByName(spawns)


def cross_topology(sessions: DataFrame, size: str, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(the ``most`` largest sessions, with ``max_size`` of them and ``truncated`` if there are more; lineage edges among them)."""
    probe = stage(sessions.orderBy(F.col(size).desc_nulls_last(), "id").limit(most + 1))
    facts = probe.agg((F.count(F.lit(1)) > most).alias("truncated"), F.max(size).alias("max_size"))
    top = probe.orderBy(F.col(size).desc_nulls_last(), "id").limit(most)
    kept = top.select(F.col("id").alias("_p"))
    edges = top.join(kept, top["parent_session_id"] == kept["_p"]).select(F.col("_p").alias("source"), F.col("id").alias("target"))
    return top.join(F.broadcast(facts)), edges  # one row


def session_topology(sessions: DataFrame, ops: DataFrame, with_root: DataFrame, root: object) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the sessions below one root; agents are labelled, the root's as such."""
    inside = with_root.where(F.col("root_id") == F.lit(root)).select("id")
    s = sessions.join(inside, "id", "left_semi")
    label = F.concat(F.coalesce(F.nullif("agent_name", F.lit("")), "kind"), F.when(F.col("parent_session_id").isNull(), " (root)").otherwise(""))
    s = s.withColumn("agent_name", label)
    o = ops.join(inside.select(F.col("id").alias("session_id")), "session_id", "left_semi")
    return topology_nodes(s, o), topology_edges(s, o)


def merged_tree(ops: DataFrame) -> DataFrame:
    """All operations below a root as one tree: those without a parent in their session hang below the operation that started the session.

    ops: op_id, session_id, parent_op_id, child_session_id. Returns op_id, session_id, parent, depth, root, pre (the place in a pre-order walk of
    its tree) and size (operations below, itself included). An unknown parent makes a top; of several operations that started a session
    the smallest id counts; operations on a loop have depth -1. Heavy paths give all that, so a tree of any size and depth stays distributed.
    """
    spawn = ops.where("child_session_id is not null").groupBy(F.col("child_session_id").alias("_cs")).agg(F.min("op_id").alias("_spawn"))
    known = ops.select(F.col("op_id").alias("_k"), F.col("session_id").alias("_ks"))
    x = ops.join(known, (ops["parent_op_id"] == known["_k"]) & (ops["session_id"] == known["_ks"]), "left").join(spawn, ops["session_id"] == spawn["_cs"], "left")
    forest = x.select(F.col("op_id").alias("node"), F.coalesce("_k", F.when(F.col("_spawn") != F.col("op_id"), F.col("_spawn"))).alias("parent"), "session_id")
    r = resolve(forest)
    return r.select(F.col("node").alias("op_id"), "session_id", "parent", F.col("depth").cast("int").alias("depth"), F.col("top").alias("root"), "pre", "size")


def child_tree(sessions: DataFrame, roots: DataFrame, max_depth: int = 20) -> DataFrame:
    """id, ancestor, parent, depth, path (ids from below the root down to the session) of all sessions below the roots."""
    edges = sessions.where("parent_session_id is not null").select("id", F.col("parent_session_id").alias("parent"))
    frontier = roots.select("id", F.col("id").alias("ancestor"), F.array().cast(f"array<{sessions.schema['id'].dataType.simpleString()}>").alias("path"))
    out = None
    for depth in range(1, max_depth + 1):
        up = frontier.select(F.col("id").alias("_up"), "ancestor", "path")
        frontier = stage(edges.join(up, edges["parent"] == up["_up"]).select("id", "ancestor", "parent", F.concat("path", F.array("id")).alias("path")))
        if frontier.isEmpty():
            break
        level = frontier.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
    return out if out is not None else frontier.withColumn("depth", F.lit(0)).limit(0)


def turn_rollup(ops: DataFrame) -> DataFrame:
    """session_id, turn_seq, bounds, operations, failures and busiest kind of each turn of a trace."""
    return ops.groupBy("session_id", "turn_seq").agg(
        F.min("start_ts").alias("start_ts"), F.max(F.coalesce("end_ts", "start_ts")).alias("end_ts"), F.count(F.lit(1)).alias("n_ops"), count_if(F.col("status") == "failed").alias("failures")
    )


def lanes(sessions: DataFrame, ops: DataFrame) -> DataFrame:
    """Every session's lane with its spans (start, end, kind, status) in order: one nested row per session."""
    spans = ops.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("start_ts", F.coalesce("end_ts", "start_ts").alias("end_ts"), "kind", "status"))).alias("spans"))
    return timeline(sessions, ops).withColumnRenamed("spans", "n_spans").join(spans, "session_id")


def op_tree(ops: DataFrame) -> DataFrame:
    """Operations nested by their parent sequence within a turn: depth and sort key of a pre-order walk.

    ops: session_id, turn_seq, op_seq, parent_op_seq (NULL = top). Orphans and loops become tops.
    """
    key = ["session_id", "turn_seq"]
    known = ops.select(*[F.col(k).alias(f"k_{k}") for k in key], F.col("op_seq").alias("k_op")).distinct()
    cond = (ops["session_id"] == known["k_session_id"]) & (ops["turn_seq"] == known["k_turn_seq"]) & (ops["parent_op_seq"] == known["k_op"]) & (ops["parent_op_seq"] < ops["op_seq"])
    linked = ops.join(known, cond, "left").select(*key, "op_seq", F.col("k_op").alias("parent"))
    cur = stage(linked.withColumn("path", F.array(F.col("op_seq"))).withColumn("ptr", F.col("parent")))
    while not cur.where("ptr is not null").isEmpty():
        up = cur.select(*[F.col(k).alias(f"u_{k}") for k in key], F.col("op_seq").alias("u_op"), F.col("path").alias("u_path"), F.col("ptr").alias("u_ptr"))
        nxt = stage(
            cur.join(up, (cur["session_id"] == up["u_session_id"]) & (cur["turn_seq"] == up["u_turn_seq"]) & (cur["ptr"] == up["u_op"]), "left").select(
                *key, "op_seq", "parent", F.when(F.col("u_path").isNotNull(), F.concat("u_path", "path")).otherwise(F.col("path")).alias("path"), F.col("u_ptr").alias("ptr")
            )
        )
        unstage(cur)
        cur = nxt
    return cur.select(*key, "op_seq", "parent", (F.size("path") - 1).alias("depth"), "path")


def session_detail(sessions: DataFrame, ops: DataFrame, wanted: list) -> DataFrame:
    """One nested row per wanted session: its turns, each with its operations, in order."""
    o = ops.where(F.col("session_id").isin(*wanted)).groupBy("session_id", "turn_seq").agg(
        F.array_sort(F.collect_list(F.struct("op_seq", "kind", "status", "start_ts"))).alias("ops")
    )
    t = o.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn_seq", "ops"))).alias("turns"))
    s = sessions.where(F.col("id").isin(*wanted))
    return s.join(t, s["id"] == t["session_id"], "left").drop("session_id")

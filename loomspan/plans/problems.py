"""Queries of the general data problems (pN_...), each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import bad_rows, drift, flatten, hierarchy, instants
from loomspan.plans import problem_sql
from loomspan.runtime import stage, table

Query = Callable[[SparkSession, str], DataFrame]


def _schemas(spark: SparkSession, d: str) -> DataFrame:
    return drift.file_schemas(
        *[table(spark, d, t) for t in ("snapshot_files", "ledger_lines", "legacy_rollouts", "transcript_lines", "sources")]
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_schemas(spark, d), table(spark, d, "schema_baseline")).drop("new_name")


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many files have each change."""
    found = drift.changes(_schemas(spark, d), table(spark, d, "schema_baseline"))
    return found.groupBy("src_table", "field_path", "change_kind").agg(F.count(F.lit(1)).alias("n_files"))


def _consistent(src: str, at: str | None = None) -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        key = {"snapshot_files": "snapshots", "ledger_lines": "ledger", "legacy_rollouts": "rollouts", "transcript_lines": "transcripts"}[src]
        rows, sources, base = (table(spark, d, t) for t in (src, "sources", "schema_baseline"))
        found = drift.changes(drift.file_schemas(**{key: rows, "sources": sources}), base)
        return drift.consistent_table(rows, src, found, base, sources, at)

    return q


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    t = flatten.snapshot_triples(table(spark, d, "snapshot_files"), values=False).unionByName(
        flatten.ledger_triples(table(spark, d, "ledger_lines"), table(spark, d, "sources"), values=False)
    )
    return flatten.nodes(t).drop("ordinal")


def _triples(spark: SparkSession, d: str, ledger: bool = True) -> DataFrame:
    t = flatten.snapshot_triples(table(spark, d, "snapshot_files"))
    return t.unionByName(flatten.ledger_triples(table(spark, d, "ledger_lines"), table(spark, d, "sources"))) if ledger else t


def _flat(kind: str) -> Query:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return flatten.pivot_group(_triples(spark, d, kind not in ("session", "turn", "step", "attribute")), kind, with_rest=False)

    return q


def p3_rest(spark: SparkSession, d: str) -> DataFrame:
    """What is no column of the tables of sessions, turns, operations and so on, by node."""
    return flatten.rest_values(_triples(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every array element without a table of its own, with all its values."""
    return flatten.pivot_rest(_triples(spark, d))


def _times(spark: SparkSession, d: str) -> DataFrame:
    return instants.project_times(
        *[table(spark, d, t) for t in ("transcript_lines", "ledger_lines", "snapshot_files", "sessions", "sources")]
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _times(spark, d).where("is_case").select("src_table", "row_id", "utc_us")


def p4_utc(spark: SparkSession, d: str) -> DataFrame:
    """Every value that stands for a time."""
    return _times(spark, d).select("src_table", "row_id", "utc_us")


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """How often each written form occurs in each table."""
    return _times(spark, d).groupBy("src_table", "form", "is_case").agg(F.count(F.lit(1)).alias("n_values"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    r = hierarchy.session_forest(table(spark, d, "sessions"), table(spark, d, "expected_events"))
    return r.where("named").select("src_table", "source_id", "node_id", "top_id", F.col("depth").cast("int").alias("depth"))


def p2_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Every session with its heavy-path labels and the interval of its descendants."""
    r = hierarchy.session_forest(table(spark, d, "sessions"), table(spark, d, "expected_events"))
    return r.select(
        "src_table", "source_id", "node_id", "top_id", "depth", "in_loop", "size", "chain_pos", "pre",
        F.size("segments").alias("chains_on_path"),
    )


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every session outside loops, from the intervals of preorder numbers."""
    r = stage(hierarchy.session_forest(table(spark, d, "sessions"), table(spark, d, "expected_events")))
    part = lambda c, k: F.element_at(F.split(c, hierarchy.SEP), k)
    src = F.when(part("ancestor", 1) == "s", "sessions").otherwise("expected_events")
    return hierarchy.descendants(r, r).select(
        src.alias("src_table"), F.when(part("ancestor", 1) == "e", part("ancestor", 2)).otherwise("").alias("source_id"), part("ancestor", -1).alias("ancestor_id"), part("node", -1).alias("node_id"), F.col("below").cast("int").alias("below")
    )


def p2_full_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path of every session outside loops in both forests, from the top down, joined by '/'."""
    r = stage(hierarchy.session_forest(table(spark, d, "sessions"), table(spark, d, "expected_events")))
    # the last part of a key is the id, as in node_id
    ids = F.transform("path", lambda x: F.element_at(F.split(x, hierarchy.SEP), -1))
    paths = hierarchy.full_paths(r).select("node", F.array_join(ids, "/").alias("full_path"))
    return r.join(paths, "node").select("src_table", "source_id", "node_id", "full_path")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.all_faults(
        *[table(spark, d, t) for t in ("ledger_lines", "legacy_rollouts", "session_export", "sources")]
    ).select("src_table", "row_id", "reason")


def p7_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How often each reason and field occurs in each table."""
    faults = bad_rows.all_faults(
        *[table(spark, d, t) for t in ("ledger_lines", "legacy_rollouts", "session_export", "sources")]
    )
    return faults.groupBy("src_table", "reason", "detail").agg(F.count(F.lit(1)).alias("n_rows"))


def p7_ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.valid_ledger(table(spark, d, "ledger_lines"), table(spark, d, "sources"))


def p7_session_rows(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.valid_export(table(spark, d, "session_export"))


def p7_rollout_items(spark: SparkSession, d: str) -> DataFrame:
    return bad_rows.valid_rollouts(table(spark, d, "legacy_rollouts"))


def p7_recovered(spark: SparkSession, d: str) -> DataFrame:
    """The records that can be read from rows that are not exactly one, and every fault in them with its place."""
    sources = table(spark, d, "sources")
    out = bad_rows.recovered(table(spark, d, "ledger_lines"), "ledger_lines", sources)
    for t in ("legacy_rollouts", "session_export"):
        out = out.unionByName(bad_rows.recovered(table(spark, d, t), t))
    return out


_LINKS_SQL = """
s as (
  select id as node, max_by(nullif(trim(parent_session_id), ''), (ingested_at, row_id))
           filter (where trim(coalesce(parent_session_id, '')) <> '') as parent
  from sessions where trim(coalesce(id, '')) <> '' group by id),
src as (select id as node, max_by(source_id, (ingested_at, row_id)) as source_id from sessions group by id),
ev as (
  select event_id, payload ->> '$.SourceID' as sid, payload ->> '$.NativeID' as nid,
         nullif(trim(payload ->> '$.ParentNativeID'), '') as pid, coalesce(cast(payload ->> '$.Ts' as bigint), 0) as ts
  from expected_events where kind = 'session_started'),
e as (
  select sid || chr(31) || nid as node, max_by(sid || chr(31) || pid, (ts, event_id)) filter (where pid is not null) as parent
  from ev group by all),
links as (
  select 'sessions' as src_table, node, parent from s
  union all select 'expected_events', node, parent from e),
fixed as (
  select l.src_table, l.node, p.node as parent, l.parent is not null as named
  from links l left join links p on p.src_table = l.src_table and p.node = l.parent),
walk as (
  select src_table, node, node as top, cast(0 as int) as depth from fixed where parent is null
  union all
  select f.src_table, f.node, w.top, w.depth + 1 from walk w join fixed f on f.src_table = w.src_table and f.parent = w.node)
"""

P2_FOUND_SQL = f"""with recursive {_LINKS_SQL}
select f.src_table,
  case when f.src_table = 'sessions' then src.source_id else split_part(f.node, chr(31), 1) end as source_id,
  case when f.src_table = 'sessions' then f.node else split_part(f.node, chr(31), 2) end as node_id,
  coalesce(case when f.src_table = 'sessions' then w.top else split_part(w.top, chr(31), 2) end, '') as top_id,
  coalesce(w.depth, -1) as depth
from fixed f left join walk w on w.src_table = f.src_table and w.node = f.node
left join src on f.src_table = 'sessions' and src.node = f.node
where f.named"""

P2_FULL_PATHS_SQL = f"""with recursive {_LINKS_SQL},
paths as (
  select src_table, node, case when src_table = 'sessions' then node else split_part(node, chr(31), 2) end as full_path from fixed where parent is null
  union all
  select f.src_table, f.node, p.full_path || '/' || case when f.src_table = 'sessions' then f.node else split_part(f.node, chr(31), 2) end
  from paths p join fixed f on f.src_table = p.src_table and f.parent = p.node)
select p.src_table, case when p.src_table = 'sessions' then src.source_id else split_part(p.node, chr(31), 1) end as source_id,
  case when p.src_table = 'sessions' then p.node else split_part(p.node, chr(31), 2) end as node_id, p.full_path
from paths p left join src on p.src_table = 'sessions' and src.node = p.node"""

P2_DESCENDANTS_SQL = f"""with recursive {_LINKS_SQL},
pairs as (
  select f.src_table, f.parent as up, f.node, 1 as below from fixed f join walk w on w.src_table = f.src_table and w.node = f.node where f.parent is not null
  union all
  select p.src_table, f.parent, p.node, p.below + 1 from pairs p join fixed f on f.src_table = p.src_table and f.node = p.up where f.parent is not null)
select src_table, case when src_table = 'sessions' then '' else split_part(up, chr(31), 1) end as source_id, case when src_table = 'sessions' then up else split_part(up, chr(31), 2) end as ancestor_id,
  case when src_table = 'sessions' then node else split_part(node, chr(31), 2) end as node_id, below from pairs"""

QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_kinds, p3_found, p3_rest, p3_groups, p4_found, p4_utc, p4_forms, p2_found, p2_hierarchy, p2_descendants, p2_full_paths, p7_found, p7_reasons, p7_recovered, p7_ledger_rows, p7_session_rows, p7_rollout_items)
}
QUERIES |= {f"p1_{k}_table": _consistent(t) for k, t in (("snapshot", "snapshot_files"), ("ledger", "ledger_lines"), ("rollout", "legacy_rollouts"), ("transcript", "transcript_lines"))}
QUERIES |= {f"p1_{k}_table": _consistent(t, at) for k, t, at in (
    ("snapshot_turns", "snapshot_files", "opTree.turns[]"), ("snapshot_ops", "snapshot_files", "opTree.turns[].ops[]"),
    ("ledger_ops", "ledger_lines", "turn_end.ops[]"), ("rollout_items", "legacy_rollouts", "items[]"),
)}
QUERIES |= {f"p3_{kind}s": _flat(kind) for kind in flatten.FIELDS}
QUERIES |= {f"p3_{name}": _flat(kind) for name, kind in (
    ("records", "record"), ("logs", "op.logs[]"), ("accounting", "op.accounting[]"), ("warnings", "record.warnings[]"), ("errors", "record.errors[]"),
)}
SQL: dict[str, str] = {
    "p1_found": problem_sql.P1_FOUND, "p1_kinds": problem_sql.P1_KINDS, "p2_found": P2_FOUND_SQL, "p2_full_paths": P2_FULL_PATHS_SQL, "p2_descendants": P2_DESCENDANTS_SQL, "p3_found": problem_sql.P3_FOUND,
    "p4_found": problem_sql.P4_FOUND, "p4_utc": problem_sql.P4_UTC, "p7_found": problem_sql.P7_FOUND, "p7_ledger_rows": problem_sql.P7_LEDGER_ROWS, "p7_session_rows": problem_sql.P7_SESSION_ROWS,
    "p7_rollout_items": problem_sql.P7_ROLLOUT_ITEMS, "p3_attributes": problem_sql.P3_ATTRIBUTES, "p3_rest": problem_sql.rest(flatten.COLUMNS),
}
SQL |= {f"p3_{kind}s": problem_sql.flat(kind, names) for kind, names in flatten.FIELDS.items() if kind != "attribute"}
SQL |= {f"p3_{name}": problem_sql.flat(kind, flatten.GROUPS[kind]) for name, kind in (
    ("records", "record"), ("logs", "op.logs[]"), ("accounting", "op.accounting[]"), ("warnings", "record.warnings[]"), ("errors", "record.errors[]"),
)}

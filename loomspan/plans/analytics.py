"""Queries of the analytic operators, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan import domain
from loomspan.operators import filters, graph, links, related, rollups, search, stats
from loomspan.operators.filters import SessionFilter
from loomspan.plans import adapter_sql, search_sql
from loomspan.runtime import kept_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ALL = SessionFilter(group="all", include_empty=True)
SCOPE = SessionFilter(group="all", include_empty=True, agents=("BUILDING", "MACHINERY"))
SCOPE_SQL = "select id from sessions_ where agent_name in ('BUILDING', 'MACHINERY')"
NOW = 1_790_000_000_000_000


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query and its SQL; ``sql`` may use the tables of ``domain.SQL``."""

    def add(q: Query) -> Query:
        QUERIES[q.__name__] = q
        if sql:
            head = f"with {'recursive ' if recursive else ''}{domain.SQL}"
            SQL[q.__name__] = head + (sql if sql.lstrip().startswith(",") else sql)
        return q

    return add


def plain_query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query whose SQL stands on its own."""

    def add(q: Query) -> Query:
        QUERIES[q.__name__] = q
        if sql:
            SQL[q.__name__] = sql
        return q

    return add


@query(
    f""", s as (select * from sessions_ where id in ({SCOPE_SQL})), o as (select * from ops_ where session_id in (select id from s))
select (select count(*) from s) as sessions,
  (select cast(coalesce(sum(case when end_ts > start_ts then end_ts - start_ts end), 0) as bigint) from s) as span_us,
  count(*) as ops, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out,
  cast(sum(cast(cost_usd as decimal(38, 6))) as double) as cost_usd,
  cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failures from o"""
)
def stats_totals(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return stats.totals(x.sessions, x.ops, SCOPE)


@query(", r as (select * from recorded_) select coalesce(status, '') as status, count(*) as sessions from r group by 1")
def stats_by_status(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_status(domain.recorded_sessions(spark, d).withColumn("status", F.coalesce("status", F.lit(""))))


@query(
    """select r.source_id, coalesce(s.source_format, '') as source_format, count(*) as sessions,
  cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failures
from recorded_ r left join sources s on s.id = r.source_id group by all"""
)
def stats_by_source(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_source(domain.recorded_sessions(spark, d), table(spark, d, "sources"))


@query(
    """, g as (select coalesce(agent_name, '') as agent_name, count(*) as sessions,
  cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failures from recorded_ group by 1)
select *, round(sessions / sum(sessions) over (), 9) as pct_of_sessions from g"""
)
def stats_by_agent(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_agent(domain.recorded_sessions(spark, d))


@query(
    f""", g as (select model, provider, count(*) as calls, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out,
  cast(sum(cast(cost_usd as decimal(38, 6))) as double) as cost_usd, cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failures
  from ops_ where kind = 'llm' and session_id in ({SCOPE_SQL}) group by 1, 2)
select *, round(cost_usd / sum(cost_usd) over (), 9) as pct_of_cost from g"""
)
def stats_by_model(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return stats.by_model(x.ops, filters.apply(x.sessions, SCOPE))


@query(
    f""", g as (select namespace, tool, count(*) as calls, cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failures
  from ops_ where kind = 'tool' and session_id in ({SCOPE_SQL}) group by 1, 2)
select *, round(calls / sum(calls) over (), 9) as pct_of_calls from g"""
)
def stats_by_tool(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return stats.by_tool(x.ops, filters.apply(x.sessions, SCOPE))


def _of_all(scoped: Query) -> Callable[[Query], Query]:
    """Registers the same query over the sessions of all agents, with its SQL."""

    def add(q: Query) -> Query:
        QUERIES[q.__name__] = q
        SQL[q.__name__] = SQL[scoped.__name__].replace(SCOPE_SQL, "select id from sessions_")
        return q

    return add


@_of_all(stats_totals)
def stats_totals_all(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return stats.totals(x.sessions, x.ops, ALL)


@_of_all(stats_by_model)
def stats_by_model_all(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return stats.by_model(x.ops, filters.apply(x.sessions, ALL))


@_of_all(stats_by_tool)
def stats_by_tool_all(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return stats.by_tool(x.ops, filters.apply(x.sessions, ALL))


@query(
    """select coalesce(nullif(error_class, ''), 'unknown') as error_class, count(*) as sessions
from recorded_ where status = 'failed' group by 1 order by 2 desc, 1 limit 50"""
)
def stats_by_error_class(spark: SparkSession, d: str) -> DataFrame:
    return stats.by_error_class(domain.recorded_sessions(spark, d))


@query(
    """select session_id, turn_seq, count(*) as op_count, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out,
  cast(sum(cast(cost_usd as decimal(38, 6))) as double) as cost_usd, min(start_ts) as start_ts, max(end_ts) as end_ts,
  cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failures from ops_ group by all"""
)
def turn_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return stats.turn_totals(domain.load(spark, d).ops)


@query(
    """, t as (select session_id, count(distinct turn_seq) as turn_count, count(*) as op_count, cast(sum(tokens_in) as bigint) as tokens_in,
  cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failure_count, max(end_ts) as b from ops_ group by 1)
select s.id, coalesce(turn_count, 0) as turn_count, coalesce(op_count, 0) as op_count, coalesce(tokens_in, 0) as tokens_in,
  coalesce(failure_count, 0) as failure_count, greatest(s.start_ts, s.end_ts, b) as last_activity_ts
from sessions_ s left join t on t.session_id = s.id"""
)
def session_aggregates(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return stats.session_totals(x.sessions, x.ops)


@query(
    """, e as (select 'agent' as entry, agent_name as name, start_ts from sessions_ union all select 'cwd', cwd, start_ts from sessions_
  union all select 'model', model, start_ts from ops_ union all select 'provider', provider, start_ts from ops_
  union all select 'tool', namespace || '.' || tool, start_ts from ops_ where kind = 'tool')
select entry, name, min(start_ts) as first_seen, max(start_ts) as last_seen, count(*) as uses from e where name <> '' group by all"""
)
def catalog_entries(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return stats.catalog(x.sessions, x.ops)


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return stats.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """select case when enabled = 0 then 'down' when parse_errors >= 1 then 'degraded' else 'ok' end as health,
  count(*) as n_sources, cast(sum(parse_errors) as bigint) as parse_errors from sources group by 1"""
)
def source_health(spark: SparkSession, d: str) -> DataFrame:
    return stats.health(table(spark, d, "sources"))


# ---- filters and lists ------------------------------------------------------------------------------------
LIST = SessionFilter(group="root", limit=100)


@query(
    """select id, start_ts, coalesce(agent_name, '') as agent_name, coalesce(status, '') as status from recorded_
where kind = 'root' and (op_count > 0 or turn_count > 0) and start_ts is not null order by start_ts desc, id desc limit 101"""
)
def session_list(spark: SparkSession, d: str) -> DataFrame:
    s = filters.apply(domain.recorded_sessions(spark, d).where("start_ts is not null"), LIST)
    p = filters.page(s, LIST)
    return p.select("id", "start_ts", F.coalesce("agent_name", F.lit("")).alias("agent_name"), F.coalesce("status", F.lit("")).alias("status"))


@query(
    """select id, start_ts from recorded_ where kind = 'root' and (op_count > 0 or turn_count > 0)
  and (start_ts, id) < (1760000000000000, 'a') order by start_ts desc, id desc limit 101"""
)
def session_list_next_page(spark: SparkSession, d: str) -> DataFrame:
    s = filters.apply(domain.recorded_sessions(spark, d).where("start_ts is not null"), LIST)
    return filters.page(s, LIST, after=(1_760_000_000_000_000, "a")).select("id", "start_ts")


@query(
    f""", s as (select * from recorded_ where contains(lower(agent_name), 'guard') and (op_count > 0 or turn_count > 0))
select id, case when status in ('completed', 'failed', 'cancelled', 'interrupted', 'abandoned') then status
  when coalesce(end_ts, 0) > 0 then 'completed' when {NOW} - greatest(coalesce(last_activity_ts, 0), coalesce(start_ts, 0)) > 600000000 then 'stale'
  else status end as effective_status from s"""
)
def session_effective_status(spark: SparkSession, d: str) -> DataFrame:
    f = SessionFilter(group="all", q="GUARD")
    s = filters.apply(domain.recorded_sessions(spark, d), f)
    return s.select("id", filters.effective_status(NOW).alias("effective_status"))


@query(
    """select id, agent_name from sessions_ s where status in ('failed', 'running') and kind = 'root'
  and exists (select 1 from ops_ o where o.session_id = s.id and o.kind = 'tool' and o.tool in (select min(p_type) from part))"""
)
def sessions_using_tool(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    first = table(spark, d, "part").agg(F.min("p_type")).first()[0]
    f = SessionFilter(status=("failed", "running"), tools=(first,), include_empty=True)
    return filters.apply(x.sessions, f, x.ops).select("id", "agent_name")


@query("select s.id, coalesce(n, 0) as children from sessions_ s left join (select parent_session_id as p, count(*) as n from sessions_ group by 1) c on c.p = s.id")
def session_child_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.child_counts(domain.load(spark, d).sessions)


# ---- rollups ----------------------------------------------------------------------------------------------
ROLLUP_SQL = """, f as (select o.*, s.agent_name, s.cwd, r.source_format,
    case when o.end_ts > o.start_ts then o.end_ts - o.start_ts else 0 end as took, o.start_ts - o.start_ts % 86400000000 as b
  from ops_ o join sessions_ s on s.id = o.session_id join sources_ r on r.id = s.source_id),
u as (
  select b, source_format, 'total' as dimension, '' as v, tokens_in, tokens_out, cost_usd, status, took, 1 as ops, 0 as starts from f
  union all select b, source_format, 'agent', agent_name, tokens_in, tokens_out, cost_usd, status, took, 1, 0 from f
  union all select b, source_format, 'model', model, tokens_in, tokens_out, cost_usd, status, took, 1, 0 from f where kind = 'llm'
  union all select b, source_format, 'provider', provider, tokens_in, tokens_out, cost_usd, status, took, 1, 0 from f
  union all select b, source_format, 'tool', namespace || '.' || tool, tokens_in, tokens_out, cost_usd, status, took, 1, 0 from f where kind = 'tool'
  union all select b, source_format, 'cwd', cwd, tokens_in, tokens_out, cost_usd, status, took, 1, 0 from f
  union all select s.start_ts - s.start_ts % 86400000000, r.source_format, d.dimension,
    case d.dimension when 'total' then '' when 'agent' then s.agent_name else s.cwd end, 0, 0, 0, '', 0, 0, 1
    from sessions_ s join sources_ r on r.id = s.source_id cross join (values ('total'), ('agent'), ('cwd')) d(dimension)),
daily as (select b as bucket_ts, source_format, dimension, v as dimension_value, cast(sum(ops) as bigint) as op_count,
  cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out,
  cast(sum(cast(cost_usd as decimal(38, 6))) as double) as cost_usd, cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failures,
  cast(sum(took) as bigint) as duration_us, cast(sum(starts) as bigint) as session_starts
  from u where dimension = 'total' or v <> '' group by all)
"""


def _daily(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return rollups.fold(x.ops, x.sessions, x.sources, rollups.DAY_US)


@query(ROLLUP_SQL + "select * from daily")
def rollup_daily(spark: SparkSession, d: str) -> DataFrame:
    return _daily(spark, d)


@query(
    ROLLUP_SQL
    + """, r as (select *, count(*) over w as n, row_number() over (partition by bucket_ts, source_format, dimension order by op_count desc, dimension_value) as k
  from daily window w as (partition by bucket_ts, source_format, dimension))
select bucket_ts, source_format, dimension, case when n > 3 and k >= 3 then '__other__' else dimension_value end as dimension_value,
  cast(sum(op_count) as bigint) as op_count, cast(sum(tokens_in) as bigint) as tokens_in, cast(sum(tokens_out) as bigint) as tokens_out,
  cast(sum(cast(cost_usd as decimal(38, 6))) as double) as cost_usd, cast(sum(failures) as bigint) as failures,
  cast(sum(duration_us) as bigint) as duration_us, cast(sum(session_starts) as bigint) as session_starts from r group by all"""
)
def rollup_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return rollups.collapse(_daily(spark, d), cap=3)


OPEN_AT = 870_000_000_000_000  # within the spans of the operations


@query(ROLLUP_SQL + "select * from daily")
def rollup_merged(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return rollups.merged(_daily(spark, d), x.ops, x.sessions, x.sources, rollups.DAY_US, OPEN_AT)


@query(ROLLUP_SQL + "select bucket_ts, dimension_value as key, cast(sum(cast(cost_usd as decimal(38, 6))) as double) as value from daily where dimension = 'provider' group by all")
def rollup_series(spark: SparkSession, d: str) -> DataFrame:
    return rollups.series(_daily(spark, d), "provider", "cost")


@query(ROLLUP_SQL + "select dimension_value as key, cast(sum(failures) as bigint) as value from daily where dimension = 'model' group by 1 order by 2 desc, 1 limit 20")
def rollup_top(spark: SparkSession, d: str) -> DataFrame:
    return rollups.top(_daily(spark, d), "model", "failures", filters.clamped(None, filters.TOP_DEFAULT, filters.TOP_MAX))


@query(
    ROLLUP_SQL
    + """, k as (select dimension_value as v from daily where dimension = 'tool' group by 1 order by sum(op_count) desc, 1 limit 3)
select bucket_ts, case when dimension_value in (select v from k) then dimension_value else 'other' end as key, cast(sum(failures) as bigint) as failures,
  cast(sum(op_count) as bigint) as calls, round(sum(failures) / sum(op_count), 9) as rate from daily where dimension = 'tool' group by all"""
)
def rollup_failure_rate(spark: SparkSession, d: str) -> DataFrame:
    return rollups.failure_rate(_daily(spark, d), "tool", 3)


WINDOW = SessionFilter(from_us=800_000_000_000_000, to_us=900_000_000_000_000)


@query(
    ROLLUP_SQL
    + """select bucket_ts, dimension_value as key, cast(sum(op_count) as bigint) as value from daily where dimension = 'agent' and bucket_ts >= 800000000000000 and bucket_ts < 900000000000000 group by all"""
)
def stats_series_stored(spark: SparkSession, d: str) -> DataFrame:
    """Only times are set, so closed buckets come from the stored rollup."""
    x = domain.load(spark, d)
    return rollups.aggregate(_daily(spark, d), x.ops, x.sessions, x.sources, WINDOW, rollups.DAY_US, OPEN_AT, "agent", "calls")


@query(
    ROLLUP_SQL.replace("from ops_ o join sessions_ s on s.id = o.session_id", "from ops_ o join (select * from sessions_ where status = 'failed') s on s.id = o.session_id").replace("from sessions_ s join sources_ r on r.id = s.source_id cross", "from (select * from sessions_ where status = 'failed') s join sources_ r on r.id = s.source_id cross")
    + """select bucket_ts, source_format as key, cast(sum(session_starts) as bigint) as value from daily where dimension = 'total' and bucket_ts >= 800000000000000 and bucket_ts < 900000000000000 group by all"""
)
def stats_series_filtered(spark: SparkSession, d: str) -> DataFrame:
    """A further filter is set, so everything is folded."""
    x = domain.load(spark, d)
    f = SessionFilter(from_us=WINDOW.from_us, to_us=WINDOW.to_us, status=("failed",), include_empty=True)
    return rollups.aggregate(_daily(spark, d), x.ops, x.sessions, x.sources, f, rollups.DAY_US, OPEN_AT, "source_format", "sessions")


@query(
    """select epoch_us(ts) - epoch_us(ts) % 3600000000 as bucket_ts, event_type, count(*) as n,
  cast(sum(cast(value as decimal(38, 6))) as double) as total, cast(sum(case when value < 0 then 1 else 0 end) as bigint) as negative from events group by all"""
)
def rollup_hourly_events(spark: SparkSession, d: str) -> DataFrame:
    return rollups.hourly_events(table(spark, d, "events"))


# ---- graphs -----------------------------------------------------------------------------------------------
@query(
    """, walk as (select id, id as root_id from sessions_ where parent_session_id is null
  union all select s.id, w.root_id from walk w join sessions_ s on s.parent_session_id = w.id)
select id, root_id from walk""",
    recursive=True,
)
def session_roots(spark: SparkSession, d: str) -> DataFrame:
    return graph.roots(domain.load(spark, d).sessions)


@query(
    """, walk as (select id, id as ancestor, 0 as depth from sessions_ where kind = 'root'
  union all select s.id, w.ancestor, w.depth + 1 from walk w join sessions_ s on s.parent_session_id = w.id where w.depth < 20)
select id, ancestor, depth from walk where depth > 0""",
    recursive=True,
)
def session_descendants(spark: SparkSession, d: str) -> DataFrame:
    s = domain.load(spark, d).sessions
    return graph.descendants(s, s.where("kind = 'root'"))


@query(
    """, walk as (select id, id as root_id from sessions_ where parent_session_id is null
  union all select s.id, w.root_id from walk w join sessions_ s on s.parent_session_id = w.id)
select o.session_id, o.turn_seq, o.op_seq, o.kind, o.start_ts from ops_ o join walk w on w.id = o.session_id where w.root_id = 100""",
    recursive=True,
)
def session_trace(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return graph.trace(x.ops, graph.roots(x.sessions), 100).select("session_id", "turn_seq", "op_seq", "kind", "start_ts")


@query(
    """select session_id, min(least(o.start_ts, s.start_ts)) as lane_start, max(coalesce(o.end_ts, o.start_ts)) as lane_end, count(*) as spans
from ops_ o join sessions_ s on s.id = o.session_id group by 1"""
)
def session_timeline(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return graph.timeline(x.sessions, x.ops)


@query(
    """, f as (select o.*, s.agent_name, case when o.end_ts > o.start_ts then o.end_ts - o.start_ts else 0 end as took from ops_ o join sessions_ s on s.id = o.session_id),
u as (select 'agent' as node_kind, agent_name as node, * from f union all select 'tool', tool, * from f where kind = 'tool')
select node_kind, node, count(*) as calls, cast(sum(took) as bigint) as total_us, cast(sum(cast(cost_usd as decimal(38, 6))) as double) as cost_usd,
  cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failures, max(tokens_in) as max_tokens_in from u where node <> '' group by all"""
)
def topology_nodes(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return graph.topology_nodes(x.sessions, x.ops)


@query(
    """select agent_name as source, tool as target, count(*) as calls, cast(sum(case when o.end_ts > o.start_ts then o.end_ts - o.start_ts else 0 end) as bigint) as total_us, 'calls' as edge_kind
from ops_ o join sessions_ s on s.id = o.session_id where o.kind = 'tool' and tool <> '' group by all
union all select p.agent_name, s.agent_name, count(*), 0, 'spawns' from sessions_ s join sessions_ p on p.id = s.parent_session_id group by all"""
)
def topology_edges(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return graph.topology_edges(x.sessions, x.ops)


CROSS_SQL = """, t as (select id, parent_session_id, start_ts // 2592000000000 as month from sessions_ order by month desc nulls last, id limit 500)
"""


def _cross(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = domain.load(spark, d).sessions.withColumn("month", F.floor(F.col("start_ts") / 2_592_000_000_000).cast("bigint"))
    return graph.cross_topology(s, "month")


@query(CROSS_SQL + "select id, month, (select count(*) > 500 from sessions_) as truncated, (select max(start_ts // 2592000000000) from sessions_) as max_size from t")
def cross_topology_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _cross(spark, d)[0].select("id", "month", "truncated", "max_size")


TREE_SQL = """, walk as (select id, id as root_id from sessions_ where parent_session_id is null
  union all select s.id, w.root_id from walk w join sessions_ s on s.parent_session_id = w.id),
ts as (select s.*, coalesce(nullif(agent_name, ''), kind) || case when parent_session_id is null then ' (root)' else '' end as label from sessions_ s join walk w on w.id = s.id where w.root_id = 100),
tf as (select o.*, label, case when o.end_ts > o.start_ts then o.end_ts - o.start_ts else 0 end as took from ops_ o join ts on ts.id = o.session_id)
"""


@query(
    TREE_SQL
    + """, u as (select 'agent' as node_kind, label as node, * from tf union all select 'tool', tool, * from tf where kind = 'tool')
select node_kind, node, count(*) as calls, cast(sum(took) as bigint) as total_us, cast(sum(cast(cost_usd as decimal(38, 6))) as double) as cost_usd,
  cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failures, max(tokens_in) as max_tokens_in from u where node <> '' group by all""",
    recursive=True,
)
def session_topology_nodes(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return graph.session_topology(x.sessions, x.ops, graph.roots(x.sessions), 100)[0]


@query(
    TREE_SQL
    + """select label as source, tool as target, count(*) as calls, cast(sum(took) as bigint) as total_us, 'calls' as edge_kind from tf where kind = 'tool' and tool <> '' group by all
union all select p.label, s.label, count(*), 0, 'spawns' from ts s join ts p on p.id = s.parent_session_id group by all""",
    recursive=True,
)
def session_topology_edges(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return graph.session_topology(x.sessions, x.ops, graph.roots(x.sessions), 100)[1]


@query(
    """, walk as (select id, id as ancestor, cast(null as bigint) as parent, 0 as depth, '' as path from sessions_ where kind = 'root'
  union all select s.id, w.ancestor, s.parent_session_id, w.depth + 1, w.path || '/' || s.id from walk w join sessions_ s on s.parent_session_id = w.id where w.depth < 20)
select id, ancestor, parent, depth, path from walk where depth > 0""",
    recursive=True,
)
def session_child_tree(spark: SparkSession, d: str) -> DataFrame:
    s = domain.load(spark, d).sessions
    t = graph.child_tree(s, s.where("kind = 'root'"))
    return t.withColumn("path", F.concat(F.lit("/"), F.array_join(F.transform("path", lambda x: x.cast("string")), "/")))


def _spliced(spark: SparkSession, d: str) -> DataFrame:
    """Operations of all sessions with links: by op_seq within a turn, and from the first operation of a session to its children."""
    o = domain.load(spark, d).ops.select("session_id", "turn_seq", "op_seq").distinct()
    o = o.withColumn("op_id", F.concat_ws("-", "session_id", "turn_seq", "op_seq"))
    o = o.withColumn("parent_op_id", F.when(F.col("op_seq") % 2 == 0, F.concat_ws("-", "session_id", "turn_seq", F.floor(F.col("op_seq") / 2).cast("bigint"))))
    first = o.groupBy(F.col("session_id").alias("_p")).agg(F.min("op_id").alias("_first"))
    child = domain.load(spark, d).sessions.where("parent_session_id is not null").groupBy(F.col("parent_session_id").alias("_c")).agg(F.min("id").alias("kid"))
    o = o.join(first, o["session_id"] == first["_p"]).join(child, o["session_id"] == child["_c"], "left")
    return o.withColumn("child_session_id", F.when(F.col("op_id") == F.col("_first"), F.col("kid"))).select("op_id", "session_id", "parent_op_id", "child_session_id")


@query(
    """, o0 as (select distinct session_id, turn_seq, op_seq from ops_), o1 as (select *, session_id || '-' || turn_seq || '-' || op_seq as op_id,
    case when op_seq % 2 = 0 then session_id || '-' || turn_seq || '-' || (op_seq // 2) end as parent_op_id from o0),
f as (select session_id, min(op_id) as first_ from o1 group by 1), k as (select parent_session_id as p, min(id) as kid from sessions_ where parent_session_id is not null group by 1),
sp as (select k.kid, min(f.first_) as spawn from f join k on k.p = f.session_id group by 1),
l as (select o1.op_id, o1.session_id, coalesce(p.op_id, sp.spawn) as parent from o1 left join o1 p on p.op_id = o1.parent_op_id and p.session_id = o1.session_id left join sp on sp.kid = o1.session_id),
w as (select op_id, session_id, parent, 0 as depth, op_id as root from l where parent is null union all select l.op_id, l.session_id, l.parent, w.depth + 1, w.root from w join l on l.parent = w.op_id)
select l.op_id, l.session_id, l.parent, coalesce(w.depth, -1) as depth, w.root from l left join w using (op_id)""",
    recursive=True,
)
def merged_trace(spark: SparkSession, d: str) -> DataFrame:
    """One tree of operations across sessions."""
    return graph.merged_tree(_spliced(spark, d)).select("op_id", "session_id", "parent", "depth", "root")


@query(
    """select session_id, turn_seq, min(start_ts) as start_ts, max(coalesce(end_ts, start_ts)) as end_ts, count(*) as n_ops,
  cast(sum(case when status = 'failed' then 1 else 0 end) as bigint) as failures from ops_ group by all"""
)
def trace_turns(spark: SparkSession, d: str) -> DataFrame:
    return graph.turn_rollup(domain.load(spark, d).ops)


@query(CROSS_SQL + "select p.id as source, c.id as target from t c join t p on p.id = c.parent_session_id")
def cross_topology_edges(spark: SparkSession, d: str) -> DataFrame:
    return _cross(spark, d)[1]


def _op_links(spark: SparkSession, d: str) -> DataFrame:
    """Operations of a turn numbered by supplier; each hangs below the number a third as large, if there is one."""
    o = domain.load(spark, d).ops.select("session_id", "turn_seq", "op_seq").distinct()
    return o.withColumn("parent_op_seq", F.when(F.col("op_seq") % 2 == 0, F.floor(F.col("op_seq") / 2)).cast("bigint"))


@query(
    """, o as (select distinct session_id, turn_seq, op_seq, case when op_seq % 2 = 0 then op_seq // 2 end as want from ops_),
l as (select o.session_id, o.turn_seq, o.op_seq, p.op_seq as parent from o left join o p on p.session_id = o.session_id and p.turn_seq = o.turn_seq and p.op_seq = o.want and p.op_seq < o.op_seq),
w as (select *, 0 as depth from l where parent is null
  union all select l.*, w.depth + 1 from w join l on l.session_id = w.session_id and l.turn_seq = w.turn_seq and l.parent = w.op_seq)
select session_id, turn_seq, op_seq, parent, depth from w""",
    recursive=True,
)
def op_tree(spark: SparkSession, d: str) -> DataFrame:
    return graph.op_tree(_op_links(spark, d)).drop("path")


@query(None)
def session_detail(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return graph.session_detail(x.sessions, x.ops, [100, 101, 102])


# ---- related, prices, comparison --------------------------------------------------------------------------
@query(
    """, d as (select doc_id as id, lower(trim(source)) as source_id, sha256(lower(trim(text))) as h from documents where source is not null and text is not null),
s as (select h, source_id, 'f' || length(source_id) as source_format, min(id) as first_id, count(*) as n from d group by all)
select a.h as prompt_hash, a.source_id, b.source_id as other_source_id, a.first_id, b.first_id as other_id, b.n as n_others
from s a join s b on a.h = b.h and a.source_id <> b.source_id and a.source_format <> b.source_format"""
)
def related_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """Prompts found again in another source, over the documents (the recorded hashes seldom repeat)."""
    return related.related_by_hash(*_prompts(spark, d))


def _prompts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").where("source is not null and text is not null")
    s = docs.select(F.col("doc_id").alias("id"), F.lower(F.trim("source")).alias("source_id"), F.sha2(F.lower(F.trim("text")), 256).alias("first_user_message_hash"))
    return s, s.select(F.col("source_id").alias("id"), F.concat(F.lit("f"), F.length("source_id")).alias("source_format")).distinct()


@query(
    f""", q as (select id, cwd, start_ts as s0, coalesce(end_ts, {NOW}) as s1, source_id from recorded_
  where coalesce(first_user_message_hash, '') = '' and start_ts is not null and cwd <> '' and row_id % 50 = 0),
p as (select q.id as session_id, r.id as related_id, r.start_ts - q.s0 as after_us, row_number() over (partition by q.id order by r.start_ts, r.id) as pos
  from q join recorded_ r on r.cwd = q.cwd and r.start_ts between q.s0 and q.s1 and r.id <> q.id and r.source_id <> q.source_id)
select session_id, related_id, cast(pos as int) as pos, after_us from p where pos <= 10"""
)
def related_by_time(spark: SparkSession, d: str) -> DataFrame:
    s = domain.recorded_sessions(spark, d)
    return related.related_by_time(s, s.where("row_id % 50 = 0"), NOW)


@plain_query(
    """with d as (select doc_id as id, lower(trim(source)) as source_id, sha256(lower(trim(text))) as h from documents where source is not null and text is not null)
select id, h as prompt_hash, source_id, 'f' || length(source_id) as source_format from d"""
)
def related_hash_members(spark: SparkSession, d: str) -> DataFrame:
    """Who is in which class of equal prompts."""
    s, sources = _prompts(spark, d)
    return related.hash_members(s, sources)


@query(
    f""", src as (select id, source_format from sources), h as (select r.id, first_user_message_hash as hash, r.source_id, source_format from recorded_ r join src on src.id = r.source_id where first_user_message_hash <> ''),
c as (select hash, source_id, source_format, min(id) as first_id from h group by all),
bh as (select h.id as session_id, c.first_id as related_id, 'hash' as basis, 0 as after_us from h join c on c.hash = h.hash and c.source_id <> h.source_id and c.source_format <> h.source_format
  where h.id in (select id from recorded_ where row_id % 50 = 0)),
q as (select id, cwd, start_ts as s0, coalesce(end_ts, {NOW}) as s1, source_id from recorded_ where coalesce(first_user_message_hash, '') = '' and start_ts is not null and cwd <> '' and row_id % 50 = 0),
p as (select q.id as session_id, r.id as related_id, 'time' as basis, r.start_ts - q.s0 as after_us, row_number() over (partition by q.id order by r.start_ts, r.id) as pos
  from q join recorded_ r on r.cwd = q.cwd and r.start_ts between q.s0 and q.s1 and r.id <> q.id and r.source_id <> q.source_id),
u as (select * from bh union all select session_id, related_id, basis, after_us from p where pos <= 10)
select session_id, related_id, basis, cast(row_number() over (partition by session_id order by basis, after_us, related_id) as int) as pos from u qualify pos <= 10"""
)
def related_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of relation in one list of ten."""
    s = domain.recorded_sessions(spark, d)
    return related.related(s, table(spark, d, "sources"), s.where("row_id % 50 = 0"), NOW)


def _prices(spark: SparkSession, d: str) -> DataFrame:
    """A price list made from parts: two tiers a model, from day 8,000 and day 9,500 on."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_size").alias("z"), F.min("p_partkey").alias("k"))
    tier = F.explode(F.array(F.struct(F.lit(8000).cast("bigint").alias("day"), F.lit(1).alias("f")), F.struct(F.lit(9500).cast("bigint").alias("day"), F.lit(2).alias("f"))))
    return p.select("*", F.explode(F.array(*[F.lit(f"P{i}") for i in range(4)])).alias("provider"), tier.alias("t")).select(
        "provider",
        F.array(F.lower("provider")).alias("provider_aliases"),
        F.col("p_brand").alias("model"),
        F.array(F.concat(F.col("p_brand"), F.lit("-alias"))).alias("model_aliases"),
        F.col("t.day").alias("effective_day"),
        (F.col("z") * F.col("t.f")).cast("double").alias("input_per_million"),
        (F.col("z") * F.col("t.f") * 3).cast("double").alias("output_per_million"),
        (F.col("z") * F.col("t.f") / 3).alias("cache_read_per_million"),
        (F.col("z") * F.col("t.f") * 2).cast("double").alias("cache_write_per_million"),
    )


PRICE_SQL = """, m as (select p_brand, min(p_size) as z from part group by 1),
tiers as (select lower(p_brand) as model, pr.p as provider, t.day as day, z * t.f as i, z * t.f * 3 as o
  from m cross join (values ('p0'), ('p1'), ('p2'), ('p3')) pr(p) cross join (values (8000, 1), (9500, 2)) t(day, f)),
x as (select ops_.*, tokens_in * 5 as tokens_cache_read, tokens_in % 7 as tokens_cache_write, start_ts // 86400000000 as day from ops_ where kind = 'llm'),
j as (select x.*, (select max(t.day) from tiers t where t.provider = lower(x.provider) and t.model = lower(x.model) and t.day <= x.day) as tier_day from x)
"""


def _priced(spark: SparkSession, d: str) -> DataFrame:
    return related.priced(_metered(spark, d).where("kind = 'llm'"), related.price_keys(_prices(spark, d)))


def _metered(spark: SparkSession, d: str) -> DataFrame:
    """Operations with counts of all four token classes; every third costs nothing yet."""
    o = domain.load(spark, d).ops
    return o.withColumns({"tokens_cache_read": F.col("tokens_in") * 5, "tokens_cache_write": F.col("tokens_in") % 7, "cost_usd": F.when(F.col("op_seq") % 3 == 0, 0.0).otherwise(F.col("cost_usd"))})


@query(
    PRICE_SQL
    + """select j.model, j.provider, j.tier_day, count(*) as n,
  cast(sum(cast(round(((0.0::double + tokens_in::double * i::double / 1000000::double + tokens_out::double * o::double / 1000000::double) + (tokens_in * 5)::double * (i::double / 3) / 1000000::double) + (tokens_in % 7)::double * (i * 2)::double / 1000000::double, 9) as decimal(38, 9))) as double) as priced_usd
from j left join tiers t on t.provider = lower(j.provider) and t.model = lower(j.model) and t.day = j.tier_day group by all"""
)
def price_as_of(spark: SparkSession, d: str) -> DataFrame:
    return _priced(spark, d).groupBy("model", "provider", "tier_day").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("priced_usd").cast("decimal(38,9)")).cast("double").alias("priced_usd")
    )


@query(PRICE_SQL + "select lower(provider) as provider, lower(model) as model, count(*) as n_ops from j where tier_day is null group by all")
def price_misses(spark: SparkSession, d: str) -> DataFrame:
    return related.price_misses(_priced(spark, d))


@query(
    PRICE_SQL
    + """, y as (select *, row_number() over () as rn from ops_), yd as (select *, start_ts // 86400000000 as day from y),
yt as (select yd.*, (select max(t.day) from tiers t where t.provider = lower(yd.provider) and t.model = lower(yd.model) and t.day <= yd.day) as tier_day from yd),
n as (select yt.session_id, yt.turn_seq, case when op_seq % 3 = 0 then case when kind = 'llm' and tokens_in > 0 and coalesce(yt.model, '') <> ''
    then coalesce(round(((0.0::double + tokens_in::double * i::double / 1000000::double + tokens_out::double * o::double / 1000000::double) + (tokens_in * 5)::double * (i::double / 3) / 1000000::double) + (tokens_in % 7)::double * (i * 2)::double / 1000000::double, 9), 0) else 0 end else cost_usd end as c
  from yt left join tiers t on t.provider = lower(yt.provider) and t.model = lower(yt.model) and t.day = yt.tier_day),
tc as (select session_id, turn_seq, cast(sum(cast(c as decimal(38, 6))) as double) as cost_usd from n group by all)
select session_id, cast(sum(cast(cost_usd as decimal(38, 6))) as double) as cost_usd from tc group by 1"""
)
def repriced_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Costs of sessions after operations without a price got one."""
    return related.cost_cascade(related.repriced(_metered(spark, d), related.price_keys(_prices(spark, d))))[1]


IDS = [100, 101, 200]


@query(
    """, h as (select tool, count(*) filter (where session_id = 100) as s0, count(*) filter (where session_id = 101) as s1, count(*) filter (where session_id = 200) as s2
  from ops_ where kind = 'tool' and session_id in (100, 101, 200) group by 1)
select tool, case when s0 > 0 and s1 > 0 and s2 > 0 then 'common' when s0 = 0 then 'added' when s1 = 0 and s2 = 0 then 'removed' else 'some' end as change from h"""
)
def compare_tool_changes(spark: SparkSession, d: str) -> DataFrame:
    return related.tool_changes(domain.load(spark, d).ops, IDS)


@query(
    """select min(session_id) as session_id, kind, coalesce(tool, model, '') as name from ops_ where status = 'failed' and session_id in (100, 101, 200)
group by kind, coalesce(tool, model, '') having count(distinct session_id) = 1"""
)
def compare_only_in(spark: SparkSession, d: str) -> DataFrame:
    return related.only_in(domain.load(spark, d).ops, IDS)


@query("select id, agent_name, case id when 200 then 0 when 100 then 1 else 2 end as pos from sessions_ where id in (100, 101, 200)")
def compare_in_order(spark: SparkSession, d: str) -> DataFrame:
    return links.in_order(domain.load(spark, d).sessions.select("id", "agent_name"), [200, 100, 101])


@query(
    """, h as (select tool, cast(count(*) filter (where session_id = 100) as bigint) as s0, cast(count(*) filter (where session_id = 101) as bigint) as s1,
  cast(count(*) filter (where session_id = 200) as bigint) as s2 from ops_ where kind = 'tool' and session_id in (100, 101, 200) group by 1)
select *, s0 > 0 and s1 > 0 and s2 > 0 as common from h"""
)
def compare_tools(spark: SparkSession, d: str) -> DataFrame:
    return related.tool_histogram(domain.load(spark, d).ops, IDS)


@query("select session_id, kind, count(*) as n from ops_ where session_id in (100, 101, 200) group by all")
def compare_kinds(spark: SparkSession, d: str) -> DataFrame:
    return related.kind_distribution(domain.load(spark, d).ops, IDS)


@query(
    """, x as (select s.id, case when end_ts > start_ts then end_ts - start_ts else 0 end as took,
  coalesce((select cast(sum(cast(cost_usd as decimal(38, 6))) as double) from ops_ where session_id = s.id), 0) as cost from sessions_ s where id in (100, 101, 200))
select (select id from x order by took, id limit 1) as fastest, (select id from x order by took desc, id limit 1) as slowest,
  (select id from x order by cost, id limit 1) as cheapest, (select id from x order by cost desc, id limit 1) as dearest"""
)
def compare_best_worst(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return related.best_worst(x.sessions, x.ops, IDS)


@query(
    """select kind, coalesce(tool, model, '') as name, count(distinct session_id) as n_sessions,
  min_by(session_id, (start_ts, session_id)) as example, count(distinct session_id) = 3 as in_all
from ops_ where status = 'failed' and session_id in (100, 101, 200) group by all"""
)
def compare_errors(spark: SparkSession, d: str) -> DataFrame:
    return related.common_errors(domain.load(spark, d).ops, IDS)


@query(
    """, x as (select 'agent_name' as field, coalesce(agent_name, '') as value from sessions_ where id in (100, 101, 200)
  union all select 'cwd', coalesce(cwd, '') from sessions_ where id in (100, 101, 200)
  union all select 'status', coalesce(status, '') from sessions_ where id in (100, 101, 200))
select field, count(distinct value) as n_values, min(value) as least_value, count(distinct value) = 1 as shared from x group by 1"""
)
def compare_shared(spark: SparkSession, d: str) -> DataFrame:
    return related.shared_values(domain.load(spark, d).sessions, IDS, ["agent_name", "cwd", "status"])


# ---- search -----------------------------------------------------------------------------------------------
TOKENS_SQL = """, t as (select doc_id as doc, list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from documents)
"""


@query(TOKENS_SQL + "select doc, term, count(*) as tf, len from (select doc, unnest(w) as term, len(w) as len from t where len(w) > 0) group by all")
def search_postings(spark: SparkSession, d: str) -> DataFrame:
    return search.postings(table(spark, d, "documents"), "doc_id", "text").select("doc", "term", F.col("tf").cast("bigint").alias("tf"), F.col("len").cast("bigint").alias("len"))


_DOCS_SQL = "select doc_id as doc, text from documents"
#: Opened indexes by session and table; they live as long as the session.
_INDEXES: dict[tuple[str, str, str], search.Index] = {}


def _opened(spark: SparkSession, d: str, name: str, docs: Callable[[], DataFrame]) -> search.Index:
    """The stored index of a table, written at its first use."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _INDEXES:
        path, texts = kept_path(spark, f"index-{name}"), docs()
        search.write_index(texts, "doc", "text", path)
        _INDEXES[key] = search.open_index(texts, "doc", "text", path)
    return _INDEXES[key]


def _contents(spark: SparkSession, d: str) -> search.Index:
    return _opened(spark, d, "contents", lambda: table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"))


def _found(text: str) -> str:
    return "with " + search_sql.ranked(_DOCS_SQL, search.parse_query(text), "r")


@plain_query(_found("cursor retry") + " select doc, rank from r")
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(_contents(spark, d), search.parse_query("cursor retry"))


GRAMMAR = 'cursor posit* NOT retry OR "price lookup"'


@plain_query(_found(GRAMMAR) + " select doc, rank from r")
def search_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Phrases, prefixes and every branch take part in the rank."""
    return search.ranked(_contents(spark, d), search.parse_query(GRAMMAR))


NESTED = '("cursor position" OR rollup*) AND (retry OR session NOT ledger)'


@plain_query(_found(NESTED) + " select doc, rank from r")
def search_nested(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(_contents(spark, d), search.parse_query(NESTED))


@plain_query(_found("cursor retry") + f", {search_sql.page('r', 50)} select * from r_page")
def search_page(spark: SparkSession, d: str) -> DataFrame:
    n = filters.clamped(None, filters.SEARCH_DEFAULT, filters.SEARCH_MAX)
    return search.page(_contents(spark, d), search.parse_query("cursor retry"), n).drop("snippet")


@plain_query(None)
def search_snippets(spark: SparkSession, d: str) -> DataFrame:
    return search.page(_contents(spark, d), search.parse_query(GRAMMAR), 50)


# ---- event folds, windows, parity -------------------------------------------------------------------------
from loomspan.operators import merge, parity, windows  # noqa: E402

EVENT_SQL = """, j as (select kind as event_kind, event_id as ord, nullif(payload ->> '$.SourceID', '') as source_id,
    coalesce(nullif(payload ->> '$.NativeID', ''), nullif(payload ->> '$.SessionNativeID', '')) as native_id, cast(payload ->> '$.Ts' as bigint) as ts,
    nullif(payload ->> '$.AgentName', '') as agent_name, nullif(payload ->> '$.Model', '') as model, nullif(payload ->> '$.Cwd', '') as cwd,
    nullif(payload ->> '$.ParentNativeID', '') as parent_native_id, nullif(payload ->> '$.RootNativeID', '') as root_native_id,
    nullif(payload ->> '$.Status', '') as status, cast(payload ->> '$.EndTs' as bigint) as end_ts, payload -> '$.Extras' as extras
  from expected_events),
fs as (select source_id, native_id, min(ts) filter (where event_kind = 'session_started') as start_ts, max(ts) as last_activity_ts,
    max_by(agent_name, ord) filter (where agent_name is not null) as agent_name, max_by(model, ord) filter (where model is not null) as model,
    max_by(cwd, ord) filter (where cwd is not null) as cwd, min_by(parent_native_id, ord) filter (where parent_native_id is not null) as parent_native_id,
    max_by(root_native_id, ord) filter (where root_native_id is not null) as root_native_id,
    coalesce(max_by(coalesce(status, 'running'), ord) filter (where event_kind = 'session_finalized'), 'running') as status,
    max(end_ts) filter (where ord = m) as end_ts, not bool_or(event_kind = 'session_started') as is_stub, count(*) as n_events
  from (select *, max(case when event_kind = 'session_finalized' then ord end) over (partition by source_id, native_id) as m from j) where native_id is not null group by all)
"""


@query(EVENT_SQL + "select * from fs")
def fold_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = merge.fold_sessions(merge.session_events(table(spark, d, "expected_events")))
    return s.select("source_id", "native_id", "start_ts", "last_activity_ts", "agent_name", "model", "cwd", "parent_native_id", "root_native_id", "status", "end_ts", "is_stub", "n_events")


@query(
    EVENT_SQL
    + """, i as (select *, substr(sha256(source_id || chr(31) || native_id), 1, 32) as id from fs)
select i.id, p.id as parent_session_id, r.id as root_session_id from i left join i p on p.source_id = i.source_id and p.native_id = i.parent_native_id
left join i r on r.source_id = i.source_id and r.native_id = i.root_native_id"""
)
def resolved_links(spark: SparkSession, d: str) -> DataFrame:
    s = merge.fold_sessions(merge.session_events(table(spark, d, "expected_events")))
    return merge.linked(s).select("id", "parent_session_id", "root_session_id")


@query(
    EVENT_SQL
    + """, kv as (select source_id, native_id, ord, unnest(json_keys(extras)) as k, extras from j where extras is not null and json_type(extras) = 'OBJECT')
select source_id, native_id, k as extra_key, max_by(extras ->> k, ord) as extra_value from kv where native_id is not null group by all"""
)
def merged_extras(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_extras(merge.session_events(table(spark, d, "expected_events")))


def _counter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.floor(F.col("value") * 100).cast("bigint").alias("reading"), "event_type")


COUNTER_SQL = ", c as (select user_id, event_id, epoch_us(ts) as us, cast(floor(value * 100) as bigint) as reading, event_type from events)\n"


@query(COUNTER_SQL + "select event_id, greatest(reading - coalesce(lag(reading) over (partition by user_id order by us, event_id), 0), 0) as delta from c")
def counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    return windows.cumulative_to_delta(_counter(spark, d), ["user_id"], ["us", "event_id"], "reading", "delta").select("event_id", "delta")


@query(
    COUNTER_SQL
    + """, t as (select *, sum(case when event_type = (select min(event_type) from events) then 1 else 0 end) over (partition by user_id order by us, event_id) as turn_seq from c)
select event_id, cast(turn_seq as bigint) as turn_seq, row_number() over (partition by user_id, turn_seq order by us, event_id) as op_seq from t"""
)
def synthesised_turns(spark: SparkSession, d: str) -> DataFrame:
    c = _counter(spark, d)
    first = c.agg(F.min("event_type")).first()[0]
    t = windows.numbered_turns(c.withColumn("p", F.col("event_type") == first), ["user_id"], ["us", "event_id"], "p")
    return windows.positions(t, ["user_id", "turn_seq"], ["us", "event_id"], "op_seq").select("event_id", "turn_seq", "op_seq")


@query(
    COUNTER_SQL
    + """select event_id, last_value(case when reading % 3 = 0 then reading end ignore nulls) over (partition by user_id order by us, event_id) as last_set from c"""
)
def last_set_values(spark: SparkSession, d: str) -> DataFrame:
    c = _counter(spark, d).withColumn("v", F.when(F.col("reading") % 3 == 0, F.col("reading")))
    return windows.carry_last(c, ["user_id"], ["us", "event_id"], "v", "last_set", include_row=True).select("event_id", "last_set")


@query(COUNTER_SQL + "select user_id, event_type, event_id, us from c qualify row_number() over (partition by user_id, event_type order by us, event_id) = 1")
def first_occurrences(spark: SparkSession, d: str) -> DataFrame:
    c = _counter(spark, d).select("user_id", "event_type", "event_id", "us")
    return windows.first_of(c, ["user_id", "event_type"], ["us", "event_id"])


PAIR_SQL = """, k as (select event_type, row_number() over (order by event_type) as i from (select distinct event_type from events)),
a as (select user_id, us, event_id, row_number() over (partition by user_id order by us, event_id) as nth from c join k using (event_type) where i = 1),
b as (select user_id, us, event_id, row_number() over (partition by user_id order by us, event_id) as nth from c join k using (event_type) where i = 2)
"""


@query(COUNTER_SQL + PAIR_SQL + "select a.event_id, a.nth, b.event_id as end_event_id from a left join b using (user_id, nth)")
def fifo_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = _counter(spark, d)
    kinds = sorted(r[0] for r in c.select("event_type").distinct().collect())  # the few event types
    at = lambda k: c.where(F.col("event_type") == kinds[k]).select("user_id", "us", "event_id")
    return windows.fifo_pairs(at(0), at(1), ["user_id"], ["us", "event_id"]).select("event_id", "nth", "end_event_id")


def _artifacts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as artifacts, and a derived side that lost, doubled, reclassified and changed some."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    s = o.select(
        k.alias("key"), F.col("o_orderpriority").alias("cls"), F.col("o_orderstatus").alias("availability"),
        F.sha2(k.cast("string"), 256).alias("sha256"), (k % 1000).alias("bytes"),
    )
    d_ = s.where("key % 97 <> 0").withColumn("cls", F.when(F.col("key") % 83 == 0, "other").otherwise(F.col("cls")))
    d_ = d_.withColumn("bytes", F.when(F.col("key") % 79 == 0, -1).otherwise(F.col("bytes"))).withColumn("n", F.when(F.col("key") % 71 == 0, 2).otherwise(1))
    d_ = d_.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).drop("n", "i")
    extra = s.where("key % 89 = 0").withColumn("key", F.col("key") + 1_000_000_000)
    return s, d_.unionByName(extra)


PARITY_SQL = """, s as (select o_orderkey as key, o_orderpriority as cls, o_orderkey % 1000 as bytes from orders),
f as (
  select key, case when key % 83 = 0 then 'other' else cls end as cls, 'duplicate' as code, 'derived' as field from s where key % 71 = 0 and key % 97 <> 0
  union all select key, cls, 'differs', 'bytes' from s where key % 79 = 0 and key % 97 <> 0 and key % 83 <> 0 and key % 71 <> 0
  union all select key, cls, 'missing', '' from s where key % 97 = 0
  union all select key, cls, 'class mismatch', 'other' from s where key % 83 = 0 and key % 97 <> 0
  union all select key + 1000000000, cls, 'extra', cls from s where key % 89 = 0)
"""


@query(PARITY_SQL + "select * from f")
def parity_findings(spark: SparkSession, d: str) -> DataFrame:
    return parity.findings(*_artifacts(spark, d))


@query(PARITY_SQL + "select code, cls, field, count(*) as n from f group by all")
def parity_summary(spark: SparkSession, d: str) -> DataFrame:
    return parity.summary(parity.findings(*_artifacts(spark, d)))


@query(PARITY_SQL + "select * from f order by code, key, cls, field limit 25")
def parity_sample(spark: SparkSession, d: str) -> DataFrame:
    return parity.sample(parity.findings(*_artifacts(spark, d)), 25)


# ---- source adapters --------------------------------------------------------------------------------------
from loomspan.sources import adapters, rollouts, transcripts  # noqa: E402


def _ledger_events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.get("aiagent_v3")(table(spark, d, "ledger_lines"), table(spark, d, "sources"))


def _snapshot_events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.get("aiagent_v2")(table(spark, d, "snapshot_files"), table(spark, d, "sources"))


def _transcript_events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.get("claude_code")(table(spark, d, "transcript_lines"), table(spark, d, "sources"))


_OP = ["source_id", "session", "turn_seq", "op_seq", "op_kind", "name", "namespace", "model", "provider", "child_session", "status"]
_USED = ["tokens_in", "tokens_out", "tokens_cache_read", "tokens_cache_write", "cost_usd"]


@plain_query(adapter_sql.LEDGER_EVENT_COUNTS)
def ledger_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return _ledger_events(spark, d).groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@plain_query(None)
def snapshot_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return _snapshot_events(spark, d).groupBy("source_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@plain_query(adapter_sql.TRANSCRIPT_EVENT_COUNTS)
def transcript_event_counts(spark: SparkSession, d: str) -> DataFrame:
    return _transcript_events(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@plain_query(adapter_sql.LEDGER_OPERATIONS)
def ledger_operations(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_ops(_ledger_events(spark, d)).select(*_OP, "error_message", *_USED, "bytes_in", "bytes_out", "ctx_used")


@plain_query(adapter_sql.SNAPSHOT_OPERATIONS)
def snapshot_operations(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_ops(_snapshot_events(spark, d)).select(*_OP, "error_class", *_USED)


@plain_query(adapter_sql.LEDGER_TURNS)
def ledger_turns(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_turns(_ledger_events(spark, d)).drop("error_class")


@plain_query(adapter_sql.TRANSCRIPT_OPERATIONS)
def transcript_operations(spark: SparkSession, d: str) -> DataFrame:
    o = transcripts.transcript_ops(table(spark, d, "transcript_lines"))
    return o.select("session_id", "agent", "turn_seq", "op_seq", "op_kind", "name", "namespace", "model", "line_id", "status", "error_class", *_USED[:4])


@plain_query(None)
def ledger_sessions(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_sessions(merge.wide_session_events(_ledger_events(spark, d)))


@plain_query(None)
def snapshot_sessions(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_sessions(merge.wide_session_events(_snapshot_events(spark, d)))


@plain_query(None)
def transcript_sessions(spark: SparkSession, d: str) -> DataFrame:
    return merge.fold_sessions(merge.wide_session_events(_transcript_events(spark, d)))


@plain_query(adapter_sql.LEGACY_OPERATIONS)
def legacy_operations(spark: SparkSession, d: str) -> DataFrame:
    return rollouts.legacy_ops(table(spark, d, "legacy_rollouts"))


def _logs(spark: SparkSession, d: str) -> DataFrame:
    return links.log_entries(_ledger_events(spark, d))


@plain_query(f"with {adapter_sql.LEDGER_LOGS} select * from logs")
def ledger_logs(spark: SparkSession, d: str) -> DataFrame:
    return _logs(spark, d).drop("extras")


@plain_query(f"with {adapter_sql.LEDGER_LOGS} select id, ts, severity, message from logs where severity in ('WRN', 'ERR') and ts is not null order by ts, id limit 101")
def log_list(spark: SparkSession, d: str) -> DataFrame:
    return links.log_page(_logs(spark, d), ("WRN", "ERR"), 100).select("id", "ts", "severity", "message")


@plain_query(f"with {adapter_sql.LEDGER_LOGS} select id, ts from logs where severity = 'ERR' and (ts, id) > (1740000000000000, 'a') order by ts, id limit 101")
def log_list_next_page(spark: SparkSession, d: str) -> DataFrame:
    return links.log_page(_logs(spark, d), ("ERR",), 100, (1_740_000_000_000_000, "a")).select("id", "ts")


def _some_logs(spark: SparkSession, d: str) -> DataFrame:
    """Log entries that name a source, or only a session, or neither, or belong to a source itself."""
    s = domain.recorded_sessions(spark, d).where("error_message <> ''")
    k = F.col("row_id") % 4
    return s.select(
        F.col("id").alias("log_id"), F.when(k < 3, F.col("id")).alias("session_id"), F.when((k == 0) | (k == 3), F.col("source_id")).alias("source_id"), F.coalesce("start_ts", F.lit(NOW)).alias("ts"),
        F.when(k == 1, "WRN").otherwise("ERR").alias("severity"), F.col("error_message").alias("message"),
    )


SOME_LOGS_SQL = f""", sl as (select id as log_id, case when row_id % 4 < 3 then id end as session_id, case when row_id % 4 in (0, 3) then source_id end as source_id, coalesce(start_ts, {NOW}) as ts,
  case row_id % 4 when 1 then 'WRN' else 'ERR' end as severity from recorded_ where error_message <> '')
"""


@query(SOME_LOGS_SQL + "select l.log_id, coalesce(l.source_id, r.source_id) as source_id, s.source_format from sl l left join recorded_ r on r.id = l.session_id join sources s on s.id = coalesce(l.source_id, r.source_id)")
def placed_logs(spark: SparkSession, d: str) -> DataFrame:
    return links.placed_logs(_some_logs(spark, d), domain.recorded_sessions(spark, d), table(spark, d, "sources")).select("log_id", "source_id", "source_format")


@query(SOME_LOGS_SQL + f"select source_id, count(*) as n from sl where source_id is not null and session_id is null and severity = 'ERR' and ts > {NOW} - 3600000000 and ts <= {NOW} group by 1")
def recent_source_errors(spark: SparkSession, d: str) -> DataFrame:
    return links.recent_source_errors(_some_logs(spark, d), NOW)


def _spawns(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Operations that name a child or a call, and sessions to be found by either."""
    x = domain.load(spark, d)
    s = x.sessions.select(
        "id", "source_id", F.col("id").cast("string").alias("native_id"), F.when(F.col("id") % 3 > 0, F.col("parent_session_id")).alias("parent_session_id"),
        F.col("parent_session_id").cast("string").alias("parent_native_id"), F.concat(F.lit("t"), F.col("id") % 40).alias("tool_use_id"),
    )
    o = x.ops.groupBy("session_id", "turn_seq").agg(F.min("op_seq").alias("op_seq"))
    k = F.col("session_id") + F.col("turn_seq")
    return o.select(
        "session_id", "turn_seq", "op_seq", F.when(k % 11 == 0, F.col("session_id")).alias("child_session_id"), F.when(k % 2 == 0, (k + 1).cast("string")).alias("child_native_id"),
        F.concat(F.lit("t"), k % 40).alias("tool_use_id"),
    ), s


SPAWN_SQL = """, so as (select session_id, turn_seq, min(op_seq) as op_seq, session_id + turn_seq as k from ops_ group by all),
o as (select session_id, turn_seq, op_seq, case when k % 11 = 0 then session_id end as child_session_id, case when k % 2 = 0 then cast(k + 1 as varchar) end as child_native_id, 't' || (k % 40) as tool_use_id from so),
c as (select id, source_id, cast(id as varchar) as native_id, case when id % 3 > 0 then parent_session_id end as parent_session_id, cast(parent_session_id as varchar) as parent_native_id, 't' || (id % 40) as tool_use_id from sessions_),
linked as (select o.session_id, o.turn_seq, o.op_seq, coalesce(o.child_session_id,
  (select min(c.id) from c where c.source_id = p.source_id and c.native_id = o.child_native_id),
  (select min(c.id) from c where c.source_id = p.source_id and c.tool_use_id = o.tool_use_id and c.id <> p.id and (c.parent_session_id = p.id or c.parent_native_id = p.native_id))) as child_session_id
  from o left join c p on p.id = o.session_id)
"""


@query(SPAWN_SQL + "select * from linked")
def op_child_sessions(spark: SparkSession, d: str) -> DataFrame:
    return links.child_sessions(*_spawns(spark, d)).select("session_id", "turn_seq", "op_seq", "child_session_id")


@query(
    SPAWN_SQL
    + """select l.session_id, l.turn_seq, l.op_seq, 'op' as kind, s.source_id, r.source_format, s.agent_name, s.kind as session_kind, count(*) over (partition by l.session_id, l.turn_seq) as turn_ops, l.child_session_id, c2.agent_name as child_agent
from linked l join sessions_ s on s.id = l.session_id join sources_ r on r.id = s.source_id left join sessions_ c2 on c2.id = l.child_session_id"""
)
def op_details(spark: SparkSession, d: str) -> DataFrame:
    x = domain.load(spark, d)
    return links.op_details(links.child_sessions(*_spawns(spark, d)).withColumn("kind", F.lit("op")), x.sessions, x.sources)


@plain_query(f"with recursive {adapter_sql.LEDGER_REFS} select source_id, session, turn_seq, op_seq, min_by(payload_kind, (payload_kind, location)) as payload_kind, min_by(location, (payload_kind, location)) as location from refs where payload_kind is not null and location is not null group by all")
def first_payloads(spark: SparkSession, d: str) -> DataFrame:
    refs = merge.payload_refs(_ledger_events(spark, d)).where("payload_kind is not null and location is not null").select("source_id", "session", "turn_seq", "op_seq", "payload_kind", "location")
    return links.first_payloads(refs, ["source_id", "session", "turn_seq", "op_seq"], ["payload_kind", "location"])


@plain_query(f"with recursive {adapter_sql.LEDGER_REFS} select source_id, session, turn_seq, op_seq, count(*) as n_payloads, cast(sum(bytes) as bigint) as bytes from (select distinct on (source_id, session, turn_seq, op_seq, coalesce(payload_kind, ''), coalesce(location, '')) * from refs order by source_id, session, turn_seq, op_seq, coalesce(payload_kind, ''), coalesce(location, ''), bytes nulls last) group by all")
def op_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads joined to their operations, by operation."""
    ev = _ledger_events(spark, d)
    key = ["source_id", "session", "turn_seq", "op_seq"]
    refs = ev.where("kind = 'payload_ref'").groupBy(*key, F.coalesce("payload_kind", F.lit("")).alias("k"), F.coalesce("location", F.lit("")).alias("l")).agg(F.min("bytes_in").alias("bytes_in"))
    return refs.join(merge.fold_ops(ev).select(*key), key).groupBy(*key).agg(F.count(F.lit(1)).alias("n_payloads"), F.sum("bytes_in").alias("bytes"))


@plain_query("select 'sources' as table_name, count(*) as n_rows from sources union all select 'sessions', count(*) from sessions union all select 'ledger_lines', count(*) from ledger_lines")
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    return links.table_counts({t: table(spark, d, t) for t in ("sources", "sessions", "ledger_lines")})


def _scopes(spark: SparkSession, d: str) -> dict[str, search.Index]:
    def ops() -> DataFrame:
        o = merge.fold_ops(_ledger_events(spark, d)).withColumnRenamed("op_kind", "kind").withColumnRenamed("name", "tool").withColumnRenamed("error_message", "error_text")
        key = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source_id", "session", "turn_seq", "op_seq")])
        return o.select(key.alias("doc"), search.op_document(o).alias("text"))

    def logs() -> DataFrame:
        return search.logged(_logs(spark, d).select(F.col("id").alias("doc"), "source_id", F.col("message").alias("text")), table(spark, d, "sources")).select("doc", "text")

    return {"op": _opened(spark, d, "ops", ops), "log": _opened(spark, d, "logs", logs), "content": _contents(spark, d)}


EVERYWHERE = "tool OR retr* OR (session failed)"
_EVERY = search.parse_query(EVERYWHERE)
_SCOPES_SQL = f"""with recursive {adapter_sql.LEDGER_LOGS}, {adapter_sql.LEDGER_OPS_FOLDED},
dop as (select concat_ws('/', coalesce(source_id, ''), coalesce(session, ''), turn_seq, op_seq) as doc, concat_ws(' ', op_kind, model, provider, namespace, name, error_message) as text from folded),
dlog as (select l.id as doc, message as text from logs l join sources s on s.id = l.source_id where s.fts5_index_logs = 1),
{search_sql.ranked('select * from dop', _EVERY, 'ro')}, {search_sql.page('ro', 50)}, {search_sql.ranked('select * from dlog', _EVERY, 'rl')}, {search_sql.page('rl', 50)},
{search_sql.ranked(_DOCS_SQL, _EVERY, 'rc')}, {search_sql.page('rc', 50)},
pages as (select 'op' as scope, doc, rank, has_more from ro_page union all select 'log', doc, rank, has_more from rl_page union all select 'content', cast(doc as varchar), rank, has_more from rc_page)
"""


@plain_query(_SCOPES_SQL + "select scope, doc, rank, (select bool_or(has_more) from pages) as has_more from pages")
def search_all(spark: SparkSession, d: str) -> DataFrame:
    """Operations, logs and contents in one answer."""
    return search.envelope(_scopes(spark, d), _EVERY, 50).drop("snippet")


@plain_query(_SCOPES_SQL + "select doc, rank from rl")
def search_logs(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(_scopes(spark, d)["log"], _EVERY)


@plain_query(_SCOPES_SQL + "select doc, rank from ro")
def search_ops(spark: SparkSession, d: str) -> DataFrame:
    return search.ranked(_scopes(spark, d)["op"], _EVERY)


# ---- further lists ----------------------------------------------------------------------------------------
@query(
    """select id, case when coalesce(tokens_cache_read, 0) + coalesce(tokens_in, 0) + coalesce(tokens_cache_write, 0) > 0
  then round(coalesce(tokens_cache_read, 0) / (coalesce(tokens_cache_read, 0) + coalesce(tokens_in, 0) + coalesce(tokens_cache_write, 0)), 9) end as hit_rate from recorded_"""
)
def session_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    return domain.recorded_sessions(spark, d).select("id", stats.cache_hit_rate("tokens_cache_read", "tokens_in", "tokens_cache_write").alias("hit_rate"))


@query(
    """, a as (select source_id, count(*) as sessions, max(last_activity_ts) as last_activity_ts from recorded_ group by 1)
select s.id, s.source_format, s.enabled, coalesce(a.sessions, 0) as sessions, a.last_activity_ts from sources s left join a on a.source_id = s.id"""
)
def source_list(spark: SparkSession, d: str) -> DataFrame:
    return stats.source_list(table(spark, d, "sources"), domain.recorded_sessions(spark, d))


@query(
    """select s.id, s.kind, p.kind as parent_kind, r.kind as root_kind from recorded_ s
left join recorded_ p on p.id = s.parent_session_id left join recorded_ r on r.id = s.root_session_id"""
)
def session_lineage(spark: SparkSession, d: str) -> DataFrame:
    return stats.lineage(domain.recorded_sessions(spark, d))


@query(COUNTER_SQL + "select event_id, lead(us) over (partition by user_id order by us, event_id) as superseded_us from c")
def superseded_turns(spark: SparkSession, d: str) -> DataFrame:
    return windows.next_value(_counter(spark, d), ["user_id"], ["us", "event_id"], "us", "superseded_us").select("event_id", "superseded_us")


@query(
    """select session_id, turn_seq, max_by(status, (start_ts, op_seq, status)) as last_status, max(start_ts) as last_start
from ops_ where kind = 'llm' group by all"""
)
def last_model_operations(spark: SparkSession, d: str) -> DataFrame:
    o = domain.load(spark, d).ops.where("kind = 'llm'")
    x = windows.last_of(o, ["session_id", "turn_seq"], ["start_ts", "op_seq", "status"], ["status", "start_ts"])
    return x.select("session_id", "turn_seq", F.col("status").alias("last_status"), F.col("start_ts").alias("last_start"))


@query("select doc, term, count(*) as tf, len from (select doc_id as doc, unnest(w) as term, len(w) as len from (select doc_id, list_filter(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') as w from documents) where len(w) > 0) group by all")
def search_reindexed(spark: SparkSession, d: str) -> DataFrame:
    """An index of outdated texts, brought up to date: equal to one made anew."""
    docs = table(spark, d, "documents")
    old = search.postings(docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.lit("an older text")).otherwise(F.col("text"))), "doc_id", "text")
    new = search.reindexed(old, docs.where("doc_id % 7 = 0"), "doc_id", "text")
    return new.select("doc", "term", F.col("tf").cast("bigint").alias("tf"), F.col("len").cast("bigint").alias("len"))


@query("select o_orderkey as key, o_orderstatus as availability from orders where o_orderpriority = '1-URGENT' and o_orderstatus not in ('present', 'truncated', 'redacted', 'F')")
def parity_disallowed(spark: SparkSession, d: str) -> DataFrame:
    s, _ = _artifacts(spark, d)
    s = s.where("cls = '1-URGENT'").withColumn("cls", F.lit("payload")).withColumn("availability", F.when(F.col("availability") == "F", "present").otherwise(F.col("availability")))
    return parity.disallowed(s).select("key", "availability")

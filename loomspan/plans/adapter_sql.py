"""SQL that derives turns, operations and sessions from the raw tables in its own way."""

from __future__ import annotations

from loomspan.plans.problem_sql import _ITEMS, _LEDGER_NODES, _SNAPSHOT_NODES, LEDGER, ROLLOUTS


def _n(c: str) -> str:
    """A whole number: of digits in a text, or the whole part of a number; else 0."""
    return (
        f"coalesce(case when json_type({c}) = 'VARCHAR' and regexp_full_match(trim({c} ->> '$'), '[+-]?[0-9]+') then try_cast(trim({c} ->> '$') as bigint) when json_type({c}) in ('UBIGINT', 'BIGINT') then try_cast({c} ->> '$' as bigint)"
        f" when json_type({c}) = 'DOUBLE' then try_cast(trunc(cast({c} ->> '$' as double)) as bigint) when json_type({c}) = 'BOOLEAN' then case when {c} ->> '$' = 'true' then 1 else 0 end end, 0)"
    )


def _at(j: str, path: str) -> str:
    return f"json_extract({j}, '$.{path}')"


def _w(j: str, path: str) -> str:
    return f"nullif({_at(j, path)} ->> '$', '')"


def _status(c: str) -> str:
    return f"case coalesce({c}, '') when 'ok' then 'completed' when '' then 'running' else {c} end"


_TOKENS = (("tokens_in", "tokensIn"), ("tokens_out", "tokensOut"), ("tokens_cache_read", "tokensCacheRead"), ("tokens_cache_write", "tokensCacheWrite"))
#: Operations of ledgers, one row per mention; ``ord`` is the order of arrival.
LEDGER_OPS = f"""lm as (select lg.source_id, lg.file_name, coalesce(lg.line_no, 0) as line_no, nullif(lg.sessionid ->> '$', '') as session, lg.turn_n as turn_seq, lo.k, lo.j, row_number() over (partition by lg.row_id order by lo.k) - 1 as i
    from lo join lg using (row_id)),
lops as (select source_id, session, turn_seq, case when coalesce(json_type({_at('j', 'opIndex')}), 'NULL') = 'NULL' then i else {_n(_at('j', 'opIndex'))} end as op_seq, (file_name, line_no, k) as ord,
    {_w('j', 'kind')} as op_kind, {_w('j', 'name')} as name, {_w('j', 'model')} as model, {_w('j', 'provider')} as provider, case when {_w('j', 'kind')} = 'tool' then {_w('j', 'provider')} end as namespace,
    list_filter(case when json_type({_at('j', 'childSessions')}) = 'ARRAY' then cast({_at('j', 'childSessions')} as json[]) else [] end, lambda x: json_type(x) = 'OBJECT')[1] as kid,
    {_status(_w('j', 'status'))} as status, {_w('j', 'error')} as error_message, {', '.join(f"{_n(_at('j', 'accounting.' + b))} as {a}" for a, b in _TOKENS)}, coalesce(try_cast({_at('j', 'accounting.costUsd')} ->> '$' as double), 0) as cost_usd,
    list_filter(case when json_type({_at('j', 'payloadRefs')}) = 'ARRAY' then cast({_at('j', 'payloadRefs')} as json[]) else [] end, lambda x: json_type(x) = 'OBJECT') as refs from lm)"""

_BYTES = "list_sum(list_transform(list_filter(refs, lambda x: list_contains([{kinds}], x ->> '$.kind')), lambda x: {n}))"
_REQ, _RES = "'llm_request', 'sdk_request', 'tool_request'", "'llm_response', 'sdk_response', 'reasoning_stream', 'tool_response'"
LEDGER_OPERATIONS = f"""with recursive {LEDGER}, {_SNAPSHOT_NODES}, {_LEDGER_NODES}, {LEDGER_OPS}
select source_id, session, turn_seq, op_seq, arg_max_null(op_kind, ord) as op_kind, arg_max_null(name, ord) as name, max_by(namespace, ord) filter (where namespace is not null) as namespace, max_by(model, ord) filter (where model is not null) as model,
  max_by(provider, ord) filter (where provider is not null) as provider, min_by(nullif(kid ->> '$.sessionId', ''), ord) filter (where nullif(kid ->> '$.sessionId', '') is not null) as child_session,
  max_by(status, ord) as status, arg_max_null(error_message, ord) as error_message, {', '.join(f'max_by({a}, ord) as {a}' for a, _ in _TOKENS)}, max_by(cost_usd, ord) as cost_usd,
  nullif(max_by(coalesce({_BYTES.format(kinds=_REQ, n=_n("json_extract(x, '$.originalBytes')"))}, 0), ord), 0)::bigint as bytes_in, nullif(max_by(coalesce({_BYTES.format(kinds=_RES, n=_n("json_extract(x, '$.originalBytes')"))}, 0), ord), 0)::bigint as bytes_out,
  nullif(max_by(tokens_in + tokens_out + tokens_cache_read + tokens_cache_write, ord), 0) as ctx_used
from lops group by all"""

LEDGER_TURNS = f"""with {LEDGER},
e as (select source_id, nullif(sessionid ->> '$', '') as session, turn_n as turn_seq, kind, ts_us, (file_name, coalesce(line_no, 0)) as ord, {_status("nullif(status ->> '$', '')")} as state, cast(t as json) as j from lg where reason = '' and kind in ('turn_start', 'turn_end'))
select source_id, session, turn_seq, coalesce(min(ts_us) filter (where kind = 'turn_start'), min(ts_us)) as start_ts, coalesce(max_by(state, ord) filter (where kind = 'turn_end'), 'running') as status,
  max_by(ts_us, ord) filter (where kind = 'turn_end') as end_ts, {', '.join(f"max_by({_n(_at('j', 'accounting.' + b))}, ord) filter (where kind = 'turn_end') as {a}" for a, b in _TOKENS[:2])},
  max_by(coalesce(try_cast({_at('j', 'accounting.costUsd')} ->> '$' as double), 0), ord) filter (where kind = 'turn_end') as cost_usd from e group by all"""

#: Operations of snapshots, with the reasoning ones behind those of their turn.
SNAPSHOT_OPERATIONS = f"""with recursive {_SNAPSHOT_NODES},
t as (select st.*, row_number() over (partition by row_id, parent, part order by k) - 1 as i from st),
m as (select f.source_id, f.file_name, f.row_id, {_w('sn.j', 'traceId')} as session, case when coalesce(json_type({_at('t.j', 'index')}), 'NULL') = 'NULL' then t.i else {_n(_at('t.j', 'index'))} end + case t.part when 'steps' then 10000 else 0 end as turn_seq,
    row_number() over (partition by so.row_id, so.parent order by so.k) - 1 as op_seq, count(*) over (partition by so.row_id, so.parent) as n_ops, so.path, so.parent, so.k, so.j,
    list_filter(case when json_type({_at('so.j', 'accounting')}) = 'ARRAY' then cast({_at('so.j', 'accounting')} as json[]) else [] end, lambda x: json_type(x) = 'OBJECT')[1] as acc
  from so join t on t.row_id = so.row_id and t.path = so.parent join sn on sn.row_id = so.row_id and sn.path = t.parent join snapshot_files f on f.row_id = so.row_id),
a as (select *, case when acc ->> '$.type' = 'llm' then acc end as llm, {_w('j', 'kind')} as kind, {_w('j', 'attributes.provider')} as ap from m),
u as (select *, {_n("json_extract(llm, '$.tokens.inputTokens')")} as ti, {_n("json_extract(llm, '$.tokens.outputTokens')")} as to_, {_n("json_extract(llm, '$.tokens.cacheWriteInputTokens')")} as tw,
    coalesce(nullif({_n("json_extract(llm, '$.tokens.cacheReadInputTokens')")}, 0), {_n("json_extract(llm, '$.tokens.cachedTokens')")}) as tr from a),
o as (select source_id, session, turn_seq, op_seq, (file_name, path, 0) as ord, kind as op_kind, coalesce({_w('j', 'attributes.name')}, case when kind = 'system' then {_w('j', 'attributes.label')} end) as name,
    case when kind = 'tool' then ap end as namespace, coalesce({_w('j', 'attributes.model')}, llm ->> '$.model') as model, coalesce(ap, nullif(acc ->> '$.provider', '')) as provider,
    case when json_type({_at('j', 'childSession')}) = 'OBJECT' then {_w('j', 'childSession.traceId')} else {_w('j', 'childSessionRef.sessionId')} end as child_session, {_status(_w('j', 'status'))} as status,
    case when json_type({_at('j', 'attributes.error')}) = 'VARCHAR' then {_w('j', 'attributes.error')} end as error_class, ti as tokens_in, to_ as tokens_out, tr as tokens_cache_read, tw as tokens_cache_write,
    case when json_type(llm, '$.tokens') = 'OBJECT' then coalesce(try_cast(json_extract(llm, '$.costUsd') ->> '$' as double), 0) else 0 end as cost_usd from u
  union all select source_id, session, turn_seq, n_ops + row_number() over (partition by row_id, parent order by k) - 1, (file_name, path, 1), 'reasoning', null, null, null, null, null, {_status(_w('j', 'status'))}, null, 0, 0, 0, 0, 0
    from u where kind = 'llm' and {_w('j', 'reasoning.final')} is not null)
select source_id, session, turn_seq, op_seq, arg_max_null(op_kind, ord) as op_kind, arg_max_null(name, ord) as name, max_by(namespace, ord) filter (where namespace is not null) as namespace, max_by(model, ord) filter (where model is not null) as model,
  max_by(provider, ord) filter (where provider is not null) as provider, min_by(child_session, ord) filter (where child_session is not null) as child_session, max_by(status, ord) as status, arg_max_null(error_class, ord) as error_class,
  max_by(tokens_in, ord) as tokens_in, max_by(tokens_out, ord) as tokens_out, max_by(tokens_cache_read, ord) as tokens_cache_read, max_by(tokens_cache_write, ord) as tokens_cache_write, max_by(cost_usd, ord) as cost_usd
from o group by all"""

_LINES = """tl as (select session_id, coalesce(agent_id, '') as agent, line_id, source_id, line_timestamp, lower(trim(line_type)) as kind, coalesce(is_meta, false) as meta, coalesce(is_compact_summary, false) as compact, subtype, cwd, cast(message as json) as j
  from transcript_lines qualify row_number() over (partition by session_id, coalesce(uuid, cast(line_id as varchar)) order by line_id) = 1),
ln as (select *, kind = 'user' and not meta and not compact as heard, kind = 'assistant' and coalesce(j ->> '$.model', '') not in ('', '<synthetic>') as spoken,
  coalesce(json_type(j, '$.content') = 'VARCHAR' and trim(j ->> '$.content') <> '', false) as plain, case when json_type(j, '$.content') = 'ARRAY' then cast(json_extract(j, '$.content') as json[]) else [] end as blocks from tl),
bl as (select session_id, agent, line_id, source_id, heard, spoken, b, i - 1 as i, b ->> '$.type' as type from (select *, unnest(blocks) as b, generate_subscripts(blocks, 1) as i from ln)),
om as (
  select session_id, agent, line_id, source_id, 0 as rank_, 0 as i, 'internal' as op_kind, 'user_input' as name, cast(null as varchar) as call, cast(null as json) as j, true as p from ln where heard and plain
  union all select session_id, agent, line_id, source_id, 0, i, 'internal', 'user_input', null, null, false from bl where heard and type in ('text', 'image')
  union all select session_id, agent, line_id, source_id, 0, 0, 'llm', j ->> '$.model', null, j, false from ln where spoken
  union all select session_id, agent, line_id, source_id, 1, i, 'reasoning', null, null, null, false from bl where spoken and type = 'thinking'
  union all select session_id, agent, line_id, source_id, 2, i, case b ->> '$.name' when 'Agent' then 'session' else 'tool' end, b ->> '$.name', b ->> '$.id', null, false from bl where spoken and type = 'tool_use'),
ot as (select *, sum(case when p then 1 else 0 end) over (partition by session_id, agent order by line_id, rank_, i) as n from om),
oe as (select *, n + case when min(n) over (partition by session_id, agent) = 0 then 1 else 0 end as turn_seq from ot),
oq as (select *, row_number() over (partition by session_id, agent, turn_seq order by line_id, rank_, i) as op_seq from oe),
rs as (select session_id, agent, b ->> '$.tool_use_id' as call, min_by(coalesce(b ->> '$.is_error' = 'true', false), (line_id, i)) as bad from bl where heard and type = 'tool_result' and b ->> '$.tool_use_id' is not null group by all)"""

TRANSCRIPT_OPERATIONS = f"""with {_LINES}
select q.session_id, q.agent, cast(turn_seq as bigint) as turn_seq, op_seq, op_kind, case when op_kind = 'tool' then coalesce(nullif(regexp_extract(name, '^mcp__.+?__(.+)$', 1), ''), name) else name end as name,
  case when op_kind in ('tool', 'session') then case when regexp_extract(name, '^mcp__(.+?)__', 1) <> '' then 'mcp:' || regexp_extract(name, '^mcp__(.+?)__', 1) else 'builtin' end end as namespace,
  case when op_kind = 'llm' then name end as model, line_id, case when op_kind not in ('tool', 'session') then 'completed' when r.bad then 'failed' when r.bad is not null then 'completed' else 'running' end as status,
  case when op_kind in ('tool', 'session') and r.bad then 'tool_error' end as error_class,
  {', '.join(f"case when op_kind = 'llm' then coalesce(try_cast(j ->> '$.usage.{b}' as bigint), 0) else 0 end as {a}" for a, b in (('tokens_in', 'input_tokens'), ('tokens_out', 'output_tokens'), ('tokens_cache_read', 'cache_read_input_tokens'), ('tokens_cache_write', 'cache_creation_input_tokens')))}
from oq q left join rs r on r.session_id = q.session_id and r.agent = q.agent and r.call = q.call"""

TRANSCRIPT_EVENT_COUNTS = f"""with {_LINES},
tn as (select session_id, agent, turn_seq, min_by(op_kind, op_seq) as first_kind from oq group by all),
fin as (select q.*, r.bad from oq q left join rs r on r.session_id = q.session_id and r.agent = q.agent and r.call = q.call),
k as (
  select 'session_started' as kind, count(*) as n from (select distinct session_id, agent from ln) union all select 'session_updated', count(*) from (select distinct session_id, agent from ln where spoken)
  union all select 'turn_started', count(*) from tn where first_kind = 'internal' union all select 'turn_finalized', count(*) from tn where exists (select 1 from tn x where x.session_id = tn.session_id and x.agent = tn.agent and x.turn_seq = tn.turn_seq + 1)
  union all select 'op_started', count(*) from oq union all select 'op_finalized', count(*) from fin where op_kind not in ('tool', 'session') or bad is not null
  union all select 'payload_ref', count(*) filter (where op_kind <> 'llm') + count(*) filter (where bad is not null and op_kind in ('tool', 'session')) from fin
  union all select 'log_entry', count(*) from ln where (kind = 'user' and (meta or compact)) or (kind = 'assistant' and not spoken) or kind = 'system')
select * from k where n > 0"""

#: logs: each entry of a ledger once.
LEDGER_LOGS = f"""{LEDGER},
le as (select source_id, nullif(sessionid ->> '$', '') as session, kind, turn_n, ts_us, cast(t as json) as j from lg where reason = ''),
lm0 as (select source_id, session, turn_n as turn_seq, ts_us as ts, case part when 'warnings' then 'WRN' else 'ERR' end as severity, nullif(unnest(cast(json_extract(j, '$.' || part) as json[])) ->> '$', '') as message
    from le, (values ('warnings'), ('errors')) v(part) where kind = 'turn_end' and json_type(j, '$.' || part) = 'ARRAY'
  union all select source_id, session, null, ts_us, 'ERR', j ->> '$.error' from le where kind = 'session_summary' and j ->> '$.status' = 'failed' and nullif(j ->> '$.error', '') is not null
  union all select source_id, session, null, ts_us, 'ERR', nullif(j ->> '$.error', '') from le where kind = 'session_error'),
logs as (select distinct substr(sha256(concat_ws(chr(31), coalesce(source_id, ''), coalesce(session, ''), coalesce(cast(turn_seq as varchar), ''), '', coalesce(cast(ts as varchar), ''), severity, coalesce(message, ''))), 1, 32) as id,
  source_id, session, turn_seq, cast(null as bigint) as op_seq, ts, severity, message from lm0)"""

LEDGER_OPS_FOLDED = f"{_SNAPSHOT_NODES}, {_LEDGER_NODES}, {LEDGER_OPS}, folded as ({LEDGER_OPERATIONS[LEDGER_OPERATIONS.rindex('select source_id, session, turn_seq, op_seq'):]})"

#: refs: payloads of operations in ledgers, as often as they are mentioned.
LEDGER_REFS = f"""{LEDGER}, {_SNAPSHOT_NODES}, {_LEDGER_NODES}, {LEDGER_OPS},
refs as (select source_id, session, turn_seq, op_seq, nullif(r ->> '$.kind', '') as payload_kind, nullif(r ->> '$.path', '') as location,
    case when coalesce(json_type(r, '$.originalBytes'), 'NULL') <> 'NULL' then {_n("json_extract(r, '$.originalBytes')")} end as bytes from (select *, unnest(refs) as r from lops))"""

_BAD = """case when regexp_matches(lower(coalesce(item ->> '$.output', '')), 'denied by sandbox|operation not permitted|sandbox deny') then 'sandbox_denied'
  when regexp_matches(lower(coalesce(item ->> '$.output', '')), '"error"|exit code 1|command failed|^error:') then 'tool_error' end"""
LEGACY_OPERATIONS = f"""with {ROLLOUTS}, i as ({_ITEMS}),
o as (select source_id, file_name, item_no, min_by(session_id, row_id) as session_id, min_by(item, row_id) as item from i group by all),
k as (select *, item ->> '$.type' as ptype, item ->> '$.name' as name, item ->> '$.call_id' as call_id, {_BAD} as bad,
    case when item ->> '$.type' = 'message' and item ->> '$.role' = 'user' then 'internal' when item ->> '$.type' = 'message' and item ->> '$.role' = 'assistant' then 'llm' when item ->> '$.type' = 'reasoning' then 'reasoning'
      when item ->> '$.type' in ('function_call', 'custom_tool_call', 'local_shell_call', 'tool_search_call') then 'tool' end as op_kind from o),
n as (select *, row_number() over (partition by source_id, file_name order by item_no) as op_seq from k where op_kind is not null),
r as (select source_id, file_name, call_id, min_by(struct_pack(b := bad), item_no).b as bad from k where ptype in ('function_call_output', 'custom_tool_call_output') group by all)
select n.source_id, n.file_name, n.session_id, 1 as turn_seq, op_seq, op_kind, name, case when op_kind = 'tool' then case when ptype in ('custom_tool_call', 'tool_search_call') then 'custom' when ptype = 'local_shell_call' then 'shell'
    when coalesce(name, '') in ('shell', 'shell_command') or starts_with(coalesce(name, ''), 'exec') then 'shell' when name in ('apply_patch', 'read', 'write', 'edit', 'list_dir', 'view_image') then 'fs' else 'custom' end end as namespace,
  case when op_kind = 'tool' and r.bad is not null then 'failed' else 'completed' end as status, case when op_kind = 'tool' then r.bad end as error_class
from n left join r on r.source_id = n.source_id and r.file_name = n.file_name and r.call_id = n.call_id and n.op_kind = 'tool'"""

_DICTS = "len(list_filter(case when json_type({j}, '$.{p}') = 'ARRAY' then cast(json_extract({j}, '$.{p}') as json[]) else [] end, lambda x: json_type(x) = 'OBJECT'))"
_FAILED = "kind = 'session_summary' and j ->> '$.status' = 'failed' and nullif(j ->> '$.error', '') is not null"
#: How many events of each kind the lines of a ledger give.
LEDGER_EVENT_COUNTS = f"""with recursive {LEDGER}, {_SNAPSHOT_NODES}, {_LEDGER_NODES},
e as (select row_id, source_id, kind, reason, cast(case when reason = '' then t end as json) as j from lg),
nodes as (select lg.source_id, count(*) as n from lo join lg using (row_id) group by 1), below as (select lg.source_id, part, count(*) as n from lb join lg using (row_id) group by all),
c as (
  select source_id, 'session_started' as kind, count(*) as n from e where kind = 'session_start' and reason = '' group by 1
  union all select source_id, 'session_started', n from below where part = 'childSessions' union all select source_id, 'payload_ref', n from below where part = 'payloadRefs'
  union all select source_id, 'session_started', sum({_DICTS.format(j='j', p='childSessions')}) from e where kind = 'session_summary' and reason = '' group by 1
  union all select source_id, case kind when 'turn_start' then 'turn_started' when 'turn_end' then 'turn_finalized' else 'session_finalized' end, count(*) from e where kind <> 'session_start' and reason = '' group by all
  union all select source_id, 'op_started', n from nodes union all select source_id, 'op_finalized', n from nodes
  union all select source_id, 'log_entry', sum(case when json_type(j, '$.warnings') = 'ARRAY' then json_array_length(j, '$.warnings') else 0 end + case when json_type(j, '$.errors') = 'ARRAY' then json_array_length(j, '$.errors') else 0 end)
    from e where kind = 'turn_end' and reason = '' group by 1
  union all select source_id, 'log_entry', count(*) from e where reason = '' and ({_FAILED} or kind = 'session_error') group by 1
  union all select source_id, 'session_updated', sum(case when {_FAILED} and regexp_matches(j ->> '$.error', 'last_error=[^;:]+:|slugs=\\s*[^.;\n\\s]|after [^(]*? attempts of |maxTurns=') then 1 else 0 end
      + case when json_type(j, '$.finalReport') = 'OBJECT' then 1 else 0 end) from e where kind = 'session_summary' and reason = '' group by 1
  union all select source_id, 'session_updated', count(*) from e where kind = 'session_error' and reason = '' and json_type(j, '$.attributes') = 'OBJECT' and len(json_keys(j, '$.attributes')) > 0 group by 1
  union all select source_id, 'source_error', count(*) from e where reason <> '' group by 1)
select source_id, kind, cast(sum(n) as bigint) as n from c group by all having sum(n) > 0"""

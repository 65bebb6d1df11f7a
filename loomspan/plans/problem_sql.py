"""SQL that computes the results of the problem queries in its own way, for the checks against DuckDB.

Parts are common table expressions that queries put together: ``instants`` reads
written times, ``LEDGER`` says which ledger lines are valid, and so on.
"""

from __future__ import annotations

_ABBREVIATIONS = (
    ("UTC", 0), ("GMT", 0), ("Z", 0), ("WET", 0), ("BST", 60), ("WEST", 60), ("CET", 60), ("CEST", 120), ("EET", 120), ("EEST", 180), ("MSK", 180), ("IST", 330),
    ("JST", 540), ("KST", 540), ("SGT", 480), ("AEST", 600), ("AEDT", 660), ("EST", -300), ("EDT", -240), ("CST", -360), ("CDT", -300), ("MST", -420), ("MDT", -360), ("PST", -480), ("PDT", -420),
)
_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_ZONE = r"([Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{2,5})?"
_FORMS = {
    "iso": (
        r"(\d{4})-(\d{2})-(\d{2})(?:[Tt ](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?\s*" + _ZONE + r"(?:\[([A-Za-z_]+(?:/[A-Za-z_+\-0-9]+)*)\])?",
        ["y", "mo", "d", "h", "mi", "s", "f", "mark", "named"],
    ),
    "compact": (r"(\d{4})(\d{2})(\d{2})[Tt](\d{2})(\d{2})(\d{2})(?:[.,](\d+))?([Zz]|[+-]\d{2}:?\d{2})?", ["y", "mo", "d", "h", "mi", "s", "f", "mark"]),
    "slash": (r"(\d{1,2})/(\d{1,2})/(\d{4})(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp][Mm])?)?\s*([Zz]|[+-]\d{2}:?\d{2}|[A-Z]{3,5})?", ["mo", "d", "y", "h", "mi", "s", "f", "half", "mark"]),
    "dot": (r"(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,?\s+(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?\s*([AaPp][Mm])?)?\s*([Zz]|[+-]\d{2}:?\d{2}|[A-Z]{3,5})?", ["d", "mo", "y", "h", "mi", "s", "f", "half", "mark"]),
    "mail": (r"(?:(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+)?(\d{1,2})\s+([A-Za-z]{3})[a-z]*\s+(\d{4})\s+(\d{2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[A-Z]{1,5})?", ["d", "mon", "y", "h", "mi", "s", "mark"]),
}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def instants(src: str, name: str) -> str:
    """CTEs ending in ``name`` (id, us): the UTC microseconds of ``src`` (id, w, tz), NULL where w is no time."""
    parts = []
    for form, (pattern, groups) in _FORMS.items():
        have = lambda g, groups=groups: f"nullif(g.{g}, '')" if g in groups else "cast(null as varchar)"
        month = f"cast(list_position([{', '.join(_quoted(m) for m in _MONTHS)}], lower(g.mon)) as varchar)" if form == "mail" else "g.mo"
        parts.append(
            f"select id, tz, g.y as y, {month} as mo, g.d as d, {have('h')} as h, {have('mi')} as mi, {have('s')} as s, {have('f')} as f, {have('half')} as half, {have('mark')} as mark, {have('named')} as named"
            f" from (select id, tz, regexp_extract(w, {_quoted('^' + pattern + '$')}, {groups!r}) as g from {name}_w where regexp_full_match(w, {_quoted(pattern)}))"
        )
    offsets = " ".join(f"when {_quoted(a)} then {m}" for a, m in _ABBREVIATIONS)
    back = lambda u: f"epoch_us(timezone(zone, make_timestamptz({u})))"
    return f"""{name}_w as (select id, trim(w, ' ' || chr(9) || chr(10) || chr(13)) as w, tz from {src} where trim(w, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
{name}_n as (select id, cast(regexp_extract(w, '^(\\d+)', 1) as hugeint) as n, rpad(regexp_extract(w, '\\.(\\d+)$', 1), 6, '0') as f from {name}_w where regexp_full_match(w, '\\d{{9,20}}(\\.\\d+)?')),
{name}_u as (select id, case when n between 946684800 and 4102444799 then n * 1000000 + cast(left(f, 6) as bigint) when n between 946684800000 and 4102444799999 then n * 1000 + cast(left(f, 3) as bigint)
  when n between 946684800000000 and 4102444799999999 then n when n // 1000 between 946684800000000 and 4102444799999999 then n // 1000 end as us from {name}_n),
{name}_p as ({' union all '.join(parts)}),
{name}_c as (select id, tz, mark, named, y, mo, d, coalesce(mi, '0') as mi, coalesce(s, '0') as s, rpad(left(coalesce(f, ''), 6), 6, '0') as f,
  case when half is null then cast(coalesce(h, '0') as int) when cast(h as int) between 1 and 12 then cast(h as int) % 12 + case when lower(left(half, 1)) = 'p' then 12 else 0 end else 99 end as h from {name}_p),
{name}_l as (select id, mark, coalesce(named, tz, 'UTC') as zone, epoch_us(try_cast(y || '-' || lpad(mo, 2, '0') || '-' || lpad(d, 2, '0') || ' 00:00:00' as timestamp))
  + case when h < 24 and cast(mi as int) < 60 and cast(s as int) < 60 then cast(h * 3600 + cast(mi as int) * 60 + cast(s as int) as bigint) * 1000000 + cast(f as bigint) end as wall from {name}_c),
{name}_z as (select id, wall, zone, mark, case when mark in ('Z', 'z') then 0 when left(mark, 1) in ('+', '-') then case when cast(substr(mark, 2, 2) as int) <= 15 and (length(mark) < 4 or cast(right(mark, 2) as int) <= 59)
    then (case left(mark, 1) when '+' then 1 else -1 end) * (cast(substr(mark, 2, 2) as int) * 60 + case when length(mark) > 3 then cast(right(mark, 2) as int) else 0 end) end
  else case mark {offsets} end end as off from {name}_l where wall is not null),
{name}_t as (select id, wall, zone, epoch_us(timezone(zone, make_timestamp(wall))) as u from {name}_z where mark is null),
{name}_a as (select id, us from {name}_u where us is not null
  union all select id, wall - cast(off as bigint) * 60000000 from {name}_z where mark is not null and off is not null
  union all select id, case when {back('u - 3600000000')} = wall then u - 3600000000 when {back('u')} = wall then u end from {name}_t),
{name} as (select id, cast(us as bigint) as us from {name}_a where us > 0)"""


_KNOWN = ("version", "recordType", "seq", "ts", "originId", "sessionId", "turn", "status")
_KNOWN_LIST = ", ".join(_quoted(k) for k in _KNOWN)


def _has(c: str) -> str:
    return f"coalesce(json_type({c}) <> 'NULL' and ({c} ->> '$') <> '', false)"


def _whole(c: str) -> str:
    return (
        f"case when json_type({c}) in ('UBIGINT', 'BIGINT') then try_cast({c} ->> '$' as bigint) when json_type({c}) = 'DOUBLE' and cast({c} ->> '$' as double) = floor(cast({c} ->> '$' as double)) then try_cast(cast({c} ->> '$' as double) as bigint)"
        f" when json_type({c}) = 'VARCHAR' and regexp_full_match(trim({c} ->> '$'), '[0-9]{{1,40}}') then try_cast(trim({c} ->> '$') as bigint) end"
    )


#: lg: every non-blank ledger line with its documented fields under respelt names too, its reason ('' if valid) and ts_us.
LEDGER = f"""lraw as (select l.row_id, l.source_id, l.file_name, l.line_no, case when json_valid(l.raw_text) then l.raw_text end as t, s.meta_json ->> '$.tz' as tz,
    coalesce(json_type(case when json_valid(l.raw_text) then l.raw_text end) = 'OBJECT', false) as ok
  from ledger_lines l left join sources s on s.id = l.source_id where regexp_matches(l.raw_text, '\\S')),
lkv as (select row_id, k, json_extract(t, '$."' || k || '"') as v, k in ({_KNOWN_LIST}) as known, lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g')) as plain from (select row_id, t, unnest(json_keys(t)) as k from lraw where ok)),
lk as (select row_id, f, case when bool_or(k = f) then any_value(v) filter (where k = f) when count(*) = 1 then any_value(v) end as v, any_value(k) as k
  from lkv join (values {', '.join(f'({_quoted(k)})' for k in _KNOWN)}) w(f) on k = f or (not known and plain = lower(f)) group by row_id, f),
lp as (select row_id, {', '.join(f"any_value(v) filter (where f = {_quoted(k)}) as {k.lower()}" for k in _KNOWN)} from lk group by row_id),
lts as (select r.row_id as id, case when json_type(p.ts) in ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE') then p.ts ->> '$' end as w, r.tz from lraw r join lp p using (row_id)),
{instants("lts", "lti")},
lc as (select r.*, p.* exclude (row_id), p.recordtype ->> '$' as kind, {_whole("p.version")} as version_n, {_whole("p.seq")} as seq_n, {_whole("p.turn")} as turn_n, i.us as ts_us
  from lraw r left join lp p using (row_id) left join lti i on i.id = r.row_id),
lg as (select *, case when not ok then 'syntax'
    when not ({' and '.join(_has(c) for c in ('version', 'recordtype', 'seq', 'ts', 'originid', 'sessionid'))}) then 'fields'
    when kind in ('turn_start', 'turn_end') and not {_has('turn')} then 'fields' when kind in ('turn_end', 'session_summary') and not {_has('status')} then 'fields'
    when coalesce(version_n, 0) <> 3 or kind not in ('session_start', 'turn_start', 'turn_end', 'session_summary', 'session_error') or coalesce(seq_n, 0) < 1
      or (kind in ('turn_start', 'turn_end') and coalesce(turn_n, 0) < 1) or ts_us is null then 'value' else '' end as reason from lc)"""

#: rg: every legacy rollout with its reason, session and items.
ROLLOUTS = """rraw as (select row_id, source_id, file_name, case when json_valid(raw_text) then raw_text end as t, coalesce(json_type(case when json_valid(raw_text) then raw_text end) = 'OBJECT', false) as ok from legacy_rollouts),
rkv as (select row_id, k, json_extract(t, '$."' || k || '"') as v from (select row_id, t, unnest(json_keys(t)) as k from rraw where ok)),
rp as (select row_id, case when bool_or(k = 'session') then any_value(v) filter (where k = 'session') when count(*) filter (where k not in ('session', 'items') and json_type(v) = 'OBJECT') = 1
      then any_value(v) filter (where k not in ('session', 'items') and json_type(v) = 'OBJECT') end as session,
    case when bool_or(k = 'items') then any_value(v) filter (where k = 'items') when count(*) filter (where k not in ('session', 'items') and json_type(v) = 'ARRAY') = 1
      then any_value(v) filter (where k not in ('session', 'items') and json_type(v) = 'ARRAY') end as items from rkv group by row_id),
rq as (select r.*, p.session, case when json_type(p.items) = 'VARCHAR' then coalesce(try_cast(case when json_valid(p.items ->> '$') then p.items ->> '$' end as json), p.items) else p.items end as items, p.items as written from rraw r left join rp p using (row_id)),
rr as (select *, case when json_type(items) = 'OBJECT' and len(list_filter(json_keys(items), lambda x: not regexp_full_match(x, '[0-9]{1,18}'))) = 0
    then list_transform(list_sort(list_transform(json_keys(items), lambda x: cast(x as bigint))), lambda x: json_extract(items, '$."' || x || '"'))
    when json_type(items) = 'ARRAY' then cast(case when json_type(items) = 'ARRAY' then items end as json[]) end as list from rq),
rg as (select *, case when not ok then 'syntax'
    when not coalesce(json_type(session) <> 'NULL' and (session ->> '$') <> '', false) or not coalesce(json_type(written) <> 'NULL' and (written ->> '$') <> '', false) then 'fields'
    when json_type(session) <> 'OBJECT' or list is null or len(list_filter(list, lambda x: json_type(x) <> 'OBJECT')) > 0 then 'value' else '' end as reason from rr)"""

#: eg: every export row with its reason and the values of its columns.
EXPORT = """er as (select row_id, coalesce(raw_text, '') as t from session_export),
ef as (select row_id, t,
    t = '' or not regexp_full_match(t, '("([^"]|"")*"|[^",\\r\\n]*)(,("([^"]|"")*"|[^",\\r\\n]*))*(\\r\\n|\\n|\\r)?') as broken,
    regexp_extract_all(regexp_replace(',' || t, '(\\r\\n|\\n|\\r)$', ''), ',("(?:[^"]|"")*"|[^",\\r\\n]*)', 1) as v from er),
ev as (select row_id, broken, list_transform(v, lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) as v from ef),
eg as (select row_id, v, case when broken then 'syntax' when len(v) <> 12 then 'fields'
  when v[6] not in ('root', 'sub_agent', 'fork', 'internal') or not regexp_full_match(v[9], '[0-9]+') or try_cast(v[9] as bigint) is null or not regexp_full_match(v[10], '[0-9]+') or try_cast(v[10] as bigint) is null
    or not regexp_full_match(v[11], '[0-9]+(\\.[0-9]+)?|\\.[0-9]+') then 'value' else '' end as reason from ev)"""

P7_FOUND = f"""with {LEDGER}, {ROLLOUTS}, {EXPORT}
select 'ledger_lines' as src_table, row_id, reason from lg where reason <> ''
union all select 'legacy_rollouts', row_id, reason from rg where reason <> ''
union all select 'session_export', row_id, reason from eg where reason <> ''"""

P7_SESSION_ROWS = f"""with {EXPORT}
select row_id, {', '.join(f"nullif(v[{k}], '') as {c}" for k, c in enumerate(('id', 'native_id', 'source_id', 'parent_session_id', 'root_session_id', 'kind', 'agent_name', 'status'), 1))},
  cast(v[9] as bigint) as start_ts, cast(v[10] as bigint) as turn_count, cast(v[11] as double) as cost_usd, nullif(v[12], '') as error_message from eg where reason = ''"""

_ITEMS = "select row_id, source_id, file_name, session ->> '$.id' as session_id, unnest(list) as item, generate_subscripts(list, 1) - 1 as item_no from rg where reason = ''"

P7_ROLLOUT_ITEMS = f"""with {ROLLOUTS}, i as ({_ITEMS})
select row_id, source_id, file_name, session_id, cast(item_no as int) as item_no, item ->> '$.type' as item_type, cast(item as varchar) as item from i"""

P7_LEDGER_ROWS = f"""with {LEDGER},
lu as (select row_id, unnest(json_keys(t)) as k, generate_subscripts(json_keys(t), 1) as i, t from lg where reason = ''),
lr as (select lu.row_id, '{{' || string_agg(cast(to_json(lu.k) as varchar) || ':' || cast(json_extract(lu.t, '$."' || lu.k || '"') as varchar), ',' order by lu.i) || '}}' as body
  from lu where lu.k not in ({_KNOWN_LIST}) and not exists (select 1 from lk where lk.row_id = lu.row_id and lk.k = lu.k and lk.v is not null) group by 1)
select coalesce(row_id, -1) as row_id, source_id, file_name, coalesce(line_no, -1) as line_no, cast(version_n as int) as version, kind as record_type, seq_n as seq, ts_us,
  originid ->> '$' as origin_id, sessionid ->> '$' as session_id, turn_n as turn, status ->> '$' as status, coalesce(lr.body, '{{}}') as body from lg left join lr using (row_id) where reason = ''"""

_USUAL = "'\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{3}Z'"


def _p4(cases_only: bool) -> str:
    sources = f"""tw as (select 'transcript_lines' as src_table, coalesce(line_id, -1) as row_id, line_timestamp as w, s.meta_json ->> '$.tz' as tz, not regexp_full_match(line_timestamp, {_USUAL}) as is_case
    from transcript_lines t left join sources s on s.id = t.source_id
  union all select 'ledger_lines', coalesce(row_id, -1), ts ->> '$', tz, json_type(ts) <> 'VARCHAR' or not regexp_full_match(ts ->> '$', {_USUAL}) from lg where reason = ''
  union all select 'snapshot_files', coalesce(row_id, -1), j ->> '$', s.meta_json ->> '$.tz', not (json_type(j) in ('UBIGINT', 'BIGINT') and length(j ->> '$') = 13)
    from (select *, json_extract(case when json_valid(raw_text) then raw_text end, '$.opTree.startedAt') as j from snapshot_files) f left join sources s on s.id = f.source_id where json_type(j) in ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE')
  union all select 'sessions', coalesce(row_id, -1), cast(start_ts as varchar), s.meta_json ->> '$.tz', length(cast(start_ts as varchar)) <> 16 from sessions x left join sources s on s.id = x.source_id where start_ts > 0),
ti as (select row_number() over () as id, * from tw),
{instants("ti", "tu")}"""
    where = "where is_case" if cases_only else ""
    return f"with {LEDGER}, {sources}\nselect src_table, row_id, us as utc_us from ti join tu using (id) {where}"


P4_FOUND, P4_UTC = _p4(True), _p4(False)

_SNAPSHOT_NODES = """sn as (
  select row_id, 'opTree' as path, '' as parent, json_extract(case when json_valid(raw_text) then raw_text end, '$.opTree') as j
  from snapshot_files where json_type(case when json_valid(raw_text) then raw_text end, '$.opTree') = 'OBJECT'
  union all
  select t.row_id, t.path || '.' || p.part || '[' || t.k || '].ops[' || (o.i - 1) || '].childSession', t.path || '.' || p.part || '[' || t.k || '].ops[' || (o.i - 1) || ']',
    json_extract(o.j, '$.childSession')
  from (select sn.row_id, sn.path, part, u.i - 1 as k, u.j from sn, (values ('turns'), ('steps')) v(part),
      lateral (select unnest(cast(json_extract(sn.j, '$.' || part) as json[])) as j, generate_subscripts(cast(json_extract(sn.j, '$.' || part) as json[]), 1) as i) u
      where json_type(sn.j, '$.' || part) = 'ARRAY') t, lateral (select t.part) p,
    lateral (select unnest(cast(json_extract(t.j, '$.ops') as json[])) as j, generate_subscripts(cast(json_extract(t.j, '$.ops') as json[]), 1) as i) o
  where json_type(t.j, '$.ops') = 'ARRAY' and json_type(o.j, '$.childSession') = 'OBJECT'),
st as (select row_id, sn.path as parent, part, path || '.' || part || '[' || (u.i - 1) || ']' as path, u.i - 1 as k, u.j from sn, (values ('turns'), ('steps')) v(part),
    lateral (select unnest(cast(json_extract(sn.j, '$.' || part) as json[])) as j, generate_subscripts(cast(json_extract(sn.j, '$.' || part) as json[]), 1) as i) u
  where json_type(sn.j, '$.' || part) = 'ARRAY' and json_type(u.j) = 'OBJECT'),
so as (select row_id, st.path as parent, st.path || '.ops[' || (u.i - 1) || ']' as path, u.i - 1 as k, u.j from st,
    lateral (select unnest(cast(json_extract(st.j, '$.ops') as json[])) as j, generate_subscripts(cast(json_extract(st.j, '$.ops') as json[]), 1) as i) u
  where json_type(st.j, '$.ops') = 'ARRAY' and json_type(u.j) = 'OBJECT'),
sa as (select row_id, path || '.attributes.' || k as path, path as parent, json_extract(j, '$.attributes."' || k || '"') as j, i - 1 as k
  from (select row_id, path, j, unnest(json_keys(j, '$.attributes')) as k, generate_subscripts(json_keys(j, '$.attributes'), 1) as i from sn where json_type(j, '$.attributes') = 'OBJECT'))"""

_LEDGER_NODES = """lo as (select row_id, '' as parent, 'ops[' || (i - 1) || ']' as path, i - 1 as k, j from (
    select row_id, unnest(cast(json_extract(t, '$.ops') as json[])) as j, generate_subscripts(cast(json_extract(t, '$.ops') as json[]), 1) as i from lg where reason = '' and kind = 'turn_end' and json_type(t, '$.ops') = 'ARRAY')
  where json_type(j) = 'OBJECT'),
lb as (select row_id, part, path as parent, path || '.' || part || '[' || (i - 1) || ']' as path, i - 1 as k, j from (
    select row_id, path, part, unnest(cast(json_extract(j, '$.' || part) as json[])) as j, generate_subscripts(cast(json_extract(j, '$.' || part) as json[]), 1) as i
    from lo, (values ('payloadRefs'), ('childSessions')) v(part) where json_type(j, '$.' || part) = 'ARRAY') where json_type(j) = 'OBJECT')"""

P3_FOUND = f"""with recursive {LEDGER}, {_SNAPSHOT_NODES}, {_LEDGER_NODES}
select 'snapshot_files' as src_table, row_id, 'session' as node_kind, path as node_path, parent as parent_path from sn
union all select 'snapshot_files', row_id, case part when 'turns' then 'turn' else 'step' end, path, parent from st
union all select 'snapshot_files', row_id, 'op', path, parent from so
union all select 'snapshot_files', row_id, 'attribute', path, parent from sa
union all select 'ledger_lines', row_id, 'op', path, parent from lo
union all select 'ledger_lines', row_id, case part when 'payloadRefs' then 'payload_ref' else 'child_session' end, path, parent from lb"""


_GROUPS = """sg as (select row_id, path as parent, path || '.' || part || '[' || (i - 1) || ']' as path, i - 1 as k, j, part from (
    select row_id, path, part, unnest(cast(json_extract(j, '$.' || part) as json[])) as j, generate_subscripts(cast(json_extract(j, '$.' || part) as json[]), 1) as i
    from (select row_id, path, j from so) , (values ('logs'), ('accounting')) v(part) where json_type(j, '$.' || part) = 'ARRAY')),
lx as (select row_id, '' as parent, part || '[' || (i - 1) || ']' as path, i - 1 as k, j, part from (
    select row_id, part, unnest(cast(json_extract(t, '$.' || part) as json[])) as j, generate_subscripts(cast(json_extract(t, '$.' || part) as json[]), 1) as i
    from lg, (values ('warnings'), ('errors')) v(part) where reason = '' and kind = 'turn_end' and json_type(t, '$.' || part) = 'ARRAY'))"""
_SETS = {
    "session": "select 'snapshot_files' as src_table, row_id, path, parent, 0 as k, j from sn", "turn": "select 'snapshot_files' as src_table, row_id, path, parent, k, j from st where part = 'turns'",
    "step": "select 'snapshot_files' as src_table, row_id, path, parent, k, j from st where part = 'steps'",
    "op": "select 'snapshot_files' as src_table, row_id, path, parent, k, j from so union all select 'ledger_lines', row_id, path, parent, k, j from lo",
    "payload_ref": "select 'ledger_lines' as src_table, row_id, path, parent, k, j from lb where part = 'payloadRefs'", "child_session": "select 'ledger_lines' as src_table, row_id, path, parent, k, j from lb where part = 'childSessions'",
    "record": "select 'snapshot_files' as src_table, row_id, '' as path, '' as parent, 0 as k, cast(t as json) as j from (select row_id, case when json_valid(raw_text) then raw_text end as t from snapshot_files) where json_type(t) = 'OBJECT'"
    " union all select 'ledger_lines', row_id, '', '', 0, cast(t as json) from lg where reason = '' and kind = 'turn_end'",
    "op.logs[]": "select 'snapshot_files' as src_table, row_id, path, parent, k, j from sg where part = 'logs'", "op.accounting[]": "select 'snapshot_files' as src_table, row_id, path, parent, k, j from sg where part = 'accounting'",
    "record.warnings[]": "select 'ledger_lines' as src_table, row_id, path, parent, k, j from lx where part = 'warnings'", "record.errors[]": "select 'ledger_lines' as src_table, row_id, path, parent, k, j from lx where part = 'errors'",
}
_NODE_TABLES = f"{LEDGER}, {_SNAPSHOT_NODES}, {_LEDGER_NODES}, {_GROUPS}"
_PLAIN = "lower(regexp_replace(k, '[^A-Za-z0-9]', '', 'g'))"
#: kv: top-level fields of the nodes n; chosen: which field is which column (w: kind, c, p): its own name, else the first respelling.
_CHOSEN = f"""kv as (select node_, kind, k, row_number() over (partition by node_) as at_, json_extract(j, '$."' || k || '"') as v from (select node_, kind, j, unnest(json_keys(j)) as k from n where json_type(j) = 'OBJECT')),
chosen as (select node_, c, case when bool_or(k = c) then c else min_by(k, at_) end as k from kv join w on w.kind = kv.kind and (k = c or {_PLAIN} = p) group by node_, c)"""


def _wanted(columns: dict[str, tuple[str, ...]]) -> str:
    return "w as (select * from (values " + ", ".join(f"({_quoted(kind)}, {_quoted(c)}, {_quoted(c.lower())})" for kind, cs in columns.items() for c in cs) + ") w(kind, c, p))"


def flat(kind: str, columns: tuple[str, ...]) -> str:
    """The flat table of a kind of node as src_table, row_id, node_path, parent_path, ordinal and its columns as texts."""
    name = lambda c: "value_json" if c == "value" else c.replace(".", "_").lower()
    deep = "".join(f" union all select node_, {_quoted(c)}, json_extract_string(j, {_quoted('$.' + c)}) from n where json_type(j) = 'OBJECT'" for c in columns if "." in c)
    bare = " union all select node_, 'value', j ->> '$' from n where json_type(j) <> 'OBJECT'" if "value" in columns else ""
    cols = ", ".join(f"any_value(v) filter (where c = {_quoted(c)}) as {name(c)}" for c in columns)
    return f"""with recursive {_NODE_TABLES}, {_wanted({kind: columns})},
n as (select row_number() over () as node_, {_quoted(kind)} as kind, src_table, row_id, path as node_path, parent as parent_path, cast(k as int) as ordinal, j from ({_SETS[kind]})),
{_CHOSEN},
x as (select node_, c, v ->> '$' as v from chosen join kv using (node_, k){deep}{bare}),
y as (select node_, {cols} from x group by node_)
select n.* exclude (node_, kind, j), y.* exclude (node_) from n left join y using (node_)"""


def rest(columns: dict[str, tuple[str, ...]]) -> str:
    """All values of nodes that no column holds: src_table, row_id, node_kind, node_path, field, value."""
    union = " union all ".join(f"select {_quoted(kind)} as kind, * from ({q})" for kind, q in _SETS.items())
    arrays = "(kind = 'session' and top in ('turns', 'steps')) or (kind in ('turn', 'step') and top = 'ops') or (kind = 'record' and src_table = 'ledger_lines' and top = 'ops') or (kind = 'op' and src_table = 'ledger_lines' and top in ('payloadRefs', 'childSessions'))"
    objects = "(kind = 'session' and top = 'attributes' and first_ <> '{}') or (kind = 'op' and src_table = 'snapshot_files' and top = 'childSession') or (kind = 'record' and src_table = 'snapshot_files' and top = 'opTree')"
    deep = ", ".join(_quoted(f"{kind}.{c}") for kind, cs in columns.items() for c in cs if "." in c)
    return f"""with recursive {_NODE_TABLES}, {_wanted(columns)},
n as (select row_number() over () as node_, kind, src_table, row_id, path as node_path, j from ({union})),
{_CHOSEN},
tree as (select n.node_, n.kind, n.src_table, n.row_id, n.node_path, t.type, t.value, t.fullkey, replace(substr(t.fullkey, 3), '"', '') as field,
    trim(regexp_extract(t.fullkey, '^\\$\\.("[^"]*"|[^.\\[]*)', 1), '"') as top, n.j from n, json_tree(n.j) t where json_type(n.j) = 'OBJECT' and t.fullkey <> '$'),
seen as (select *, cast(json_extract(j, '$."' || top || '"') as varchar) as first_, json_type(j, '$."' || top || '"') as first_type from tree),
kept as (select * from seen s where not exists (select 1 from chosen c where c.node_ = s.node_ and c.k = s.top) and kind || '.' || field not in ({deep})
  and not (first_type = 'OBJECT' and ({objects}))
  and ((not contains(fullkey, '[') and (type not in ('OBJECT', 'ARRAY') or cast(value as varchar) in ('{{}}', '[]')))
    or (regexp_full_match(fullkey, '\\$\\.[A-Za-z]+\\[\\d+\\]') and ({arrays}) and type <> 'OBJECT')))
select src_table, row_id, kind as node_kind, node_path, field, value ->> '$' as value from kept
union all select src_table, row_id, kind, node_path, 'value', j ->> '$' from n where json_type(j) <> 'OBJECT' and kind not in ('record.warnings[]', 'record.errors[]')"""


P3_ATTRIBUTES = f"""with recursive {_SNAPSHOT_NODES}
select 'snapshot_files' as src_table, row_id, path as node_path, parent as parent_path, cast(k as int) as ordinal, j ->> '$' as value_json from sa"""

_TYPE = "case json_type(v) when 'NULL' then 'null' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'DOUBLE' then 'number' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'integer' end"


def _elements(src: str, path: str) -> str:
    return f"select * from (select key, unnest(cast(json_extract(j, '$.{path}') as json[])) as j from {src} where json_type(j, '$.{path}') = 'ARRAY') where json_type(j) = 'OBJECT'"


#: changes: one row per file and changed field. Where more unknown fields than missing ones could be meant, likeness of names decides.
_CHANGES = f"""b as (select src_table as src, case when contains(field_path, '.') then regexp_replace(field_path, '\\.[^.]*$', '') else '' end as parent, regexp_extract(field_path, '([^.]*)$', 1) as field, string_split(json_types, '|') as types, is_required = 1 as required from schema_baseline),
s0 as (select coalesce(file_name, '') as key, case when json_valid(raw_text) then cast(raw_text as json) end as j from snapshot_files), s1 as (select * from s0 where json_type(j) = 'OBJECT'),
s2 as (select key, json_extract(j, '$.opTree') as j from s1 where json_type(j, '$.opTree') = 'OBJECT'), s3 as ({_elements('s2', 'turns')}), s4 as ({_elements('s3', 'ops')}),
r1 as (select coalesce(file_name, '') as key, cast(t as json) as j from rg where reason = ''), r2 as (select key, json_extract(j, '$.session') as j from r1 where json_type(j, '$.session') = 'OBJECT'), r3 as ({_elements('r1', 'items')}),
l1 as (select coalesce(file_name, '') as key, kind, cast(t as json) as j from lg where reason = ''), l2 as (select key, j from l1 where kind = 'turn_end'), l3 as ({_elements('l2', 'ops')}),
t0 as (select coalesce(session_id, '') as key, case when json_valid(message) then cast(message as json) end as j from transcript_lines where lower(trim(line_type)) = 'assistant'),
t1 as (select * from t0 where json_type(j) = 'OBJECT'), t2 as (select key, json_extract(j, '$.usage') as j from t1 where json_type(j, '$.usage') = 'OBJECT'),
o as (select 'snapshot_files' as src, '' as parent, key, j from s1 union all select 'snapshot_files', 'opTree', key, j from s2 union all select 'snapshot_files', 'opTree.turns[]', key, j from s3 union all select 'snapshot_files', 'opTree.turns[].ops[]', key, j from s4
  union all select 'legacy_rollouts', '', key, j from r1 union all select 'legacy_rollouts', 'session', key, j from r2 union all select 'legacy_rollouts', 'items[]', key, j from r3
  union all select 'ledger_lines', '=' || kind, key, j from l1 union all select 'ledger_lines', 'turn_end.ops[]', key, j from l3
  union all select 'transcript_lines', 'message', key, j from t1 union all select 'transcript_lines', 'message.usage', key, j from t2),
oc as (select src, parent, key, count(*) as n from o group by all),
f0 as (select src, parent, key, k, json_extract(j, '$."' || k || '"') as v from (select *, unnest(json_keys(j)) as k from o)),
f1 as (select src, parent, key, k, {_TYPE} as type, count(*) as n from f0 group by all),
lt as (select key, k, sum(n) as total from f1 where parent[1] = '=' group by all), ll as (select key, sum(n) as lines from oc where parent[1] = '=' group by all),
f2 as (select f.src, f.key, f.k, f.type, f.n, case when f.parent[1] <> '=' then f.parent
    when exists (select 1 from b where b.src = f.src and b.parent = 'envelope' and b.field = f.k) or (not exists (select 1 from b where b.src = f.src and '=' || b.parent = f.parent and b.field = f.k) and t.total = l.lines) then 'envelope'
    else substr(f.parent, 2) end as parent
  from f1 f left join lt t on f.parent[1] = '=' and t.key = f.key and t.k = f.k left join ll l on f.parent[1] = '=' and l.key = f.key),
f as (select src, key, parent, k, list(distinct type) filter (where type <> 'null') as types, sum(n) as n from f2 group by all),
oa as (select src, case when parent[1] = '=' then substr(parent, 2) else parent end as parent, key, n from oc union all select 'ledger_lines', 'envelope', key, lines from ll),
here as (select b.*, oa.key, oa.n as objects from b join oa on oa.src = b.src and oa.parent = b.parent),
retyped as (select h.src, h.key, h.parent, h.field from here h join f on f.src = h.src and f.key = h.key and f.parent = h.parent and f.k = h.field where len(list_filter(f.types, lambda x: not list_contains(h.types, x))) > 0),
missing as (select h.* from here h where required and not exists (select 1 from f where f.src = h.src and f.key = h.key and f.parent = h.parent and f.k = h.field)),
unknown as (select f.*, oa.n as objects from f join oa on oa.src = f.src and oa.key = f.key and oa.parent = f.parent where exists (select 1 from b where b.src = f.src and b.parent = f.parent)
  and not exists (select 1 from b where b.src = f.src and b.parent = f.parent and b.field = f.k)),
pairs as (select m.src, m.key, m.parent, m.field, u.k, jaro_winkler_similarity(lower(m.field), lower(u.k)) as like_ from missing m join unknown u on u.src = m.src and u.key = m.key and u.parent = m.parent
  where len(u.types) > 0 and len(list_filter(u.types, lambda x: not list_contains(m.types, x))) = 0 and u.n = u.objects),
sizes as (select src, key, parent, count(distinct field) as nm, count(distinct k) as nu from pairs group by all),
ranked as (select p.*, nm, nu, row_number() over (partition by p.src, p.key, p.parent, field order by like_ desc, k) as a, row_number() over (partition by p.src, p.key, p.parent, k order by like_ desc, field) as c from pairs p join sizes using (src, key, parent)),
renamed as (select distinct src, key, parent, field from ranked where nm <= nu or (nm > nu and c = 1)),
used as (select distinct src, key, parent, k from ranked where nu <= nm or (nu > nm and a = 1)),
full_ as (select src, key, parent, field, 'retyped' as change_kind from retyped union all select src, key, parent, field, 'renamed' from renamed
  union all select src, key, parent, field, 'removed' from missing m where not exists (select 1 from renamed r where r.src = m.src and r.key = m.key and r.parent = m.parent and r.field = m.field)
  union all select src, key, parent, k, 'added' from unknown u where not exists (select 1 from used x where x.src = u.src and x.key = u.key and x.parent = u.parent and x.k = u.k)),
listed as (select src, key, case when parent = '' then field else parent || '.' || field end as path, change_kind from full_),
changes as (select src as src_table, key as file_key, path as field_path, change_kind from listed l
  where not exists (select 1 from listed c where c.change_kind in ('retyped', 'renamed') and c.src = l.src and c.key = l.key and (starts_with(l.path, c.path || '.') or starts_with(l.path, c.path || '[]'))))"""

P1_FOUND = f"with {LEDGER}, {ROLLOUTS}, {_CHANGES}\nselect * from changes"
P1_KINDS = f"with {LEDGER}, {ROLLOUTS}, {_CHANGES}\nselect src_table, field_path, change_kind, count(*) as n_files from changes group by all"

from __future__ import annotations

import gzip
import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from loomspan.operators import filters, graph, merge, related, rollups, search, windows
from loomspan.operators.filters import BadRequest, SessionFilter
from loomspan.runtime import running_total
from loomspan.sources import adapters, datasources, rollouts, store, transcripts
from loomspan.streaming import ingest


# ---- parameters and cursors -------------------------------------------------------------------------------
def test_parameters():
    f = filters.parse({"agents": ["a, b", "b,c"], "from": ["5"], "limit": ["7"], "group": ["all"], "include_empty": ["1"]})
    assert f == SessionFilter(from_us=5, agents=("a", "b", "c"), limit=7, group="all", include_empty=True)
    for bad in ({"agents": [" , "]}, {"agents": ["a\x01"]}, {"limit": ["0"]}, {"limit": ["1001"]}, {"limit": ["x"]}, {"from": ["x"]}, {"group": ["some"]}, {"q": ["\n"]}):
        with pytest.raises(BadRequest):
            filters.parse(bad)
    assert [filters.clamped(x, 20, 200) for x in (None, 0, 5, 999)] == [20, 20, 5, 200]


def test_cursor():
    f = SessionFilter(agents=("a", "b"))
    c = filters.encode_cursor(5, "x", f)
    assert filters.decode_cursor(c, SessionFilter(agents=("b", "a"))) == (5, "x")
    assert filters.fingerprint(SessionFilter(agents=("ab",))) != filters.fingerprint(f)
    for bad, g in ((c, SessionFilter()), (c + "AAAA", f), ("x", f), (c[:-4], f)):
        with pytest.raises(BadRequest):
            filters.decode_cursor(bad, g)


def test_pages_have_every_row_once(spark):
    df = spark.createDataFrame([(i % 3, f"{i:02d}") for i in range(20)], "start_ts bigint, id string")
    for order in ("asc", "desc"):
        f, seen, after = SessionFilter(limit=4, order=order), [], None
        while True:
            rows = filters.page(df, f, after).collect()
            seen += [(r["start_ts"], r["id"]) for r in rows[:4]]
            if len(rows) <= 4:
                break
            after = seen[-1]
        assert seen == sorted(seen, reverse=order == "desc") and len(seen) == 20


def test_effective_status(spark):
    now = 10_000_000_000
    rows = [("failed", None, 0, 0), ("running", 5, 0, 0), ("running", None, 1, 1), ("running", None, now - 1, 0), (None, None, now, None)]
    df = spark.createDataFrame(rows, "status string, end_ts bigint, last_activity_ts bigint, start_ts bigint")
    assert [r[0] for r in df.select(filters.effective_status(now)).collect()] == ["failed", "completed", "stale", "running", None]


# ---- rollups ----------------------------------------------------------------------------------------------
def test_bucket_floor(spark):
    df = spark.createDataFrame([(-1,), (0,), (3_599_999_999,), (3_600_000_000,)], "t bigint")
    assert [r[0] for r in df.select(rollups.bucket("t", rollups.HOUR_US)).collect()] == [-3_600_000_000, 0, 0, 3_600_000_000]


def test_live_and_stored_rollups_agree_for_any_clock(spark):
    from loomspan import domain

    x = domain.load(spark, "/root/testdata/sf0.001")
    x = domain.Domain(*[d.cache() for d in x])
    full = rollups.fold(x.ops, x.sessions, x.sources, rollups.DAY_US).cache()
    want = sorted(map(tuple, full.select(*sorted(full.columns)).collect()))
    mid = x.ops.agg(F.percentile_approx("start_ts", 0.5)).first()[0]
    for now in (0, mid, mid + 12345, 10**18):
        got = rollups.merged(full, x.ops, x.sessions, x.sources, rollups.DAY_US, now)
        assert sorted(map(tuple, got.select(*sorted(full.columns)).collect())) == want


def test_collapse_keeps_sums_and_breaks_ties_by_name(spark):
    rows = [(0, "f", "tool", n, c) for n, c in (("b", 2), ("a", 2), ("c", 1), ("d", 9), ("e", 1))]
    df = spark.createDataFrame(rows, "bucket_ts bigint, source_format string, dimension string, dimension_value string, op_count bigint")
    for m in rollups.MEASURES:
        df = df if m in df.columns else df.withColumn(m, F.lit(1.0 if m == "cost_usd" else 1).cast("double" if m == "cost_usd" else "bigint"))
    got = {r["dimension_value"]: (r["op_count"], r["tokens_in"]) for r in rollups.collapse(df, 3).collect()}
    assert got == {"d": (9, 1), "a": (2, 1), rollups.OTHER: (4, 3)}
    assert rollups.collapse(df, 5).count() == 5


# ---- ordered computations ---------------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 3, 9])
def test_running_sums_over_partition_borders(spark, parts):
    rnd = random.Random(parts)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i, rnd.choice([1, 2, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    got = {r["i"]: r["s"] for r in running_total(df, ["k"], ["i"], "v", "s", parts).collect()}
    last = {r["i"]: r["p"] for r in windows.carry_last(df, ["k"], ["i"], "v", "p", partitions=parts).collect()}
    sums: dict = {}
    prev: dict = {}
    for k, i, v in rows:
        assert got[i] == sums.get(k, 0)
        assert last[i] == prev.get(k)
        sums[k] = sums.get(k, 0) + (v or 0)
        prev[k] = v if v is not None else prev.get(k)
    assert running_total(df.limit(0), ["k"], ["i"], "v", "s").count() == 0


# ---- trees ------------------------------------------------------------------------------------------------
def test_loops_end(spark):
    s = spark.createDataFrame([(1, None), (2, 1), (3, 4), (4, 3), (5, 3), (6, 99)], "id bigint, parent_session_id bigint")
    assert {r["id"]: r["root_id"] for r in graph.roots(s).collect()} == {1: 1, 2: 1, 3: None, 4: None, 5: None, 6: 6}
    assert graph.descendants(s, s.where("id = 3"), 5).agg(F.max("depth")).first()[0] == 5
    assert graph.descendants(s, s.where("id = 2")).count() == 0


# ---- search -----------------------------------------------------------------------------------------------
def test_query_grammar():
    P = search.Phrase
    q = search.parse_query('a "b c" d* NOT e OR f')
    assert q.phrases == (P(("a",)), P(("b", "c")), P(("d",), True), P(("e",)), P(("f",))) and q.tree == ("or", ("and", ("and", 0, 1), ("not", 2, 3)), 4)
    assert search.parse_query("(a OR b) AND name:c", ("name",)) == search.Query((P(("a",)), P(("b",)), P(("c",), False, "name")), ("and", ("or", 0, 1), 2))
    assert search.parse_query("Éclair foo_bar").phrases == (P(("eclair",)), P(("foo", "bar")))
    for bad in ("", "rate-limit", "AND a", "a OR", "NOT a", '"open', "a )", "(a", "()", "a\x00", "name:c", "* a"):
        with pytest.raises(BadRequest):
            search.parse_query(bad)


def index_of(spark, tmp_path, rows):
    d = spark.createDataFrame(rows, "doc bigint, text string")
    search.write_index(d, "doc", "text", str(tmp_path / "i"))
    return search.open_index(d, "doc", "text", str(tmp_path / "i"))


def test_search_on_stored_postings(spark, tmp_path):
    i = index_of(spark, tmp_path, [(1, "the Éclair price lookup"), (2, "lookup price"), (3, None), (4, ""), (5, "price " * 200 + "eclair"), (6, "x" * 200_000 + " tail"), (7, "banana split"), (8, "banana banana"), (9, "price price lookup lookup")])
    ids = lambda q: {r["doc"] for r in search.ranked(i, search.parse_query(q)).collect()}
    assert ids("eclair") == {1, 5} and ids('"price lookup"') == {1, 9} and ids("pri* NOT eclair") == {2, 9} and ids("none") == set() and ids("tail") == {6} and ids("(eclair OR banana) NOT split") == {1, 5, 8} and ids("p*") == {1, 2, 5, 9}
    rank = lambda q: {r["doc"]: r["rank"] for r in search.ranked(i, search.parse_query(q)).collect()}
    both = rank("eclair OR banana")
    assert set(both) == {1, 5, 7, 8} and all(v < 0 for v in both.values()) and both[8] < both[7] and rank("ban*") == pytest.approx(rank("banana"), abs=1e-9)
    p = search.page(i, search.parse_query("eclair OR banana"), 3).collect()
    assert len(p) == 3 and all(r["has_more"] for r in p)
    s = {r["doc"]: r["snippet"] for r in search.page(i, search.parse_query("eclair"), 10).collect()}
    assert s[5].startswith("...") and s[5].endswith("[eclair]") and not search.page(i, search.parse_query("eclair"), 10).first()["has_more"]
    e = search.envelope({"a": i, "b": i}, search.parse_query("banana"), 1).collect()
    assert [(r["scope"], r["doc"], r["has_more"]) for r in sorted(e)] == [("a", "8", True), ("b", "8", True)]
    plan = search._hits(i, search.parse_query("banana"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [(bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    texts = spark.createDataFrame([(1, "s", "a b c"), (2, "t", "a b c")], "doc bigint, source_id string, text string")
    on = spark.createDataFrame([("s", 1), ("t", 0)], "id string, fts5_index_logs int")
    assert [r["doc"] for r in search.logged(texts, on).collect()] == [1]
    assert [r["doc"] for r in search.match(texts, "doc", "text", search.parse_query('"b c" NOT d')).collect()] == [1, 2]


# ---- prices -----------------------------------------------------------------------------------------------
def test_price_tiers(spark):
    p = spark.createDataFrame([("Prov", ["pv"], "M", None, 10, 1.0, 2.0, 0.5, 0.25), ("Prov", ["pv"], "M", None, 20, 3.0, 4.0, None, None)], "provider string, provider_aliases array<string>, model string, model_aliases array<string>, effective_day bigint, input_per_million double, output_per_million double, cache_read_per_million double, cache_write_per_million double")
    day = 86_400_000_000
    o = spark.createDataFrame([(0, "PV", "m", 9 * day), (1, "pv", "m", 10 * day), (2, "Prov", "M", 25 * day), (3, None, "M", 25 * day), (4, "pv", "x", 25 * day), (5, "pv", "m", 0)], "i int, provider string, model string, start_ts bigint")
    o = o.withColumn("kind", F.lit("llm")).withColumn("tokens_in", F.lit(1_000_000)).withColumn("tokens_out", F.lit(1_000_000))
    r = related.priced(o, related.price_keys(p))
    assert {x["i"]: x["priced_usd"] for x in r.collect()} == {0: None, 1: 3.0, 2: 7.0, 3: None, 4: None, 5: 7.0}
    assert related.price_misses(r).count() == 3
    c = o.withColumn("tokens_cache_read", F.lit(2_000_000)).withColumn("tokens_cache_write", F.lit(4_000_000)).withColumn("cost_usd", F.when(F.col("i") == 2, 9.0).otherwise(0.0)).withColumn("session_id", F.lit("s")).withColumn("turn_seq", F.col("i") % 2)
    k = related.price_keys(p)
    assert {x["i"]: x["cost_usd"] for x in related.on_finalize(c, k).collect()} == {0: 0.0, 1: 5.0, 2: 9.0, 3: 0.0, 4: 0.0, 5: 7.0}
    assert {x["i"]: x["cost_usd"] for x in related.repriced(c.withColumn("tokens_in", F.when(F.col("i") == 5, 0).otherwise(F.col("tokens_in"))), k).collect()} == {0: 0.0, 1: 5.0, 2: 9.0, 3: 0.0, 4: 0.0, 5: 0.0}
    turns, total = related.cost_cascade(related.repriced(c, k))
    assert {r["turn_seq"]: r["cost_usd"] for r in turns.collect()} == {0: 9.0, 1: 12.0} and total.first()["cost_usd"] == 21.0


# ---- statistics windows, relations, trees, parity -----------------------------------------------------------
def test_windows_and_dimensions():
    assert rollups.window(SessionFilter(from_us=5, to_us=9), 100) == (5, 9) and rollups.window(SessionFilter(), 100) == (0, 101)
    assert rollups.is_stored(SessionFilter(from_us=1, group="all")) and not rollups.is_stored(SessionFilter(q="x"))
    assert rollups.dimension_param("", rollups.RANKED) == "model" and rollups.dimension_param("cwd", rollups.GROUPS) == "cwd"
    with pytest.raises(BadRequest):
        rollups.dimension_param("total", rollups.RANKED)


def test_related_by_time_of_a_hot_directory(spark, monkeypatch):
    monkeypatch.setattr(related, "STARTS", 4)
    rnd = random.Random(5)
    rows = [(f"i{k:03d}", rnd.choice(["p", "p", "p", "q"]), rnd.choice("/~"), rnd.randrange(300), None if rnd.random() < 0.3 else 400, None) for k in range(150)]
    s = spark.createDataFrame(rows, "id string, source_id string, cwd string, start_ts bigint, end_ts bigint, first_user_message_hash string")
    got = {(r["session_id"], r["related_id"], r["pos"]) for r in related.related_by_time(s, s, 350, 3).collect()}
    want = set()
    for i, src, cwd, s0, s1, _ in rows:
        near = sorted((r0, j) for j, o, c, r0, _, _ in rows if c == cwd and o != src and s0 <= r0 <= (s1 or 350))[:3]
        want |= {(i, j, k) for k, (_, j) in enumerate(near, 1)}
    assert got == want


def test_truncated_topology(spark):
    s = spark.createDataFrame([(k, None if k == 1 else 1, k) for k in range(1, 5)], "id bigint, parent_session_id bigint, n bigint")
    for most, cut in ((3, True), (4, False)):
        top, edges = graph.cross_topology(s, "n", most)
        assert {(r["truncated"], r["max_size"]) for r in top.collect()} == {(cut, 4)} and edges.count() == (0 if cut else 3)


def test_merged_trees_end(spark):
    rows = [("a1", "a", None, "b"), ("a2", "a", "a1", None), ("b1", "b", None, "c"), ("b2", "b", "zz", None), ("c1", "c", None, None), ("x1", "x", None, "y"), ("y1", "y", None, "x"), ("s1", "s", None, "s")]
    t = graph.merged_tree(spark.createDataFrame(rows, "op_id string, session_id string, parent_op_id string, child_session_id string"))
    got = {r["op_id"]: (r["parent"], r["depth"], r["root"]) for r in t.collect()}
    assert got == {"a1": (None, 0, "a1"), "a2": ("a1", 1, "a1"), "b1": ("a1", 1, "a1"), "b2": ("a1", 1, "a1"), "c1": ("b1", 2, "a1"), "x1": ("y1", -1, None), "y1": ("x1", -1, None), "s1": (None, 0, "s1")}


def test_parity_rules(spark):
    S = "key string, cls string, availability string, hash_domain string, sha256 string, bytes bigint, chars bigint, selector string, synthetic boolean, reason string"
    a = lambda k, c="p", av="present", h="x", b=1, ch=None, sy=None, re=None: (k, c, av, "d", h, b, ch, "sel", sy, re)
    src = spark.createDataFrame([a("bad", av="corrupt"), a("two"), a("two"), a("dif", h="y", ch=3), a("nochars"), a("cls", "q"), a("gone"), a("same"), a("vague")], S)
    der = spark.createDataFrame([a("two"), a("dif", b=2, ch=4), a("nochars", ch=9), a("cls"), a("same"), a("more"), a("made", sy=True), a("said", sy=True, re="stub"), a("vague", av="unverifiable", h="z")], S)
    from loomspan.operators import parity

    assert {(r["key"], r["code"], r["field"]) for r in parity.findings(src, der).collect()} == {
        ("bad", "corrupt", "source"), ("two", "duplicate", "source"), ("dif", "differs", "sha256"), ("dif", "differs", "bytes"), ("dif", "differs", "chars"), ("cls", "class mismatch", "p"), ("gone", "missing", ""), ("more", "extra", "p"),
        ("made", "undocumented synthetic", "p"), ("vague", "unverifiable", "availability"),
    }


def test_log_pages_have_every_entry_once(spark):
    from loomspan.operators import links

    logs = spark.createDataFrame([(f"{k:02d}", k % 4, ("ERR", "WRN", "INF")[k % 3], '{"a":"b"}') for k in range(24)], "id string, ts bigint, severity string, extras string")
    seen, after = [], None
    while True:
        rows = links.log_page(logs, ("ERR", "WRN"), 5, after).collect()
        seen += [(r["ts"], r["id"]) for r in rows[:5]]
        if len(rows) <= 5:
            break
        after = seen[-1]
    assert seen == sorted(seen) and len(seen) == 16 and rows[0]["extras"] == {"a": "b"}
    with pytest.raises(BadRequest):
        links.log_page(logs, ("LOUD",), 5)


# ---- event folds ------------------------------------------------------------------------------------------
def event(i, kind, **p):
    return i, kind, json.dumps({"SourceID": "s", "Ts": i} | p)


EVENTS = [
    event(1, "session_finalized", SessionNativeID="a", Status="completed", EndTs=9), event(2, "session_started", NativeID="a", ParentNativeID="p", Kind="root", AgentName="x", Extras={"k": 1, "gone": 1}),
    event(3, "session_started", NativeID="a", ParentNativeID="", AgentName="", Extras={"gone": None, "n": "v"}), event(4, "session_updated", SessionNativeID="a", Model="m"),
    event(5, "session_updated", SessionNativeID="stub", Model="m"), event(6, "session_started", NativeID="p"), event(7, "session_updated", Model="lost"),
]
EV = "event_id bigint, kind string, payload string"


def test_session_folds_do_not_depend_on_rows_order_or_replay(spark):
    want = None
    for seed in (1, 2):
        rows = EVENTS * seed
        random.Random(seed).shuffle(rows)
        s = merge.fold_sessions(merge.session_events(spark.createDataFrame(rows, EV)))
        got = {r["native_id"]: (r["start_ts"], r["parent_native_id"], r["agent_name"], r["model"], r["status"], r["end_ts"], r["is_stub"]) for r in s.collect()}
        assert want is None or got == want
        want = got
    assert want == {"a": (2, "p", "x", "m", "completed", 9, False), "stub": (None, None, None, "m", "running", None, True), "p": (6, None, None, None, "running", None, False)}
    link = {r["native_id"]: r["parent_session_id"] is not None for r in merge.linked(s).collect()}
    assert link == {"a": True, "stub": False, "p": False}
    x = merge.merge_extras(merge.session_events(spark.createDataFrame(EVENTS, EV)))
    assert {(r["extra_key"], r["extra_value"]) for r in x.collect()} == {("k", "1"), ("n", "v")}


LEDGER = [
    {"recordType": "session_start", "seq": 1, "agentId": "weaver", "callPath": "hub/weaver", "headendId": "slack", "attributes": {"zone": 4}},
    {"record_type": "turn_start", "seq": "2", "turn": 1},
    {"recordType": "turn_end", "seq": 3, "turn": 1, "status": "ok", "accounting": {"tokensIn": 31, "tokensOut": 12, "costUsd": "0.25"}, "warnings": ["slow"], "errors": ["lost"], "ops": [
        {"opIndex": 4, "kind": "llm", "status": "ok", "startedAt": "2031-02-03T08:15:09.250Z", "endedAt": "2031-02-03T08:15:11.750Z", "provider": "north", "model": "loom-2", "accounting": {"tokensIn": 31, "tokensOut": 12, "tokensCacheRead": 7}, "payloadRefs": [{"kind": "llm_request", "path": "q/1", "originalBytes": 90}, {"kind": "llm_request", "path": "q/1", "originalBytes": 90}, {"kind": "llm_response", "path": "q/2", "originalBytes": 40}]},
        {"opIndex": 5, "kind": "tool", "status": "failed", "startedAt": "2031-02-03T08:15:12Z", "endedAt": "2031-02-03T08:15:10Z", "provider": "shelf", "name": "Fetch", "error": "no shelf", "accounting": [], "childSessions": [{"sessionId": "k1", "originId": "w"}, {"sessionId": "k2"}]},
        {"kind": "system", "status": "paused", "accounting": {"costUsd": "many", "tokensIn": 10**30}}]},
    {"recordType": "session_summary", "seq": 4, "status": "failed", "error": "Turn 3 failed after 5 attempts of 6 (maxTurns=10); last_error=rate_limit: 429; slugs=a, b.", "finalReport": {"format": "text", "captured": False}},
    {"recordType": "session_error", "seq": 5, "error": "gone", "attributes": {"why": "x"}},
]
RAW = "row_id bigint, source_id string, file_name string, line_no int, raw_text string"


def test_ledger_events_and_folds(spark):
    raw = [(i, "src", "f", i, json.dumps({"version": 3, "ts": f"2031-02-03T08:15:2{i}.000Z", "originId": "w", "sessionId": "w"} | o)) for i, o in enumerate(LEDGER)] + [(9, "src", "f", 9, "{")]
    src = spark.createDataFrame([("src", "{}")], "id string, meta_json string")
    ev = adapters.get("aiagent_v3")(spark.createDataFrame(raw * 2, RAW), src)
    kinds = [r["kind"] for r in ev.dropDuplicates(["file", "rec", "sub"]).orderBy("rec", "sub").collect()]
    assert kinds == [
        "session_started", "turn_started", "turn_finalized", "op_started", "op_finalized", "payload_ref", "payload_ref", "payload_ref", "op_started", "op_finalized", "session_started", "session_started", "op_started", "op_finalized",
        "log_entry", "log_entry", "session_finalized", "session_updated", "session_updated", "log_entry", "session_finalized", "log_entry", "session_updated", "source_error",
    ]
    ops = {r["op_seq"]: r for r in merge.fold_ops(ev).collect()}
    assert (ops[4]["duration_us"], ops[4]["status"], ops[4]["model"], ops[4]["ctx_used"], ops[4]["bytes_in"], ops[4]["bytes_out"], ops[4]["provider"]) == (2_500_000, "completed", "loom-2", 50, 180, 40, "north")
    assert (ops[5]["end_ts"], ops[5]["status"], ops[5]["error_message"], ops[5]["child_session"], ops[5]["namespace"], ops[5]["ctx_used"]) == (None, "failed", "no shelf", "k1", "shelf", None)
    assert (ops[2]["status"], ops[2]["cost_usd"], ops[2]["tokens_in"]) == ("paused", 0.0, 0)
    t = merge.fold_turns(ev).collect()
    assert len(t) == 1 and (t[0]["tokens_in"], t[0]["cost_usd"], t[0]["status"]) == (31, 0.25, "completed")
    refs = merge.payload_refs(ev)
    assert refs.count() == 2 and merge.orphan_refs(refs, merge.fold_ops(ev).where("op_seq = 5")).count() == 2
    s = {r["native_id"]: r for r in merge.fold_sessions(merge.wide_session_events(ev)).collect()}
    assert (s["w"]["status"], s["w"]["kind"], s["w"]["agent_name"], s["w"]["error_class"]) == ("failed", "root", "weaver", "session_error")
    assert (s["k1"]["kind"], s["k1"]["parent_native_id"], s["k1"]["root_native_id"], s["k2"]["root_native_id"]) == ("sub_agent", "w", "w", "w")


@pytest.mark.parametrize("headend,kind", [("cli", "root"), ("api", "root"), ("embed", "root"), ("tool_output", "internal"), ("history_compaction", "sub_agent"), (None, "sub_agent")])
def test_headends(headend, kind):
    assert adapters.headend_kind(headend) == kind


@pytest.mark.parametrize("text,cls,found", [
    ("Turn 3 failed after 5 attempts of 6 (maxTurns=10); last_error=rate_limit: 429; slugs=a, b.", "rate_limit", {"error_detail": "429", "error_slugs": ["a", "b"], "attempts": 5, "max_attempts": 6, "max_turns": 10}),
    ("x; last_error=AI_RetryError; slugs=", "provider_error", {}), ("x; last_error=No output at all", "provider_error", {}), ("x; last_error=odd one", "odd one", {}),
    ("Session completed without a final report after 4 turns.", "no_final_report", {}), ("plain", None, {}), ({"a": 1}, None, {}),
])
def test_failures(text, cls, found):
    assert adapters.failure(text) == (cls, found)


@pytest.mark.parametrize("text,want", [("vrb", "DBG"), ("DEBUG", "DBG"), ("info", "INF"), ("Warning", "WRN"), ("WARN", "WRN"), ("ERROR", "ERR"), ("fatal", "ERR"), ("odd", "INF"), (None, "INF"), (7, "INF")])
def test_severities(text, want):
    assert adapters.severity(text) == want


def node(**f):
    return {"traceId": "r", "startedAt": 1_930_000_000_000} | f


@pytest.mark.parametrize("tree,want", [
    (node(success=True, turns=[{}]), "completed"), (node(success="false"), "failed"), (node(endedAt=1_930_000_001_000), "interrupted"), (node(), "abandoned"), (node(turns=[{"index": 0}]), "running"), (node(steps=[{}]), "running"),
])
def test_states_of_snapshot_sessions(tree, want):
    ev = adapters.snapshot_events(tree, {}, None)
    assert ([e["status"] for e in ev if e["kind"] == "session_finalized"] or ["running"]) == [want]


@pytest.mark.parametrize("states,want", [([], "completed"), (["ok", "ok"], "completed"), (["ok", "failed", ""], "failed"), (["ok", ""], "running"), (["ok", "odd"], "running")])
def test_states_of_snapshot_turns(states, want):
    turn = {"index": 2, "endedAt": 1_930_000_002_000, "ops": [{"status": s} for s in states]}
    for part, seq in (("turns", 2), ("steps", 10_002)):
        ev = adapters.snapshot_events(node(**{part: [turn]}), {}, None)
        assert [(e["turn_seq"], e["status"]) for e in ev if e["kind"] == "turn_finalized"] == [(seq, want)]


def test_snapshot_events(spark):
    tokens = {"inputTokens": 9, "outputTokens": 4, "cachedTokens": 2, "cacheWriteInputTokens": 1}
    deep = node(traceId="d299")
    for k in reversed(range(299)):  # far deeper than any recursion
        deep = node(traceId=f"d{k}", turns=[{"index": 0, "ops": [{"opId": "o", "kind": "session", "status": "ok", "childSession": deep}]}])
    ops = [
        {"opId": "o1", "kind": "llm", "status": "ok", "attributes": {"model": "loom-2", "provider": "north"}, "accounting": [{"type": "llm", "tokens": tokens, "costUsd": 0.5}, {"type": "llm", "tokens": tokens}], "reasoning": {"final": "so"}},
        {"opId": "o2", "kind": "tool", "status": "failed", "attributes": {"name": "Fetch", "provider": "shelf", "error": "no shelf"}, "request": {"size": 3}, "response": {"size": 5}, "logs": [{"severity": "warn", "message": "m", "path": "1.2"}]},
        {"opId": "o3", "kind": "system", "status": "ok", "attributes": {"label": "init"}}, {"opId": "o4", "kind": "session", "status": "ok", "childSessionRef": {"sessionId": "far"}},
        {"opId": "o5", "kind": "session", "status": "ok", "childSession": deep},
    ]
    tree = node(agentId="weaver", turns=[{"index": 0, "startedAt": 1_930_000_000_000, "endedAt": 1_930_000_009_000, "ops": ops}], steps=[{"index": 1, "kind": "internal", "ops": []}], success="true", endedAt=1_930_000_010_000)
    src = spark.createDataFrame([("src", None)], "id string, meta_json string")
    raw = spark.createDataFrame([(1, "src", "f", json.dumps({"version": 2, "opTree": tree})), (2, "src", "g", "{"), (3, "src", "h", None)], "row_id bigint, source_id string, file_name string, raw_text string")
    ev = adapters.get("aiagent_v2")(raw, src).cache()
    mine = [e["kind"] for e in ev.where("session = 'r'").orderBy("sub").collect()]
    assert mine == [
        "session_started", "turn_started", "op_started", "op_finalized", "op_started", "op_finalized", "op_started", "op_finalized", "log_entry", "log_entry", "op_started", "op_finalized", "op_started", "op_finalized", "op_started", "op_finalized",
        "turn_finalized", "turn_started", "session_updated", "session_finalized",
    ]
    o = {r["op_seq"]: r for r in merge.fold_ops(ev.where("session = 'r'")).collect()}
    assert (o[0]["tokens_in"], o[0]["tokens_cache_read"], o[0]["ctx_used"], o[0]["cost_usd"], o[0]["model"]) == (9, 2, 16, 0.5, "loom-2")
    assert (o[1]["namespace"], o[1]["error_class"], o[1]["bytes_in"], o[1]["bytes_out"]) == ("shelf", "no shelf", 3, 5)
    assert (o[2]["name"], o[3]["child_session"], o[4]["child_session"], o[5]["op_kind"], o[5]["parent_op_seq"]) == ("init", "far", "d0", "reasoning", 0)
    assert {(e["severity"], e["message"]) for e in ev.where("kind = 'log_entry'").collect()} == {("WRN", "m"), ("ERR", "no shelf")}
    s = {r["native_id"]: r for r in merge.fold_sessions(merge.wide_session_events(ev)).collect()}
    assert len(s) == 301 and s["d299"]["parent_native_id"] == "d298" and s["d299"]["root_native_id"] == "r" and s["r"]["model"] == "loom-2" and s["r"]["status"] == "completed"
    assert ev.where("kind = 'source_error'").count() == 2 and adapters.formats() == ["aiagent_v2", "aiagent_v3", "claude_code", "codex", "opencode"]


# ---- transcripts ------------------------------------------------------------------------------------------
LINE = "session_id string, agent_id string, line_id bigint, line_type string, uuid string, is_meta boolean, is_compact_summary boolean, message string, source_id string, line_timestamp string, cwd string, subtype string"


def said(i, kind, content=..., agent=None, meta=None, compact=None, uuid=None, subtype=None, **m):
    message = None if content is ... else json.dumps({"role": kind, "content": content} | m)
    return "s", agent, i, kind, uuid or f"u{i}", meta, compact, message, "src", f"2031-02-03T08:15:{10 + i}.000Z", "/w" if i == 2 else None, subtype


def test_transcript_events(spark):
    lines = [
        said(1, "assistant", [{"type": "text", "text": "hello"}], model="loom-1"), said(2, "user", "go [now]"),
        said(3, "assistant", [{"type": "tool_use", "id": "t1", "name": "mcp__db__q"}, {"type": "thinking", "thinking": "hé"}, {"type": "tool_use", "id": "t2", "name": "Read"}, {"type": "tool_use", "id": "t3", "name": "Agent"}], model="loom-2", usage={"input_tokens": 5, "output_tokens": "6"}),
        said(4, "user", [{"type": "tool_result", "tool_use_id": "t1", "is_error": True}]), said(5, "user", [{"type": "tool_result", "tool_use_id": "t1", "is_error": False}, {"type": "text", "text": "more"}], uuid="u5"),
        said(6, "user", [{"type": "text", "text": "again"}], uuid="u5"), said(7, "user", "[1, 2]"), said(8, "user", " "), said(9, "user", "x", meta=True), said(10, "user", "x", compact=True), said(11, "assistant", "x", model="<synthetic>"),
        said(12, "system", subtype="init"), said(13, "user", "side", agent="a1"), said(14, "odd", "x"),
    ]
    df = spark.createDataFrame(lines, LINE)
    src = spark.createDataFrame([("src", None)], "id string, meta_json string")
    got = [(r["agent"], r["turn_seq"], r["op_seq"], r["op_kind"], r["name"], r["namespace"], r["status"], r["tokens_out"]) for r in transcripts.transcript_ops(df).orderBy("agent", "turn_seq", "op_seq").collect()]
    assert got == [
        ("", 1, 1, "llm", "loom-1", None, "completed", 0), ("", 2, 1, "internal", "user_input", None, "completed", 0), ("", 2, 2, "llm", "loom-2", None, "completed", 6), ("", 2, 3, "reasoning", None, None, "completed", 0),
        ("", 2, 4, "tool", "q", "mcp:db", "failed", 0), ("", 2, 5, "tool", "Read", "builtin", "running", 0), ("", 2, 6, "session", "Agent", "builtin", "running", 0), ("", 2, 7, "internal", "user_input", None, "completed", 0),
        ("", 3, 1, "internal", "user_input", None, "completed", 0), ("a1", 1, 1, "internal", "user_input", None, "completed", 0),
    ]
    ev = adapters.get("claude_code")(df, src).cache()
    assert {r["kind"]: r["count"] for r in ev.groupBy("kind").count().collect()} == {
        "session_started": 2, "session_updated": 1, "turn_started": 3, "turn_finalized": 2, "op_started": 10, "op_finalized": 8, "payload_ref": 9, "log_entry": 4,
    }
    s = {r["native_id"]: r for r in merge.fold_sessions(merge.wide_session_events(ev)).collect()}
    assert (s["s"]["cwd"], s["s"]["model"], s["s"]["kind"], s["s"]["status"]) == ("/w", "loom-1", "root", "running") and (s["s:agent:a1"]["kind"], s["s:agent:a1"]["parent_native_id"]) == ("sub_agent", "s")
    o = {(r["session"], r["turn_seq"], r["op_seq"]): r for r in merge.fold_ops(ev).collect()}
    assert (o["s", 2, 4]["error_class"], o["s", 2, 4]["duration_us"], o["s", 2, 3]["bytes_out"], o["s", 2, 3]["parent_op_seq"]) == ("tool_error", 1_000_000, 3, 1)
    assert adapters.get("claude_code")(df.limit(0), src).count() == 0


# ---- rollouts ---------------------------------------------------------------------------------------------
ROLLOUT = [
    ("session_meta", {"id": "n1", "cwd": "/w", "originator": "tty", "forked_from_id": "n0"}), ("event_msg", {"type": "task_started"}), ("turn_context", {"model": "loom-3"}), ("response_item", {"type": "message", "role": "user"}),
    ("response_item", {"type": "function_call", "name": "exec_command", "call_id": "1"}), ("response_item", {"type": "function_call_output", "call_id": "1", "output": "Error: no such shelf"}),
    ("response_item", {"type": "custom_tool_call", "name": "apply_patch", "call_id": "2"}), ("response_item", {"type": "custom_tool_call_output", "call_id": "2", "output": "an error is mentioned"}),
    ("response_item", {"type": "function_call", "name": "write", "call_id": "3"}), ("response_item", {"type": "function_call_output", "call_id": "3", "output": "Operation not permitted"}),
    ("event_msg", {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 40, "cached_input_tokens": 10, "output_tokens": 7}, "total_token_usage": {"total_tokens": 57}}}),
    ("event_msg", {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 5, "cached_input_tokens": 30, "output_tokens": 2}, "total_token_usage": {"total_tokens": 94}}}),
    ("response_item", {"type": "message", "role": "assistant"}), ("response_item", {"type": "local_shell_call", "call_id": "4"}), ("event_msg", {"type": "task_complete"}),
    ("event_msg", {"type": "task_started"}), ("response_item", {"type": "function_call", "name": "odd", "call_id": "5"}), ("event_msg", {"type": "turn_aborted", "reason": "interrupted"}),
    ("event_msg", {"type": "task_started"}), ("response_item", {"type": "reasoning"}), ("event_msg", {"type": "task_started"}), ("response_item", {"type": "function_call", "name": "view_image", "call_id": "6"}),
]


def test_rollout_events(spark):
    raw = spark.createDataFrame([("src", "f", i, json.dumps({"timestamp": f"2031-02-03T08:{10 + i}:00.000Z", "type": t, "payload": p})) for i, (t, p) in enumerate(ROLLOUT)], "source_id string, file string, line_no bigint, raw_text string")
    src = spark.createDataFrame([("src", None)], "id string, meta_json string")
    got = [(r["turn_seq"], r["op_seq"], r["op_kind"], r["name"], r["namespace"], r["model"], r["status"], r["error_class"], r["tokens_in"], r["tokens_cache_read"], r["ctx_used"]) for r in rollouts.rollout_ops(raw).orderBy("turn_seq", "op_seq").collect()]
    assert got == [
        (1, 1, "internal", None, None, None, "completed", None, 0, 0, 0), (1, 2, "tool", "exec_command", "shell", None, "failed", "tool_error", 0, 0, 0), (1, 3, "tool", "apply_patch", "custom", None, "completed", None, 0, 0, 0),
        (1, 4, "tool", "write", "fs", None, "failed", "sandbox_denied", 0, 0, 0), (1, 5, "llm", None, None, "loom-3", "completed", None, 30, 40, 94), (1, 6, "tool", "shell", "shell", None, "completed", None, 0, 0, 0),
        (2, 1, "tool", "odd", "custom", None, "cancelled", None, 0, 0, 0), (3, 1, "reasoning", None, None, None, "completed", None, 0, 0, 0), (4, 1, "tool", "view_image", "fs", None, "running", None, 0, 0, 0),
    ]
    fate = lambda now: [(t["turn_seq"], t["status"], t["error_class"]) for t in merge.fold_turns(rollouts.rollouts(raw, src, now)).orderBy("turn_seq").collect()]
    ended = [(1, "completed", None), (2, "failed", "user_interrupt"), (3, "failed", "replaced")]
    assert fate(None) == [*ended, (4, "running", None)] and fate(10**16) == [*ended, (4, "failed", "incomplete")]
    s = merge.fold_sessions(merge.wide_session_events(rollouts.rollouts(raw, src, 10**16))).first()
    assert (s["native_id"], s["kind"], s["parent_native_id"], s["root_native_id"], s["agent_name"], s["cwd"], s["model"], s["status"]) == ("n1", "fork", "n0", "n0", "codex:tty", "/w", "loom-3", "failed")
    o = {(r["turn_seq"], r["op_seq"]): r["status"] for r in merge.fold_ops(rollouts.rollouts(raw, src, 10**16)).collect()}
    assert o[4, 1] == "cancelled" and o[2, 1] == "cancelled"
    legacy = spark.createDataFrame([(k, "src", "g", json.dumps({"session": {"id": "z"}, "items": [p for t, p in ROLLOUT if t == "response_item"]})) for k in (1, 2)], "row_id bigint, source_id string, file_name string, raw_text string")
    got = [(r["op_kind"], r["namespace"], r["status"]) for r in rollouts.legacy_ops(legacy).orderBy("op_seq").collect()]
    assert got[:3] == [("internal", None, "completed"), ("tool", "shell", "failed"), ("tool", "custom", "completed")] and len(got) == 9


# ---- session store ----------------------------------------------------------------------------------------
def write_store(path):
    t = lambda i, o, c, r: {"input": i, "output": o, "cache": {"read": c, "write": r}}
    ask = lambda **f: json.dumps({"role": "assistant", "modelID": "loom-4", "providerID": "north"} | f)
    with sqlite3.connect(path) as c:
        c.execute("create table session (id text primary key, parent_id text, directory text, agent text, time_created int, time_updated int, time_archived int)")
        c.execute("create table message (id text primary key, session_id text, time_created int, time_updated int, data text)")
        c.execute("create table part (id text primary key, message_id text, session_id text, time_created int, time_updated int, data text)")
        c.executemany("insert into session values (?,?,?,?,?,?,?)", [("a", None, "/w", "weaver", 100, 100, 900), ("b", "a", "/w", None, 200, 200, None), ("c", "b", None, None, 250, 250, None), ("l1", "l2", None, None, 1, 1, None), ("l2", "l1", None, None, 1, 1, None)])
        c.executemany("insert into message values (?,?,?,?,?)", [
            ("m0", "a", 110, 110, json.dumps({"role": "user"})), ("m1", "a", 120, 130, ask(tokens=t(10, 3, 1, 0), cost=0.5, time={"completed": 170})), ("m2", "a", 180, 180, ask(tokens=t(25, 2, 4, 9), cost=0.25)),
            ("m3", "b", 210, 210, ask(error={"name": "Overload", "data": {"message": "busy"}})), ("m4", "a", 190, 190, ask()),
        ])
        part = lambda i, m, s, at, **d: (i, m, s, at, at, json.dumps(d))
        c.executemany("insert into part values (?,?,?,?,?,?)", [
            part("p1", "m1", "a", 121, type="step-start"), part("p2", "m1", "a", 122, type="reasoning"), part("p3", "m1", "a", 123, type="tool", tool="shelf_fetch_all", state={"status": "completed", "input": {"q": 1}, "output": "né", "time": {"start": 124, "end": 126}}),
            part("p4", "m1", "a", 127, type="step-finish", tokens=t(6, 1, 0, 0), cost=0.2), part("p5", "m1", "a", 128, type="step-start"), part("p6", "m1", "a", 129, type="step-start"), part("p7", "m1", "a", 131, type="step-finish", tokens=t(10, 3, 1, 0), cost=0.3),
            part("p8", "m2", "a", 181, type="tool", tool="task", state={"status": "error", "error": "late", "metadata": {"sessionId": "b"}, "time": {"start": 182, "end": 180}}), part("p9", "m2", "a", 183, type="step-finish", tokens=t(1, 1, 0, 0)),
            part("q1", "m4", "a", 191, type="tool", tool="read", state={"status": "running"}),
        ])


def test_store_events(spark, tmp_path):
    datasources.register(spark)
    path = str(tmp_path / "s.db")
    write_store(path)
    raw = store.read_store(spark, path, "src").cache()
    ev = adapters.get("opencode")(raw, None).cache()
    o = {(r["turn_seq"], r["op_seq"]): r for r in merge.fold_ops(ev.where("session = 'a'")).collect()}
    assert [(k, r["op_kind"], r["name"], r["namespace"], r["status"], r["duration_us"], r["tokens_in"], r["tokens_out"], r["cost_usd"], r["ctx_used"]) for k, r in sorted(o.items())] == [
        ((1, 1), "llm", "loom-4", None, "completed", 6000, 6, 1, 0.2, 7), ((1, 2), "reasoning", None, None, "completed", 0, 0, 0, 0.0, None), ((1, 3), "tool", "fetch_all", "shelf", "completed", 2000, 0, 0, 0.0, None),
        ((1, 4), "llm", "loom-4", None, "cancelled", 1000, 0, 0, 0.0, None), ((1, 5), "llm", "loom-4", None, "completed", 2000, 4, 2, 0.3, 14), ((2, 1), "session", "task", None, "failed", 0, 0, 0, 0.0, None), ((3, 1), "tool", "read", None, "running", None, 0, 0, 0.0, None),
    ]
    assert o[1, 3]["bytes_out"] == 3 and o[2, 1]["child_session"] == "b" and o[1, 2]["parent_op_seq"] == 1
    turns = {(r["session"], r["turn_seq"]): (r["status"], r["error_class"], r["tokens_in"], r["tokens_out"], r["cost_usd"]) for r in merge.fold_turns(ev).collect()}
    assert turns == {("a", 1): ("completed", None, 10, 3, 0.5), ("a", 2): ("completed", None, 15, 0, 0.25), ("a", 3): ("running", None, None, None, None), ("b", 1): ("failed", "Overload", 0, 0, 0.0)}
    s = {r["native_id"]: (r["kind"], r["root_native_id"], r["status"], r["error_class"]) for r in merge.fold_sessions(merge.wide_session_events(ev)).collect()}
    assert s == {"a": ("root", "a", "completed", None), "b": ("sub_agent", "a", "failed", "Overload"), "c": ("sub_agent", "a", "running", None), "l1": ("sub_agent", "l1", "running", None), "l2": ("sub_agent", "l2", "running", None)}
    assert {r["tbl"]: (r["last_id"], r["last_updated"], r["n_rows"]) for r in store.change_probe(raw).collect()} == {"session": ("l2", 250, 5), "message": ("m4", 210, 5), "part": ("q1", 191, 10)}
    assert {(r["tbl"], r["id"]) for r in store.read_store(spark, path, "src", sessions=["b"]).collect()} == {("session", "b"), ("message", "m3")}
    assert {r["id"] for r in store.read_store(spark, path, "src", since=200).collect()} == {"b", "c", "m3"}


# ---- files and streams ------------------------------------------------------------------------------------
def test_files(spark, tmp_path):
    for n in ("a.json.gz", ".b.json.gz", "c.tmp-1.json.gz"):
        with gzip.open(tmp_path / n, "wt") as f:
            f.write('{"opTree":\n{}}')
    assert [(r["file_name"], r["raw_text"]) for r in adapters.read_snapshots(spark, str(tmp_path)).collect()] == [("a.json.gz", '{"opTree":\n{}}')]
    (tmp_path / "x.jsonl").write_text('{"m":{"t":["a","b~/"]}}\nsecond\n')
    assert adapters.read_lines(spark, str(tmp_path)).count() == 2
    uri = f"file://{tmp_path}/x.jsonl"
    assert adapters.read_payload(uri + "#L2", [str(tmp_path)]) == b"second\n"
    assert adapters.read_payload(uri + "?json_pointer=%2Fm%2Ft%2F1#L1", [str(tmp_path)]) == b"b~/"
    assert adapters.read_payload(f"file://{tmp_path}/a.json.gz", [str(tmp_path)], cap=3) == b'{"o'
    with pytest.raises(PermissionError):
        adapters.read_payload("file:///etc/hostname", [str(tmp_path)])
    cut, was_cut = adapters.payload_preview(json.dumps({"a": [1, {"b": "é"}], "c": "x" * 99}), 30)
    assert was_cut and len(cut.encode()) <= 30 and json.loads(cut)["a"] == [1, {"b": "é"}] and adapters.payload_preview("short", 30) == ("short", False)
    assert adapters.extract_text('{"b":{"text":"2"},"a":[{"text":"1"}]}') == "1\n2" and adapters.extract_text("{") == "{"


def test_sqlite_source(spark, tmp_path):
    datasources.register(spark)
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as c:
        c.execute("create table session (id text primary key, time_updated int, cost real)")
        c.executemany("insert into session values (?, ?, 1.5)", [(f"s{i}", i // 2) for i in range(10)])
    read = lambda **o: spark.read.format("sqlite_table").options(path=path, table="session", columns="id:string,time_updated:bigint,parent_id:string", rows="3", **o).load()
    assert read().count() == 10 and read().where("parent_id is null").count() == 10
    assert {r["id"] for r in read(since="4").collect()} == {"s8", "s9"}
    with pytest.raises(Exception, match="lacks"):
        read(required="parent_id").count()


def test_growing_files(spark, tmp_path):
    r = datasources._TailReader({"path": str(tmp_path)})
    f = tmp_path / "a.jsonl"
    f.write_bytes(b"one\ntw")
    rows, o1 = r.read(r.initialOffset())
    assert [x[2] for x in rows] == ["one"]
    f.write_bytes(b"one\ntwo\nthree\n")
    rows, o2 = r.read(o1)
    assert [x[2] for x in rows] == ["two", "three"]
    assert [x[2] for x in r.readBetweenOffsets(o1, o2)] == ["two", "three"] and not list(r.read(o2)[0])
    small = datasources._TailReader({"path": str(tmp_path), "maxBytesPerFile": "4"})
    f.write_bytes(b"a line that is longer than a step\nnext\n")
    rows, o1 = small.read(small.initialOffset())
    assert [x[2] for x in rows] == ["a line that is longer than a step"] and [x[2] for x in small.read(o1)[0]] == ["next"]


DAY = 86_400_000_000


def day(i, kind, at, **p):
    return i, kind, json.dumps({"SourceID": "s", "Ts": at * DAY + i} | p)


STREAMED = [
    [day(1, "session_started", 3, NativeID="a", AgentName="x"), day(2, "session_started", 5, NativeID="b", AgentName="y"), day(3, "session_started", 9, NativeID="open")],
    [day(4, "session_started", 1, NativeID="late", AgentName="x"), day(5, "session_updated", 6, SessionNativeID="a", AgentName="z"), day(6, "session_finalized", 6, SessionNativeID="b", Status="failed", EndTs=1)],
    [day(7, "session_started", 2, NativeID="b"), day(8, "source_error", 6)],
]


def test_stream_equals_batch(spark, tmp_path):
    log, out = (str(tmp_path / x) for x in ("log", "out"))
    dirs = [str(tmp_path / "in0"), str(tmp_path / "in1")]
    now = 9 * DAY + 5
    src = spark.createDataFrame([("s", 1), ("t", 1), ("off", 0)], "id string, enabled int")
    for d in dirs:
        spark.createDataFrame([], EV).coalesce(1).write.parquet(f"{d}/none")
    for k, part in enumerate(STREAMED):  # from two sources, late and out of order
        spark.createDataFrame(part, EV).coalesce(1).write.parquet(f"{dirs[k % 2]}/{k}")
        q = ingest.start(ingest.read_events(spark, dirs), log, out, str(tmp_path / "cp"), once=True, sources=src, clock=lambda: now)
        q.awaitTermination()
    events = [e for part in STREAMED for e in part]
    want = merge.fold_sessions(merge.session_events(spark.createDataFrame(events, EV)))
    rows = lambda: sorted(map(str, spark.read.schema(want.schema).parquet(f"{out}/sessions").select(*want.columns).collect()))
    assert rows() == sorted(map(str, want.collect()))
    stored = lambda: {(r["bucket_ts"] // DAY, r["agent_name"], r["session_starts"], r["failures"]) for r in spark.read.schema(ingest._BUCKETS).parquet(f"{out}/rollup").collect()}
    closed = {(3, "z", 1, 0), (1, "x", 1, 0), (2, "y", 1, 1), (5, "", 0, 0)}  # the start of b moved, a was renamed, the ninth day is open
    assert stored() == closed
    ingest.close_buckets(spark, out, 10 * DAY)
    assert stored() == closed | {(9, "", 1, 0)}
    p = spark.read.parquet(f"{out}/progress").collect()
    assert [(r["source_id"], r["last_seq"], r["n_errors"]) for r in p] == [("s", 8, 1)]
    assert {r["source_id"]: r["state"] for r in spark.read.parquet(f"{out}/states").collect()} == {"s": "failing", "t": "waiting", "off": "disabled"}
    assert {r["native_id"]: r["parent_session_id"] for r in ingest.links(spark, out).collect()}.keys() == {"a", "b", "late", "open"}
    feed = spark.read.option("basePath", f"{out}/notify").parquet(f"{out}/notify")
    assert {r["kind"] for r in feed.collect()} == {"session_changed", "stats_invalidated", "source_status_changed"}
    before = stored(), rows()
    ingest.step(spark, spark.createDataFrame(STREAMED[2], EV), 2, log, out, now)  # a repeated batch changes nothing
    assert (stored(), rows()) == before
    ingest.rebuild(spark, log, out, 10 * DAY)
    assert stored() == (closed - {(5, "", 0, 0)}) | {(9, "", 1, 0)}
    assert len(ingest.prune(spark, f"{out}/notify", now + 10 * DAY)) == 1 and not ingest.prune(spark, f"{out}/notify", now + 10 * DAY)
    batch = spark.createDataFrame(EVENTS, EV)
    feed = ingest.notifications(batch, 7)
    subs = spark.createDataFrame([("all", None, None), ("none", "other", None), ("stats", None, "stats_invalidated")], "subscriber string, source_id string, kind string")
    got = {r["subscriber"]: r["n"] for r in ingest.coalesced(ingest.matching(feed, subs)).groupBy("subscriber").agg(F.sum("n").alias("n")).collect()}
    assert got == {"all": 4, "stats": 1}


def test_totals_of_all_agents(spark):
    from loomspan import domain
    from loomspan.plans import analytics

    d = "/root/testdata/sf0.001"
    scoped, all_ = (analytics.QUERIES[q](spark, d).first() for q in ("stats_totals", "stats_totals_all"))
    assert all_["sessions"] == domain.load(spark, d).sessions.count() > scoped["sessions"]
    assert all_["ops"] > scoped["ops"]

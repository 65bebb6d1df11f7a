"""The general data problems on small hand-made rows: edge cases and brute force."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomspan.functions.instants import Reading, readings
from loomspan.operators import bad_rows, drift, flatten, hierarchy, instants

SOURCES = "id string, source_format string, meta_json string, _tz string"
LEDGER = "row_id bigint, source_id string, file_name string, line_no int, raw_text string, _tz string, reason string, _part int"


def sources(spark, rows=()):
    return spark.createDataFrame([(*r, "clash") for r in rows] or [("s1", "ledger", '{"tz":"Europe/Berlin"}', "x")], SOURCES)


def line(**f):
    o = {"version": 3, "recordType": "turn_start", "seq": 1, "ts": "2025-01-01T00:00:00.000Z", "originId": "o", "sessionId": "s", "turn": 1}
    return json.dumps({k: v for k, v in (o | f).items() if v is not ...})


# ---- bad rows ---------------------------------------------------------------------------------------------
LEDGER_CASES = [
    (None, None), ("", None), (" \t\r\n", None), (line(), None), ("\t" + line() + "\r", None), (line(version="3", seq="2", turn="1"), None),
    (line(ts=1735689600), None), (line() + "x", "syntax"), (line() + line(), "syntax"), ("[]", "syntax"), (line()[:-1], "syntax"), ("﻿" + line(), "syntax"),
    (line(seq=...), "fields"), (line(ts=None), "fields"), (line(originId=""), "fields"), (line(turn=...), "fields"), (line(recordType="turn_end"), "fields"),
    (line(version=4), "value"), (line(version="3.x"), "value"), (line(seq=0), "value"), (line(turn=-2), "value"), (line(recordType="Turn_End"), "value"),
    (line(ts="yesterday"), "value"), (line(ts="2025-02-31T00:00:00Z"), "value"), (line(recordType="turn_end", status="ok", ops=["x" * 200_000]), None),
]


def test_ledger_faults(spark):
    rows = [(i, "s1", "f", i, t, "c", "c", 0) for i, (t, _) in enumerate(LEDGER_CASES)] + [(None, None, None, None, "{", None, None, None)]
    got = {r["row_id"]: r["reason"] for r in bad_rows.ledger_faults(spark.createDataFrame(rows, LEDGER), sources(spark)).collect()}
    assert got == {i: w for i, (_, w) in enumerate(LEDGER_CASES) if w} | {-1: "syntax"}
    valid = bad_rows.valid_ledger(spark.createDataFrame(rows, LEDGER), sources(spark)).collect()
    assert {r["row_id"] for r in valid} == {i for i, (t, w) in enumerate(LEDGER_CASES) if w is None and t and t.strip()}


def test_rollout_and_export_faults(spark):
    ok = {"session": {"id": "a"}, "items": [{"type": "m"}]}
    cases = [
        (json.dumps(ok) + "\n\n", None), (json.dumps(ok) + "\x00", "syntax"), ("", "syntax"), (None, "syntax"), (json.dumps({"session": {}}), "fields"),
        (json.dumps({"session": {}, "records": []}), None), (json.dumps(ok | {"items": json.dumps([{"a": 1}])}), None), (json.dumps(ok | {"items": {"0": {}, "1": {}}}), None),
        (json.dumps(ok | {"items": 7}), "value"), (json.dumps(ok | {"session": "lost"}), "value"), (json.dumps(ok | {"session": None}), "fields"),
    ]
    r = spark.createDataFrame([(i, "s1", "f", t) for i, (t, _) in enumerate(cases)], "row_id bigint, source_id string, file_name string, raw_text string")
    assert {x["row_id"]: x["reason"] for x in bad_rows.rollout_faults(r).collect()} == {i: w for i, (_, w) in enumerate(cases) if w}
    assert bad_rows.valid_rollouts(r).count() == 4
    head = "0123456789abcdef0123456789abcdef,n,s,,r,"
    csv = [
        (head + "root,a,ok,1,2,0.5,", None), (head + 'root,a,ok,1,2,0.5,"x\ny"', None), (head + 'root,a,ok,1,2,0.5,"open', "syntax"), (head + "root,a,ok,1,2,0.5,a,b", "fields"),
        (head + "child,a,ok,1,2,0.5,", "value"), (head + "root,a,ok,-1,2,0.5,", "value"), (head + "root,a,ok,1,,0.5,", "value"), (head + "root,a,ok,1,2,1e3,", "value"), (None, "syntax"), ("", "syntax"),
    ]
    e = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(csv)], "row_id bigint, raw_text string")
    assert {x["row_id"]: x["reason"] for x in bad_rows.export_faults(e).collect()} == {i: w for i, (_, w) in enumerate(csv) if w}
    assert [x["error_message"] for x in bad_rows.valid_export(e).orderBy("row_id").collect()] == [None, "x\ny"]


def test_recovered_records_and_values_beyond_a_column(spark):
    head = "0123456789abcdef0123456789abcdef,n,s,,r,root,a,ok,"
    e = spark.createDataFrame([(1, head + "9999999999999999999,2,0.5,"), (2, head + "9223372036854775807,2,0.5,"), (3, head + '1,2,0.5,"open\n' + head + "5,2,0.5,x")], "row_id bigint, raw_text string")
    assert {r["row_id"]: r["reason"] for r in bad_rows.export_faults(e).collect()} == {1: "value", 3: "syntax"}
    assert [r["start_ts"] for r in bad_rows.valid_export(e).collect()] == [2**63 - 1]
    got = [(r["row_id"], r["part"], r["reason"]) for r in bad_rows.recovered(e, "session_export").orderBy("part").collect()]
    assert got == [(3, "fault", None), (3, "record", "")]
    led = spark.createDataFrame([(1, "s1", "f", 1, '{"broken": ' + line() + line(seq=0) + "{}", "c", "c", 0), (2, "s1", "f", 2, line(), "c", "c", 0), (3, "s1", "f", 3, line(seq=10**25), "c", "c", 0)], LEDGER)
    got = [(r["row_id"], r["part"], r["reason"]) for r in bad_rows.recovered(led, "ledger_lines", sources(spark)).orderBy("part", "part_no").collect()]
    assert got == [(1, "fault", None), (1, "record", ""), (1, "record", "value"), (1, "record", "fields")]
    assert {r["row_id"]: r["reason"] for r in bad_rows.ledger_faults(led, sources(spark)).collect()} == {1: "syntax", 3: "value"}


# ---- hierarchy --------------------------------------------------------------------------------------------
def brute(parents):
    out = {}
    for n in parents:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            p = parents[x]
            x = p if p in parents else None
        out[n] = (None, -1) if x is not None else (seen[-1], len(seen) - 1, tuple(reversed(seen)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    n = 160
    parents = {f"n{i:03d}": (f"n{rnd.randrange(n + 8):03d}" if rnd.random() < 0.2 else f"n{rnd.randrange(i):03d}" if i and rnd.random() < 0.9 else None) for i in range(n)}
    for i in range(60):  # one deep chain
        parents[f"c{i:02d}"] = f"c{i - 1:02d}" if i else None
    for i in range(7):  # a loop of seven, with something leading into it
        parents[f"l{i}"] = f"l{(i + 1) % 7}"
    parents |= {"into": "l3", "below": "into", "self": "self"}
    rows = [(k, v, 1) for k, v in parents.items()] + [(k, None, 0) for k in list(parents)[:20]] + [(None, "n000", 5), ("", "n001", 5)]
    df = spark.createDataFrame(rows, "id string, up string, at int")
    r = hierarchy.resolve(hierarchy.links(df, "id", "up", ["at"]))
    r = spark.createDataFrame(r.collect(), r.schema)
    rows = r.collect()
    want = brute(parents)
    assert {x["node"]: (x["top"], x["depth"]) for x in rows} == {k: v[:2] for k, v in want.items()}
    size = {k: sum(1 for v in want.values() if len(v) == 3 and k in v[2]) for k in want}
    assert all(x["size"] == size[x["node"]] for x in rows if not x["in_loop"])
    assert {x["node"]: tuple(x["path"]) for x in hierarchy.full_paths(r).collect()} == {k: v[2] for k, v in want.items() if len(v) == 3}
    ask = [k for k, v in want.items() if len(v) == 3][:40]
    below = hierarchy.descendants(r, spark.createDataFrame([(x,) for x in ask], "node string"))
    got = {(x["ancestor"], x["node"], x["below"]) for x in below.collect()}
    assert got == {(a, k, len(v[2]) - 1 - v[2].index(a)) for a in ask for k, v in want.items() if len(v) == 3 and a in v[2] and a != k}


def test_full_paths_of_both_forests(spark):
    from loomspan.plans import problems

    r = problems.p2_full_paths(spark, "/root/testdata/sf0.001").cache()
    assert {x["src_table"] for x in r.select("src_table").distinct().collect()} == {"sessions", "expected_events"}
    assert r.where("src_table = 'expected_events' and instr(full_path, '/') > 0").count() > 0
    assert r.where("not endswith(full_path, node_id)").count() == 0


def test_hierarchy_of_nothing(spark):
    s = spark.createDataFrame([], "id string, source_id string, parent_session_id string, ingested_at timestamp, row_id bigint, node string, ptr string")
    e = spark.createDataFrame([], "event_id bigint, kind string, payload string, size int")
    assert hierarchy.session_forest(s, e).count() == 0
    s = spark.createDataFrame([("a", None, "a ", None, None, "x", "y"), ("a ", "q", "", datetime(2025, 1, 1), 1, "x", "y")], s.schema)
    e = spark.createDataFrame([(1, "session_started", '{"NativeID":"a"}', 1), (None, "session_started", None, 1), (2, None, "{", 1)], e.schema)
    assert {(r["node_id"], r["depth"]) for r in hierarchy.session_forest(s, e).collect()} >= {("a ", 0)}


# ---- instants ---------------------------------------------------------------------------------------------
FORMS = [
    ("2025-01-06t06:49:21z", "2025-01-06 06:49:21"), ("2025-01-02 05:00:32", "2025-01-02 04:00:32"), ("1735929742.211", "2025-01-03 18:42:22.211"), ("20250102T204626Z", "2025-01-02 20:46:26"),
    ("1735971006233000803", "2025-01-04 06:10:06.233"), ("02.01.2025 03:04:14", "2025-01-02 02:04:14"), ("01/02/2025 02:31:03 PM", "2025-01-02 13:31:03"), ("Thu, 02 Jan 2025 21:52:08 GMT", "2025-01-02 21:52:08"),
    ("2025-03-13 13:40:21 PDT", "2025-03-13 20:40:21"), ("2025-01-05T08:34:08+01:00[Europe/Berlin]", "2025-01-05 07:34:08"), ("2025-10-26 02:30:00", "2025-10-26 00:30:00"), ("2025-01-05T09:41:32.521401682Z", "2025-01-05 09:41:32.521401"),
    ("2025-03-30 02:30:00", None), ("2026-02-31T10:00:00Z", None), ("13/13/2025 01:00:00 AM", None), ("n/a", None), ("", None), ("0", None), ("-5", None), ("13/02/2025 02:31:03 AM", None), ("x" * 100_000, None),
]


@pytest.mark.parametrize("text,want", FORMS)
def test_readings(text, want):
    got = readings(text, "Europe/Berlin")
    assert (str(datetime(1970, 1, 1) + timedelta(microseconds=got[0].utc_us)).removesuffix("000") if got else None) == (
        str(datetime.fromisoformat(want)).removesuffix("000") if want else None
    )


def test_long_times_are_read():
    text = "2025-01-05T09:41:32.521401682" + "0" * 30 + "+01:00[Europe/Berlin]"
    assert len(text) > 64 and readings(text, None)[0].utc_us == readings("2025-01-05T08:41:32.521401Z", None)[0].utc_us


def test_order_chooses_between_senses_of_a_zone(spark):
    src = sources(spark, [("s1", "x", '{"tz":"America/Chicago"}'), ("s2", "x", '{"tz":"America/Chicago"}')])
    # CST is -6 h for a writer in Chicago, unless only +8 h keeps the records in order
    rows = [(1, "s1", "2025-01-05T12:00:00.000Z"), (2, "s1", "2025-01-05 07:00:00 CST"), (3, "s1", "2025-01-05T14:00:00.000Z"), (4, "s2", "2025-01-04T20:00:00.000Z"), (5, "s2", "2025-01-05 07:00:00 CST"), (6, "s2", "2025-01-05T01:00:00.000Z")]
    t = spark.createDataFrame(rows, "line_id bigint, source_id string, line_timestamp string")
    got = {r["row_id"]: r["utc_us"] for r in instants.viterbi(instants.text_values(t, "t", "line_id", "line_timestamp", src)).collect()}
    at = lambda x: readings(x, None)[0].utc_us
    assert got[2] == at("2025-01-05T13:00:00Z") and got[5] == at("2025-01-04T23:00:00Z")


def test_viterbi_is_optimal_over_any_partitions(spark):
    rnd, rows, by = random.Random(3), [], {}
    for src in "AB":
        t = 1_700_000_000_000_000
        for k in range(50):
            t += rnd.randint(1, 5) * 3_600_000_000
            c = [Reading("x", t + rnd.choice([0, 86_400_000_000]), 0.0)]
            if rnd.random() < 0.85:
                c.append(Reading(rnd.choice("xyz"), t - rnd.randint(1, 20) * 3_600_000_000, rnd.choice([0.0, 0.5])))
            rows.append(("t", src, f"{k:05d}", k, True, *instants._pack(c)))
            by.setdefault(src, []).append(c)
    cost = lambda s: s[0].cost + sum(instants._step(a, b) for a, b in zip(s, s[1:]))
    best = {k: cost([c[q] for c, q in zip(v, instants._decode(v, None, None))]) for k, v in by.items()}
    for n in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got: dict = {}
        for r in instants.viterbi(spark.createDataFrame(rows, instants._SCHEMA)).collect():
            got.setdefault(r["source_id"], {})[r["row_id"]] = r["utc_us"]
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for k, v in by.items():
            assert cost([next(c for c in v[i] if c.utc_us == got[k][i]) for i in range(50)]) == pytest.approx(best[k])


def test_times_of_odd_rows(spark):
    t = spark.createDataFrame(
        [(1, "s1", "2025-01-01T00:00:00.000Z", 9), (2, "s1", "2025-01-01 00:00:00", 9), (2, "s1", "2025-01-01 00:00:00", 9), (3, None, "2025-01-01 00:00:00", 9), (4, "s1", None, 9), (None, "s1", "1735689600", 9)],
        "line_id bigint, source_id string, line_timestamp string, us int",
    )
    ledger = spark.createDataFrame([(1, "s1", "f", 1, line(ts=1735689600), "c", "c", 0), (2, None, None, None, None, None, None, None)], LEDGER)
    snap = spark.createDataFrame([(1, "s1", "f", '{"opTree":{"startedAt":1735689600123}}'), (2, "s1", "f", '{"opTree":{"startedAt":"1735689600123"}}'), (3, "s1", None, "{")], "row_id bigint, source_id string, file_name string, raw_text string")
    ses = spark.createDataFrame([(1, "s1", 1735689600), (2, "s1", 1735689600000000), (3, "s1", -1), (4, None, None)], "row_id bigint, source_id string, start_ts bigint")
    r = instants.project_times(t, ledger, snap, ses, sources(spark)).where("is_case").collect()
    base = 1_735_689_600_000_000
    assert sorted((x["src_table"], x["row_id"], x["utc_us"] - base) for x in r) == sorted(
        [("transcript_lines", 2, -3_600_000_000)] * 2 + [("transcript_lines", 3, 0), ("transcript_lines", -1, 0), ("ledger_lines", 1, 0), ("snapshot_files", 2, 123_000), ("sessions", 1, 0)]
    )
    none = [x.limit(0) for x in (t, ledger, snap, ses)]
    assert instants.project_times(*none, sources(spark)).count() == 0


# ---- drift ------------------------------------------------------------------------------------------------
BASE = [("legacy_rollouts", "session", "object", 1), ("legacy_rollouts", "items", "array", 1), ("legacy_rollouts", "session.cwd", "string", 1), ("legacy_rollouts", "session.id", "string", 1), ("legacy_rollouts", "items[].type", "string", 1), ("legacy_rollouts", "items[].name", "string", 0)]


def test_drift_kinds(spark):
    item = {"type": "m"}
    files = {
        "same": {"session": {"id": "1", "cwd": "/"}, "items": [item]},
        "renamed": {"session": {"id": "1", "workdir": "/"}, "items": [item]},
        "removed": {"session": {"id": "1"}, "items": [item]},
        "retyped": {"session": {"id": 1, "cwd": "/"}, "items": [item]},
        "added": {"session": {"id": "1", "cwd": "/"}, "items": [item, item | {"shard": 1}], "extra": None},
        "items": {"session": {"id": "1", "cwd": "/"}, "entries": [{"other": 1}]},
        "text": {"session": {"id": None, "cwd": "/"}, "items": json.dumps([item])},
        "bad": {"session": 7, "items": []},
    }
    rows = [(i, "s1", k, json.dumps(v)) for i, (k, v) in enumerate(files.items())] * 2 + [(99, None, None, None)]
    raw = spark.createDataFrame(rows, "row_id bigint, source_id string, file_name string, raw_text string")
    base = spark.createDataFrame(BASE, "src_table string, field_path string, json_types string, is_required int")
    found = drift.changes(drift.file_schemas(rollouts=raw, sources=sources(spark)), base)
    assert {(r["file_key"], r["field_path"], r["change_kind"], r["new_name"]) for r in found.collect()} == {
        ("renamed", "session.cwd", "renamed", "workdir"), ("removed", "session.cwd", "removed", None), ("retyped", "session.id", "retyped", None),
        ("added", "items[].shard", "added", None), ("added", "extra", "added", None), ("items", "items", "renamed", "entries"), ("text", "items", "retyped", None),
    }
    t = drift.consistent_table(raw, "legacy_rollouts", found, base, sources(spark)).where("file_key in ('renamed', 'retyped')").distinct().collect()
    assert {(r["file_key"], r["session_cwd"], r["session_id"]) for r in t} == {("renamed", "/", "1"), ("retyped", "/", "1")}
    assert drift.changes(drift.file_schemas(rollouts=raw.limit(0), sources=sources(spark)), base).count() == 0


def test_consistent_tables_keep_all_fields_and_repeated_paths(spark):
    base = [("legacy_rollouts", "session.n", "integer", 1), ("legacy_rollouts", "session.ok", "boolean", 0)]
    rows = [
        ("renamed", {"session": {"id": "1", "cwd": "/", "n": 12.7, "ok": "true"}, "items": [{"kind": "m", "name": "x"}, {"kind": "n", "shard": 1.50}]}),
        ("entries", {"session": {"id": "1", "cwd": "/", "n": "12", "extra": {"a": 1}}, "entries": [{"type": "m"}], "budget": None}),
        ("huge", {"session": {"id": "1", "cwd": "/", "n": 2**63, "ok": 1}, "items": []}),
    ]
    raw = spark.createDataFrame([(i, "s1", k, json.dumps(v)) for i, (k, v) in enumerate(rows)], "row_id bigint, source_id string, file_name string, raw_text string")
    doc = spark.createDataFrame(BASE + base, "src_table string, field_path string, json_types string, is_required int")
    found = drift.changes(drift.file_schemas(rollouts=raw, sources=sources(spark)), doc).cache()
    pairs = lambda x: {y["field"]: y["value"] for y in x}
    t = {r["file_key"]: r for r in drift.consistent_table(raw, "legacy_rollouts", found, doc, sources(spark)).collect()}
    assert {k: (r["session_n"], r["session_ok"], pairs(r["rest"]), pairs(r["originals"])) for k, r in t.items()} == {
        "renamed": (None, True, {}, {"session.n": "12.7"}), "entries": (12, None, {"session.extra": '{"a":1}', "budget": None}, {}),
        "huge": (None, None, {}, {"session.n": str(2**63), "session.ok": "1"}),
    }
    items = drift.consistent_table(raw, "legacy_rollouts", found, doc, sources(spark), "items[]").collect()
    assert sorted((r["file_key"], r["node_path"], r["type"], r["name"], *pairs(r["rest"]).items()) for r in items) == [
        ("entries", "items[0]", "m", None), ("renamed", "items[0]", "m", "x"), ("renamed", "items[1]", "n", None, ("items[].shard", "1.5")),
    ]


@pytest.mark.parametrize("v, want", [("12", 12), (12.0, 12), ("1e3", 1000), (12.7, None), ("1_0", None), (" 1", None), (True, None), ("1e999999999999999999999", None), (-(2**63), -(2**63)), (0, 0)])
def test_exact_casts(v, want):
    assert drift._cast(v, "bigint") == want


def test_flooding_prefers_the_like_name():
    t = lambda x: frozenset([x])
    left = (("u", "input_tokens", t("integer")), ("u", "output_tokens", t("integer")))
    right = (("u", "outputTokens", t("integer")), ("u", "speed", t("integer")))
    s = drift.flood(left, right)
    assert s[1, 0] == s.max() and s[1, 0] > s[0, 0] > s[0, 1]


def test_renames_in_wide_objects_and_all_that_can_be_had():
    t = lambda *x: frozenset(x)
    objects = lambda fields: [("", drift.OBJECTS, "", 2)] + [("", f, k, 2) for f, k in fields.items()]
    for n in (5, 60, 150):
        same = {f"field{i:03d}": "string" for i in range(n)}
        base = {"": {f: (t("string"), True) for f in [*same, "alpha"]}}
        assert drift.file_changes(objects(same | {"zzz": "string"}), base, False) == [("alpha", "renamed", "zzz")]
        assert drift.file_changes(objects(same | {"alpha2": "integer"}), base, False) == [("alpha", "removed", None), ("alpha2", "added", None)]
    # label is like labels, but only zz is left for it if alpha is to have a substitute at all
    base = {"": {"alpha": (t("string"), True), "label": (t("string", "integer"), True)}}
    assert set(drift.file_changes(objects({"labels": "string", "zz": "integer"}), base, False)) == {("alpha", "renamed", "labels"), ("label", "renamed", "zz")}


def test_flooding_ends_at_its_fixed_point():
    g = lambda last: tuple(("o", f"field{i:03d}", frozenset(["string"])) for i in range(120)) + (("o", last, frozenset(["string"])),)
    a, b = (drift.flood(g("alpha"), g("zzz"), eps=e) for e in (1e-4, 1e-9))
    assert (abs(a - b) / b).max() < 2e-3 and b.min() > 0


# ---- nested records ---------------------------------------------------------------------------------------
def test_nodes(spark):
    tree = {
        "traceId": "a", "attributes": {"k": None, "x.y": {"z": 1}}, "steps": [{"ops": None}, None, {"ops": [{"opId": "1"}]}],
        "turns": [{"ops": [{"op_id": "2", "childSession": {"attributes": {"q": 1}, "turns": [{"ops": []}]}}, 7]}, {"ops": None}],
    }
    rows = [(1, json.dumps({"opTree": tree})), (2, "{"), (3, None), (4, json.dumps({"opTree": None})), (None, json.dumps({"opTree": {}}))]
    snap = spark.createDataFrame(rows, "row_id bigint, raw_text string")
    got = {(r["row_id"], r["node_kind"], r["node_path"], r["parent_path"]) for r in flatten.nodes(flatten.snapshot_triples(snap)).collect()}
    assert got == {(1, *x) for x in [
        ("session", "opTree", ""), ("attribute", "opTree.attributes.k", "opTree"), ("attribute", "opTree.attributes.x.y", "opTree"),
        ("step", "opTree.steps[0]", "opTree"), ("step", "opTree.steps[2]", "opTree"), ("op", "opTree.steps[2].ops[0]", "opTree.steps[2]"),
        ("turn", "opTree.turns[0]", "opTree"), ("turn", "opTree.turns[1]", "opTree"), ("op", "opTree.turns[0].ops[0]", "opTree.turns[0]"),
        ("session", "opTree.turns[0].ops[0].childSession", "opTree.turns[0].ops[0]"), ("attribute", "opTree.turns[0].ops[0].childSession.attributes.q", "opTree.turns[0].ops[0].childSession"),
        ("turn", "opTree.turns[0].ops[0].childSession.turns[0]", "opTree.turns[0].ops[0].childSession"),
    ]} | {(-1, "session", "opTree", "")}
    ops = flatten.pivot_group(flatten.snapshot_triples(snap), "op").collect()
    assert {r["opid"] for r in ops} == {"1", "2"}
    led = spark.createDataFrame(
        [(1, "s1", "f", 1, line(recordType="turn_end", status="ok", ops=[{"payloadRefs": [{}, {"kind": "x"}], "childSessions": [{"sessionId": "c"}]}, {"payloadRefs": None}]), "c", "c", 0), (2, "s1", "f", 2, line(), "c", "c", 0), (3, "s1", "f", 3, line(recordType="turn_end", ops=[{}]), "c", "c", 0)], LEDGER
    )
    t = flatten.ledger_triples(led, sources(spark))
    assert sorted(r["node_path"] for r in flatten.nodes(t).collect()) == ["ops[0]", "ops[0].childSessions[0]", "ops[0].payloadRefs[0]", "ops[0].payloadRefs[1]", "ops[1]"]
    assert flatten.pivot_group(t, "payload_ref").where(F.col("kind") == "x").count() == 1


def test_flat_tables_keep_every_value(spark):
    op = {
        "opId": "1", "op_id": "respelled", "state": "ok", "budget": None, "attributes": {"a": {"b": 1}}, "payloadRefs": ["r"], "childSession": 5,
        "logs": [{"message": "hello", "extra": [[7]]}, "bare"], "accounting": [{"costUsd": 0.5, "tokens": {"inputTokens": 3, "cached": 4}}],
    }
    snap = spark.createDataFrame([(1, json.dumps({"version": 2, "opTree": {"turns": [{"ops": [op, 6]}], "steps": {"odd": 8}}}))], "row_id bigint, raw_text string")
    led_line = line(recordType="turn_end", status="ok", warnings=["w"], shard=9, ops=[{"payloadRefs": [{"turn": 2, "opIndex": 3, "compressedBytes": 4}]}])
    led = spark.createDataFrame([(2, "s1", "f", 1, led_line, "c", "c", 0)], LEDGER)
    t = flatten.snapshot_triples(snap).unionByName(flatten.ledger_triples(led, sources(spark))).cache()
    flat = {k: [r.asDict(True) for r in flatten.pivot_group(t, k).orderBy("row_id", "node_path").collect()] for k in [*flatten.FIELDS, *flatten.GROUPS]}
    rest = lambda r: {x["field"]: x["value"] for x in r["rest"]}
    at = "opTree.turns[0].ops[0]"
    assert flat["op"][0]["opid"] == "1"
    assert rest(flat["op"][0]) == {"op_id": "respelled", "state": "ok", "budget": None, "attributes.a.b": "1", "childSession": "5"}
    assert [(r["node_path"], r["parent_path"], r["message"], rest(r)) for r in flat["op.logs[]"]] == [(f"{at}.logs[0]", at, "hello", {}), (f"{at}.logs[1]", at, None, {"value": "bare"})]
    assert [(r["costusd"], r["tokens_inputtokens"], rest(r)) for r in flat["op.accounting[]"]] == [("0.5", "3", {"tokens.cached": "4"})]
    assert rest(flat["turn"][0]) == {"ops[1]": "6"} and rest(flat["session"][0]) == {"steps.odd": "8"}
    assert [(r["turn"], r["opindex"], rest(r)) for r in flat["payload_ref"]] == [("2", "3", {"compressedBytes": "4"})]
    assert [(r["version"], r["status"], rest(r)) for r in flat["record"]] == [("2", None, {}), ("3", "ok", {"shard": "9"})]
    assert [(r["value_json"], r["parent_path"]) for r in flat["record.warnings[]"]] == [("w", "")]
    groups = {r["node_path"]: (r["node_kind"], rest(r.asDict(True))) for r in flatten.pivot_rest(t).collect()}
    assert groups == {
        f"{at}.payloadRefs[0]": ("op.payloadRefs[]", {"value": "r"}), f"{at}.logs[0].extra[0]": ("op.logs[].extra[]", {}),
        f"{at}.logs[0].extra[0].value[0]": ("op.logs[].extra[].value[]", {"value": "7"}),
    }

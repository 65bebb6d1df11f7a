from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.operators.bad_rows import _EXPORT_START, _csv_start
from loomspan.sources.grammar import csv_records, json_records, json_text, load, one_json_object

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**70), 2**70) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=12),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=6), x, max_size=4),
    max_leaves=20,
)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text(max_size=6), JSON, max_size=5), st.booleans())
def test_round_trip(o, ascii_only):
    got, faults = one_json_object(" \t" + json.dumps(o, ensure_ascii=ascii_only) + "\r\n")
    assert not faults
    assert got == json.loads(json.dumps(o)) or any(0xD800 <= ord(c) < 0xE000 for c in json.dumps(o, ensure_ascii=False))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_agrees_with_the_standard_parser(text):
    try:
        want = json.loads(text, parse_constant=lambda _: 1 / 0)
    except (ValueError, ZeroDivisionError, RecursionError):
        want = None
    got, _ = one_json_object(text)
    assert got == (want if isinstance(want, dict) else None)


def test_recovery_resumes_at_the_next_record():
    text = '{"a":"lost quote}\n{"a":1}\n{"b":[1,}\n{"c":{"d":"}"}} tail {"e":2}'
    records, faults = json_records(text)
    assert {"a": 1} in records and {"c": {"d": "}"}} in records and {"e": 2} in records
    assert len(faults) >= 3 and all(f.offset >= 0 and f.expected for f in faults)


def test_long_and_deep_records_are_read():
    deep = '{"a":' * 1500 + "1" + "}" * 1500
    assert one_json_object(deep)[0] is not None
    assert len(one_json_object(json.dumps({"t": "x\n" * 500_000}))[0]["t"]) == 1_000_000


ROW = "0123456789abcdef0123456789abcdef,n,s,,r,root,a,ok,1,2,0.5,"


def test_csv_quotes_and_recovery():
    r, f = csv_records(ROW + '"a ""b""\nc"', _EXPORT_START, _csv_start)
    assert not f and r[0].fields[11] == 'a "b"\nc'
    r, f = csv_records(ROW + '"open\n' + ROW + "x\n" + ROW + "y", _EXPORT_START, _csv_start)
    assert len(f) == 1 and [x.fields[11] for x in r] == ["x", "y"]
    assert csv_records(ROW + '"a"b', _EXPORT_START, _csv_start)[1]


def test_recovery_has_no_limit_and_looks_inside_the_broken_record():
    assert json_records('{"x" ' * 70 + '{"a":1} {"b":2}')[0] == [{"a": 1}, {"b": 2}]
    records, faults = json_records('{"a": [1,\n{"ok": 1}\n{"ok": 2}\n{"ok": 3}')
    assert records == [{"ok": 1}, {"ok": 2}, {"ok": 3}] and len(faults) == 1
    assert json_records('{"kind":1,"in":{"x":2},', lambda o: "kind" in o)[0] == []
    lines = [ROW + '"open' + str(k) for k in range(70)] + [ROW + "x"]
    assert [r.fields[11] for r in csv_records("\n".join(lines), _EXPORT_START, _csv_start)[0]][-1] == "x"


def test_any_depth_and_all_digits():
    deep = '{"a":' * 100_000 + "[1e400]" + "}" * 100_000
    assert json_text(one_json_object(deep)[0]) == deep and json_text(load(deep)) == deep
    many = '{"a":' * 100_000
    assert json_records(many)[0] == [] and load("9" * 5000).text == "9" * 5000
    for bad in ('1}{"v":2', '1,"w":2', '"x', "[1,2", "", " ", "NaN"):
        with pytest.raises(ValueError):
            load(bad)

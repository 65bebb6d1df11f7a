"""Separating rows that cannot be loaded, with the reason, from valid typed rows.

Every text is read by the error-recovering grammars of ``sources.grammar``.
The first failing level names the reason: ``syntax`` (not exactly one record),
``fields`` (a needed field has no value), ``value`` (a value that is none).
A field that is only renamed or spelled in another JSON type and still gives
its value is no failure.

Defined results: NULL and blank ledger lines are no rows at all; NULL and empty
rollouts and CSV texts are ``syntax``; a NULL row id is reported as -1; repeated rows each get their own result;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.instants import readings
from loomspan.runtime import spread
from loomspan.sources.grammar import CsvRecord, Decimal64, csv_records, json_records, json_text, json_type, one_json_object, one_json_value

# The record types of a ledger and the kinds of a session.
RECORD_TYPES = ("session_start", "turn_start", "turn_end", "session_summary", "session_error")
SESSION_KINDS = ("root", "sub_agent", "fork", "internal")
EXPORT_COLUMNS = (
    "id", "native_id", "source_id", "parent_session_id", "root_session_id", "kind", "agent_name",
    "status", "start_ts", "turn_count", "cost_usd", "error_message",
)
LEDGER_FIELDS = ("version", "recordType", "seq", "ts", "originId", "sessionId")
ROLLOUT_FIELDS = {"session": "object", "items": "array"}

Fault = tuple[str, str, int]  # reason, detail, offset (-1: the whole record)


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _has(v: Any) -> bool:
    return v is not None and v != ""


def _lookup(obj: dict, name: str, known: frozenset[str]) -> Any:
    """The field's value under its own name or a respelling of it."""
    if name in obj:
        return obj[name]
    same = [k for k in obj if k not in known and plain_name(k) == plain_name(name)]
    return obj[same[0]] if len(same) == 1 else None


#: Whole numbers are below this, so that they fit their column.
BIGINT_END = 2**63


def whole_from_1(v: Any) -> int | None:
    """A whole number from 1 that fits a BIGINT, also in digits or as a float without fraction."""
    if isinstance(v, bool):
        return None
    if isinstance(v, str):
        s = v.strip()
        v = int(s) if re.fullmatch(r"[0-9]{1,40}", s) else None
    elif isinstance(v, float):
        v = int(v) if v.is_integer() and v < BIGINT_END else None
    return v if isinstance(v, int) and 1 <= v < BIGINT_END else None


def time_text(v: Any) -> str | None:
    """The digits or text of a JSON value that may be a time."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, Decimal64):
        return v.text
    return v if isinstance(v, str) else str(v) if isinstance(v, int) else None


def as_text(v: Any) -> str | None:
    """A text as it is, any other value as JSON, null as NULL."""
    return v if v is None or isinstance(v, str) else json_text(v)


_LEDGER_KNOWN = frozenset((*LEDGER_FIELDS, "turn", "status"))
_PLAIN_KNOWN = {plain_name(k): k for k in _LEDGER_KNOWN}


def record_kind(obj: dict) -> Any:
    """The record type of a ledger line, also under a respelt name."""
    return _lookup(obj, "recordType", _LEDGER_KNOWN)


def known_names(obj: dict) -> dict:
    """The ledger record with its documented fields under their own names; all others keep theirs."""
    respelt = {k: _PLAIN_KNOWN[plain_name(k)] for k in obj if k not in _LEDGER_KNOWN and plain_name(k) in _PLAIN_KNOWN}
    if not respelt:
        return obj
    # two respellings of one field are no field
    use = {k: to for k, to in respelt.items() if to not in obj and list(respelt.values()).count(to) == 1}
    return {use.get(k, k): v for k, v in obj.items()}


def _one(text: str) -> tuple[dict | None, Fault | None]:
    obj, faults = one_json_object(text)
    return obj, None if obj is not None else ("syntax", faults[0].expected, faults[0].offset)


def ledger_record(text: str | None, tz: str | None) -> tuple[dict | None, Fault | None]:
    """(record, None), (None, fault), or (None, None) for a blank line. The record has the names it was written with."""
    if text is None or not text.strip():
        return None, None
    obj, fault = _one(text)
    return ledger_of(obj, tz) if obj is not None else (None, fault)


def ledger_of(obj: dict, tz: str | None) -> tuple[dict | None, Fault | None]:
    kind = record_kind(obj)
    need = list(LEDGER_FIELDS)
    if kind in ("turn_start", "turn_end"):
        need.append("turn")
    if kind in ("turn_end", "session_summary"):
        need.append("status")
    got = {k: _lookup(obj, k, _LEDGER_KNOWN) for k in need}
    for k in need:
        if not _has(got[k]):
            return None, ("fields", k, -1)
    version = whole_from_1(got["version"])
    if version != 3:
        return None, ("value", "version", -1)
    if kind not in RECORD_TYPES:
        return None, ("value", "recordType", -1)
    for k in ("seq", "turn"):
        if k in got and whole_from_1(got[k]) is None:
            return None, ("value", k, -1)
    written = time_text(got["ts"])
    read = readings(written, tz) if written else []
    if not read:
        return None, ("value", "ts", -1)
    return obj, None


def rollout_record(text: str | None) -> tuple[dict | None, Fault | None]:
    """The record with ``session`` and ``items`` under their own names."""
    obj, fault = _one(text or "")
    return rollout_of(obj) if obj is not None else (None, fault)


def rollout_of(obj: dict) -> tuple[dict | None, Fault | None]:
    got: dict[str, Any] = {}
    for name, kind in ROLLOUT_FIELDS.items():
        v = obj.get(name)
        if name not in obj:
            others = [k for k in obj if k not in ROLLOUT_FIELDS and json_type(obj[k]) == kind]
            v = obj[others[0]] if len(others) == 1 else None
        if not _has(v):
            return None, ("fields", name, -1)
        got[name] = v
    if not isinstance(got["session"], dict):
        return None, ("value", "session", -1)
    items = got["items"]
    if isinstance(items, str):
        try:
            items = one_json_value(items)
        except ValueError:
            items = None
    if isinstance(items, dict) and all(re.fullmatch(r"[0-9]{1,18}", k) for k in items):
        items = [items[k] for k in sorted(items, key=int)]
    if not isinstance(items, list) or not all(isinstance(x, dict) for x in items):
        return None, ("value", "items", -1)
    return obj | got | {"items": items}, None


_HEX_ID = re.compile(r"[0-9a-f]{32}")
_EXPORT_START = re.compile(r'"?[0-9a-f]{32}"?,')
_WHOLE = re.compile(r"[0-9]+")
_PRICE = re.compile(r"[0-9]+(\.[0-9]+)?|\.[0-9]+")


def _csv_start(r: CsvRecord) -> bool:
    return len(r.fields) == len(EXPORT_COLUMNS) and bool(_HEX_ID.fullmatch(r.fields[0]))


def _whole(text: str) -> bool:
    """A whole number from 0 that fits a BIGINT."""
    return bool(_WHOLE.fullmatch(text)) and len(text.lstrip("0")) <= 19 and int(text.lstrip("0") or 0) < BIGINT_END


def export_record(text: str | None) -> tuple[list[str] | None, Fault | None]:
    records, faults = csv_records((text or ""), _EXPORT_START, _csv_start)
    if faults or len(records) != 1 or not (text or "").strip():
        f = faults[0] if faults else None
        return None, ("syntax", f.expected if f else "one record", f.offset if f else 0)
    return export_of(records[0].fields)


def export_of(v: list[str]) -> tuple[list[str] | None, Fault | None]:
    if len(v) != len(EXPORT_COLUMNS):
        return None, ("fields", f"{len(v)} of {len(EXPORT_COLUMNS)}", -1)
    for name, ok in (
        ("kind", v[5] in SESSION_KINDS),
        ("start_ts", _whole(v[8])),
        ("turn_count", _whole(v[9])),
        ("cost_usd", bool(_PRICE.fullmatch(v[10]))),
    ):
        if not ok:
            return None, ("value", name, -1)
    return v, None


def _names_a_type(o: dict) -> bool:
    return record_kind(o) in RECORD_TYPES


def _like_rollout(o: dict) -> bool:
    return any(k in o for k in ROLLOUT_FIELDS)


def _json_of(start: Callable[[dict], bool], check: Callable[[dict], tuple[Any, Fault | None]]) -> Callable[[str, "str | None"], tuple]:
    def read(text: str, tz: str | None) -> tuple[list[tuple[str, str]], list]:
        records, faults = json_records(text, start)
        return [(json_text(o), (f[0] if (f := check(o, tz)[1]) else "")) for o in records], faults

    return read


def _export_parts(text: str, tz: str | None) -> tuple[list[tuple[str, str]], list]:
    records, faults = csv_records(text, _EXPORT_START, _csv_start)
    return [(json_text(r.fields), (f[0] if (f := export_of(r.fields)[1]) else "")) for r in records], faults


#: How a table's texts are taken apart: records with the reason why one can't be loaded ('' if it can), and faults.
PARTS = {
    "ledger_lines": _json_of(_names_a_type, ledger_of),
    "legacy_rollouts": _json_of(_like_rollout, lambda o, tz: rollout_of(o)),
    "session_export": _export_parts,
}


def recovered(df: DataFrame, src_table: str, sources: DataFrame | None = None) -> DataFrame:
    """What can be read of rows that are not exactly one record.

    src_table, row_id, part ("record" or "fault"), part_no in order, fault_offset and
    expected of a fault, record (JSON; CSV fields as an array) and reason ('' if it could be loaded) of a record.
    """
    read = PARTS[src_table]
    cols = ["src_table", "row_id", "part", "part_no", "fault_offset", "expected", "record", "reason"]

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rid, text, tz in zip(b["row_id"], _texts(b), _texts(b, "_tz")):
            if src_table == "ledger_lines" and not (text or "").strip():
                continue
            records, faults = read(text or "", tz)
            if not faults and len(records) == 1:
                continue
            out += [(src_table, rid, "record", k, None, None, r, why) for k, (r, why) in enumerate(records)]
            out += [(src_table, rid, "fault", k, f.offset, f.expected, None, None) for k, f in enumerate(faults)]
        p = pd.DataFrame(out, columns=cols)
        p["fault_offset"] = p["fault_offset"].astype("Int64")
        return p

    rows = with_zone(df, sources) if sources is not None else spread(df).withColumn("_tz", F.lit(None).cast("string"))
    schema = "src_table string, row_id bigint, part string, part_no int, fault_offset bigint, expected string, record string, reason string"
    return _mapped(known_id(rows.select("row_id", "raw_text", "_tz"), "row_id"), fn, schema)


def with_zone(df: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds ``_tz``, the wall-clock zone of the row's source (NULL: UTC).

    ``sources`` has one row per source; Catalyst broadcasts it if its size allows.
    """
    zones = sources.select(
        F.col("id").alias("_zone_of"), F.get_json_object("meta_json", "$.tz").alias("_tz")
    ).dropDuplicates(["_zone_of"])
    df = spread(df.drop("_tz", "_zone_of"))
    return df.join(zones, df["source_id"] == zones["_zone_of"], "left").drop("_zone_of")


def known_id(df: DataFrame, name: str) -> DataFrame:
    """A NULL id is reported as -1, so every row keeps one."""
    return df.withColumn(name, F.coalesce(F.col(name), F.lit(-1)))


def _mapped(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield fn(b)

    return df.mapInPandas(run, schema)


_FAULT = "src_table string, row_id bigint, reason string, detail string, fault_offset bigint"


def _texts(b: pd.DataFrame, col: str = "raw_text") -> list[str | None]:
    return [x if isinstance(x, str) else None for x in b[col]]


def ledger_faults(ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """Ledger lines that cannot be loaded: src_table, row_id, reason, detail, fault_offset."""

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rid, text, tz in zip(b["row_id"], _texts(b), _texts(b, "_tz")):
            _, fault = ledger_record(text, tz)
            if fault:
                out.append(("ledger_lines", rid, *fault))
        return pd.DataFrame(out, columns=["src_table", "row_id", "reason", "detail", "fault_offset"])

    return _mapped(known_id(with_zone(ledger, sources).select("row_id", "raw_text", "_tz"), "row_id"), fn, _FAULT)


def rollout_faults(rollouts: DataFrame) -> DataFrame:
    """Legacy rollouts that cannot be loaded; columns as ``ledger_faults``."""

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rid, text in zip(b["row_id"], _texts(b)):
            _, fault = rollout_record(text)
            if fault:
                out.append(("legacy_rollouts", rid, *fault))
        return pd.DataFrame(out, columns=["src_table", "row_id", "reason", "detail", "fault_offset"])

    return _mapped(known_id(spread(rollouts.select("row_id", "raw_text")), "row_id"), fn, _FAULT)


def export_faults(export: DataFrame) -> DataFrame:
    """CSV records that cannot be loaded; columns as ``ledger_faults``."""

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rid, text in zip(b["row_id"], _texts(b)):
            _, fault = export_record(text)
            if fault:
                out.append(("session_export", rid, *fault))
        return pd.DataFrame(out, columns=["src_table", "row_id", "reason", "detail", "fault_offset"])

    return _mapped(known_id(spread(export.select("row_id", "raw_text")), "row_id"), fn, _FAULT)


def all_faults(ledger: DataFrame, rollouts: DataFrame, export: DataFrame, sources: DataFrame) -> DataFrame:
    return ledger_faults(ledger, sources).unionByName(rollout_faults(rollouts)).unionByName(export_faults(export))


def valid_ledger(ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """The valid ledger lines as typed rows; ``ts_us`` is UTC, ``body`` the remaining fields as JSON."""
    cols = ["row_id", "source_id", "file_name", "line_no", "version", "record_type", "seq", "ts_us", "origin_id", "session_id", "turn", "status", "body"]

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rid, src, name, no, text, tz in zip(b["row_id"], b["source_id"], b["file_name"], b["line_no"], _texts(b), _texts(b, "_tz")):
            obj, _ = ledger_record(text, tz)
            if obj is None:
                continue
            obj = known_names(obj)
            g = obj.get
            rest = {k: v for k, v in obj.items() if k not in _LEDGER_KNOWN}
            out.append((rid, src, name, no, 3, g("recordType"), whole_from_1(g("seq")), readings(time_text(g("ts")), tz)[0].utc_us,
                        as_text(g("originId")), as_text(g("sessionId")), whole_from_1(g("turn")), as_text(g("status")), json_text(rest)))
        p = pd.DataFrame(out, columns=cols)
        p["turn"] = p["turn"].astype("Int64")
        return p

    return _mapped(
        known_id(with_zone(ledger, sources).select("row_id", "source_id", "file_name", F.coalesce("line_no", F.lit(-1)).alias("line_no"), "raw_text", "_tz"), "row_id"),
        fn,
        "row_id bigint, source_id string, file_name string, line_no int, version int, record_type string, seq bigint, ts_us bigint,"
        " origin_id string, session_id string, turn bigint, status string, body string",
    )


def valid_export(export: DataFrame) -> DataFrame:
    """The valid CSV records as typed rows; an empty text is NULL."""

    def fn(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rid, text in zip(b["row_id"], _texts(b)):
            v, _ = export_record(text)
            if v is not None:
                t = [x or None for x in v]
                out.append((rid, *t[:8], int(v[8]), int(v[9]), float(v[10]), t[11]))
        return pd.DataFrame(out, columns=["row_id", *EXPORT_COLUMNS])

    types = {"start_ts": "bigint", "turn_count": "bigint", "cost_usd": "double"}
    return _mapped(
        known_id(spread(export.select("row_id", "raw_text")), "row_id"),
        fn,
        "row_id bigint, " + ", ".join(f"{c} {types.get(c, 'string')}" for c in EXPORT_COLUMNS),
    )


def valid_rollouts(rollouts: DataFrame) -> DataFrame:
    """The valid rollouts, one row per item in its order."""
    def fn(b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rid, src, name, text in zip(b["row_id"], b["source_id"], b["file_name"], _texts(b)):
            obj, _ = rollout_record(text)
            if obj is not None:
                sid = obj["session"].get("id")
                for k, x in enumerate(obj["items"]):
                    out.append((rid, src, name, as_text(sid), k, as_text(x.get("type")), json_text(x)))
        return pd.DataFrame(out, columns=["row_id", "source_id", "file_name", "session_id", "item_no", "item_type", "item"])

    return _mapped(
        known_id(spread(rollouts.select("row_id", "source_id", "file_name", "raw_text")), "row_id"),
        fn,
        "row_id bigint, source_id string, file_name string, session_id string, item_no int, item_type string, item string",
    )

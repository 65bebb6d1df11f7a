"""Source formats as canonical events.

A registry maps a format to a function from a raw table to events of
``schema.EVENT``. Records that stand on their own (ledger lines, snapshot trees)
are mapped row by row; formats whose turns follow from the order of lines
(transcripts, rollouts) are DataFrame plans over distributed ordered computations, so
one session may be of any length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.instants import readings
from loomspan.operators.bad_rows import as_text, known_names, ledger_record, time_text, whole_from_1, with_zone
from loomspan.schema import COLUMNS, EVENT
from loomspan.sources.grammar import CLOSE, OPEN, SyntaxStop, json_text, load, one_json_object, stream

Adapter = Callable[[DataFrame, DataFrame], DataFrame]
_REGISTRY: dict[str, Adapter] = {}


def register(name: str) -> Callable[[Adapter], Adapter]:
    def add(f: Adapter) -> Adapter:
        if name in _REGISTRY:
            raise ValueError(f"{name} is registered")
        _REGISTRY[name] = f
        return f

    return add


def get(name: str) -> Adapter:
    return _REGISTRY[name]


def formats() -> list[str]:
    return sorted(_REGISTRY)


# Names of states, kinds, severities and error classes in the sources and here.
OP_STATUS = {"ok": "completed", "failed": "failed", "": "running", "running": "running"}
ROOT_HEADENDS = ("cli", "api", "web", "embed", "slack")
INTERNAL_HEADEND = "tool_output"
SEVERITY = {
    "VRB": "DBG", "DBG": "DBG", "DEBUG": "DBG", "INF": "INF", "INFO": "INF", "WRN": "WRN", "WARN": "WRN", "WARNING": "WRN",
    "ERR": "ERR", "ERROR": "ERR", "FATAL": "ERR",
}
ERROR_SIGNS = (
    ("rate_limit", "rate_limit"), ("invalid_response", "invalid_response"), ("No output", "provider_error"),
    ("AI_APICallError", "provider_error"), ("AI_RetryError", "provider_error"), ("400", "provider_error"),
)
NO_REPORT = "completed without a final report"
BYTES_IN = ("llm_request", "sdk_request", "tool_request")
BYTES_OUT = ("llm_response", "sdk_response", "reasoning_stream", "tool_response")
STEP_OFFSET = 10_000


def op_status(v: Any) -> str:
    """A state under its canonical name; unknown ones pass as they are."""
    t = as_text(v) or ""
    return OP_STATUS.get(t, t)


def severity(v: Any) -> str:
    return SEVERITY.get((as_text(v) or "").upper(), "INF")


def headend_kind(v: Any) -> str:
    return "root" if v in ROOT_HEADENDS else "internal" if v == INTERNAL_HEADEND else "sub_agent"


_LAST_ERROR = re.compile(r"last_error=([^;]*)")
_SLUGS = re.compile(r"slugs=([^.;\n]*)")
_ATTEMPTS = re.compile(r"after ([^(]*?) attempts of (?:(\S*) \()?")
_MOST_TURNS = re.compile(r"maxTurns=([^);\n]*)")


def failure(error: Any) -> tuple[str | None, dict[str, Any]]:
    """(class, details) of a failed session's error text: last error, slugs, attempts and turns where it names them."""
    text = as_text(error) or ""
    cls, found = None, {}
    if m := _LAST_ERROR.search(text):
        cls, sep, detail = m.group(1).strip().partition(":")
        if sep and cls:
            found["error_detail"] = detail.strip()
        else:
            cls = m.group(1).strip()
        cls = cls.strip()
        cls = next((to for sign, to in ERROR_SIGNS if sign in cls), cls)
    if (m := _SLUGS.search(text)) and m.group(1).strip():
        found["error_slugs"] = [x.strip() for x in m.group(1).strip().split(",")]
    if m := _ATTEMPTS.search(text):
        found["attempts"] = _int(m.group(1))
        if m.group(2) is not None:
            found["max_attempts"] = _int(m.group(2))
    if m := _MOST_TURNS.search(text):
        found["max_turns"] = _int(m.group(1))
    if NO_REPORT in text:
        cls = "no_final_report"
    return cls or None, found


def _int(v: Any) -> int:
    """A whole number that fits a column, 0 for anything else."""
    try:
        n = int(v or 0)
    except (TypeError, ValueError, OverflowError):
        return 0
    return n if -(2**63) <= n < 2**63 else 0


def _float(v: Any) -> float:
    try:
        x = float(v or 0)
    except (TypeError, ValueError, OverflowError):
        return 0.0
    return x if math.isfinite(x) else 0.0


def _dict(v: Any) -> dict:
    return v if isinstance(v, dict) else {}


def _dicts(v: Any) -> list[dict]:
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def _word(v: Any) -> str | None:
    """A text, '' as NULL; anything else as its JSON."""
    return as_text(v) or None


def _us(v: Any, tz: str | None) -> int | None:
    w = time_text(v)
    got = readings(w, tz) if w else []
    return got[0].utc_us if got else None


def _frame(rows: list[dict]) -> pd.DataFrame:
    p = pd.DataFrame(rows, columns=COLUMNS, dtype=object)
    for f in EVENT:
        if f.dataType.typeName() in ("long", "integer"):
            p[f.name] = p[f.name].astype("Int64")
    return p


_TOKENS = {"tokens_in": "tokensIn", "tokens_out": "tokensOut", "tokens_cache_read": "tokensCacheRead", "tokens_cache_write": "tokensCacheWrite"}


def _tokens(acc: Any) -> dict[str, Any]:
    acc = _dict(acc)
    out: dict[str, Any] = {c: _int(acc.get(n)) for c, n in _TOKENS.items()}
    return out | {"cost_usd": _float(acc.get("costUsd")), "ctx_used": _int(sum(out.values()))}


def _prefixed(o: Any) -> dict[str, Any]:
    return {f"attr.{k}": v for k, v in sorted(_dict(o).items())}


def _child(c: dict, sid: str, origin: str | None) -> dict[str, Any]:
    """A session that only its parent has named so far; the child's own start overrides it."""
    more = {k: c[k] for k in ("ledgerPath", "status", "callPath") if _word(c.get(k))}
    return {
        "session": _word(c.get("sessionId")), "root": _word(c.get("originId")) or origin, "parent": sid, "parent_op": _word(c.get("parentOpId")),
        "session_kind": "sub_agent", "agent": _word(c.get("agentId")), "call_path": _word(c.get("callPath")),
        "extras": json_text({"synthetic": True} | more),
    }


def ledger_events(o: dict, base: dict, tz: str | None) -> list[dict]:
    """The events of one valid ledger line with its documented names."""
    t = _us(o.get("ts"), tz)
    sid, origin, kind = _word(o.get("sessionId")), _word(o.get("originId")), o.get("recordType")
    out: list[dict] = []

    def add(kind: str, **f: Any) -> None:
        out.append(base | {"sub": len(out), "session": sid, "kind": kind, "ts": t} | f)

    def log(message: Any, level: str, **f: Any) -> None:
        add("log_entry", severity=level, message=_word(message), **f)

    if kind == "session_start":
        add(
            "session_started", root=origin, parent=_word(o.get("parentSessionId")), parent_op=_word(o.get("parentOpId")), agent=_word(o.get("agentId")),
            call_path=_word(o.get("callPath")), session_kind=headend_kind(o.get("headendId")),
            extras=json_text({k: o[k] for k in ("headendId", "callPath", "parentSessionId", "parentOpId", "originId", "capturePayloads") if o.get(k) not in (None, "")} | _prefixed(o.get("attributes"))),
        )
    elif kind == "turn_start":
        add("turn_started", turn_seq=whole_from_1(o.get("turn")))
    elif kind == "turn_end":
        turn = whole_from_1(o.get("turn"))
        add("turn_finalized", turn_seq=turn, status=op_status(o.get("status")), end_ts=t, **_tokens(o.get("accounting")))
        for k, op in enumerate(_dicts(o.get("ops"))):
            start, end = _us(op.get("startedAt"), tz) or t, _us(op.get("endedAt"), tz) or t
            kids, refs = _dicts(op.get("childSessions")), _dicts(op.get("payloadRefs"))
            where = {"turn_seq": turn, "op_seq": k if op.get("opIndex") is None else _int(op.get("opIndex"))}
            more = _prefixed(op.get("attributes"))
            if len(kids) > 1:
                more["additionalChildSessions"] = [_word(c.get("sessionId")) for c in kids[1:]]
            add(
                "op_started", **where, ts=start, parent_op_seq=-1, op_kind=_word(op.get("kind")), name=_word(op.get("name")), model=_word(op.get("model")), provider=_word(op.get("provider")),
                namespace=_word(op.get("provider")) if op.get("kind") == "tool" else None, child_session=_word(kids[0].get("sessionId")) if kids else None, extras=json_text(more) if more else None,
            )
            size = lambda kinds: _int(sum(_int(r.get("originalBytes")) for r in refs if r.get("kind") in kinds))
            add(
                "op_finalized", **where, ts=end, end_ts=end, status=op_status(op.get("status")), error_message=_word(op.get("error")),
                bytes_in=size(BYTES_IN), bytes_out=size(BYTES_OUT), **_tokens(op.get("accounting")),
            )
            for r in refs:
                add(
                    "payload_ref", **where, ts=end, payload_kind=_word(r.get("kind")), format=_word(r.get("format")), location=_word(r.get("path")), sha256=_word(r.get("sha256")),
                    bytes_in=None if r.get("originalBytes") is None else _int(r.get("originalBytes")), bytes_out=_int(r.get("compressedBytes")),
                )
            for c in kids:
                add("session_started", **_child(c, sid, origin))
        for level, field in (("WRN", "warnings"), ("ERR", "errors")):
            for x in o.get(field) if isinstance(o.get(field), list) else []:
                log(x, level, turn_seq=turn)
    elif kind == "session_summary":
        failed = o.get("status") == "failed"
        cls, found = failure(o.get("error")) if failed and o.get("error") else (None, {})
        add("session_finalized", status="failed" if failed else "completed", error_class=cls, error_message=_word(o.get("error")), end_ts=t)
        if found:
            add("session_updated", extras=json_text(found))
        if isinstance(o.get("finalReport"), dict):
            add("session_updated", extras=json_text({f"finalReport.{k}": v for k, v in sorted(o["finalReport"].items()) if v != ""}))
        if failed and o.get("error"):
            log(o["error"], "ERR")
        for c in _dicts(o.get("childSessions")):
            add("session_started", **_child(c, sid, origin))
    elif kind == "session_error":
        add("session_finalized", status="failed", error_class="session_error", error_message=_word(o.get("error")), end_ts=t)
        log(o.get("error"), "ERR")
        if _dict(o.get("attributes")):
            add("session_updated", extras=json_text(_prefixed(o["attributes"])))
    return out


@register("aiagent_v3")
def ledger(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """raw: row_id, source_id, file_name, line_no, raw_text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for s, f, no, text, tz in zip(b["source_id"], b["file_name"], b["line_no"], b["raw_text"], b["_tz"]):
                z = tz if isinstance(tz, str) else None
                o, fault = ledger_record(text if isinstance(text, str) else None, z)
                base = {"source_id": s, "file": f, "rec": int(no) if not pd.isna(no) else 0}
                if o is not None:
                    rows += ledger_events(known_names(o), base, z)
                elif fault:
                    rows.append(base | {"kind": "source_error", "sub": 0, "severity": "ERR", "message": f"{fault[0]}: {fault[1]}"})
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return with_zone(raw, sources).select("source_id", "file_name", "line_no", "raw_text", "_tz").mapInPandas(run, EVENT)


def _success(v: Any) -> bool | None:
    return {"true": True, "false": False}.get(v.strip().lower()) if isinstance(v, str) else v if isinstance(v, bool) else None


def _first_model(s: dict) -> str | None:
    """The model of a session's first model operation."""
    for part in ("turns", "steps"):
        for t in _dicts(s.get(part)):
            for op in _dicts(t.get("ops")):
                if op.get("kind") == "llm" and (m := _op_model(op)):
                    return m
    return None


def _op_model(op: dict) -> str | None:
    first = (_dicts(op.get("accounting")) or [{}])[0]
    return _word(_dict(op.get("attributes")).get("model")) or (_word(first.get("model")) if first.get("type") == "llm" else None)


def snapshot_events(tree: dict, base: dict, tz: str | None) -> list[dict]:
    """The events of a snapshot's tree, of any depth; an explicit stack."""
    out: list[dict] = []
    origin, root_ts = _word(tree.get("traceId")), _us(tree.get("startedAt"), tz)
    stack: list[tuple[dict, str | None, str | None]] = [(tree, None, None)]
    while stack:
        s, parent, op_id = stack.pop()
        sid, t0 = _word(s.get("traceId")), _us(s.get("startedAt"), tz) or root_ts

        def add(kind: str, session: str | None = sid, **f: Any) -> None:
            out.append(base | {"sub": len(out), "session": session, "kind": kind, "ts": t0} | f)

        more = {k: s[k] for k in ("sessionTitle", "latestStatus", "callPath", "id", "attributes", "totals", "finalReport") if s.get(k) not in (None, "", {}, [])}
        add(
            "session_started", root=origin if parent else sid, parent=parent, parent_op=op_id, agent=_word(s.get("agentId")), call_path=_word(s.get("callPath")),
            session_kind="sub_agent" if parent else "root", model=_first_model(s), extras=json_text(more) if more else None,
        )
        below: list[tuple[dict, str | None, str | None]] = []
        for part, shift in (("turns", 0), ("steps", STEP_OFFSET)):
            for k, t in enumerate(_dicts(s.get(part))):
                turn = (k if t.get("index") is None else _int(t.get("index"))) + shift
                b0, b1 = _us(t.get("startedAt"), tz) or root_ts, _us(t.get("endedAt"), tz)
                add("turn_started", turn_seq=turn, ts=b0)
                if shift and _word(t.get("kind")):
                    add("session_updated", ts=b0, extras=json_text({f"step.{turn - shift}.kind": t["kind"]}))
                states, sums = [], dict.fromkeys(_TOKENS, 0) | {"cost_usd": 0.0}
                ops = _dicts(t.get("ops"))
                next_reasoning = len(ops)
                for j, op in enumerate(ops):
                    at = _us(op.get("startedAt"), tz) or root_ts
                    end = _us(op.get("endedAt"), tz) or at
                    attrs, kind = _dict(op.get("attributes")), _word(op.get("kind"))
                    first = (_dicts(op.get("accounting")) or [{}])[0]
                    tk = _dict(first.get("tokens")) if first.get("type") == "llm" else {}
                    child = op.get("childSession") if isinstance(op.get("childSession"), dict) else None
                    named = _word(child.get("traceId")) if child else _word(_dict(op.get("childSessionRef")).get("sessionId"))
                    st = op_status(op.get("status"))
                    states.append(st)
                    w = {"turn_seq": turn, "op_seq": j}
                    why = attrs.get("error") if isinstance(attrs.get("error"), str) else None
                    add(
                        "op_started", **w, ts=at, parent_op_seq=-1, op_kind=kind, name=_word(attrs.get("name")) or (_word(attrs.get("label")) if kind == "system" else None),
                        namespace=_word(attrs.get("provider")) if kind == "tool" else None, model=_op_model(op), provider=_word(attrs.get("provider")) or _word(first.get("provider")), child_session=named,
                    )
                    used: dict[str, Any] = {
                        "tokens_in": _int(tk.get("inputTokens")), "tokens_out": _int(tk.get("outputTokens")), "tokens_cache_read": _int(tk.get("cacheReadInputTokens")) or _int(tk.get("cachedTokens")),
                        "tokens_cache_write": _int(tk.get("cacheWriteInputTokens")),
                    }
                    used |= {"ctx_used": _int(sum(used.values())), "cost_usd": _float(first.get("costUsd")) if tk else 0.0}
                    for c in sums:
                        sums[c] += used[c]
                    add(
                        "op_finalized", **w, ts=end, end_ts=end, status=st, error_class=why or None,
                        bytes_in=_int(_dict(op.get("request")).get("size")), bytes_out=_int(_dict(op.get("response")).get("size")), **used,
                    )
                    thought = _word(_dict(op.get("reasoning")).get("final")) if kind == "llm" else None
                    if thought:
                        r = {"turn_seq": turn, "op_seq": next_reasoning}
                        next_reasoning += 1
                        add("op_started", **r, ts=at, parent_op_seq=j, op_kind="reasoning", extras=json_text({"reasoning.final": thought}))
                        add("op_finalized", **r, ts=end, end_ts=end, status=st)
                    for g in _dicts(op.get("logs")):
                        add("log_entry", **w, ts=_us(g.get("timestamp"), tz) or end, severity=severity(g.get("severity")), message=_word(g.get("message")), extras=json_text({"path": g["path"]}) if _word(g.get("path")) else None)
                    if st == "failed" and why:
                        add("log_entry", **w, ts=end, severity="ERR", message=why)
                    if child:
                        below.append((child, sid, _word(op.get("opId"))))
                if b1:
                    # without operations nothing failed and nothing runs
                    state = "failed" if "failed" in states else "completed" if all(x == "completed" for x in states) else "running"
                    add("turn_finalized", turn_seq=turn, ts=b1, end_ts=b1, status=state, **{k: _int(v) if k != "cost_usd" else v for k, v in sums.items()})
        end, ok = _us(s.get("endedAt"), tz), _success(s.get("success"))
        if end or ok is not None:
            add("session_finalized", ts=end or t0, end_ts=end, status=session_status(s, ok, end), error_message=_word(s.get("error")))
        elif session_status(s, ok, end) == "abandoned":
            add("session_finalized", status="abandoned")
        stack += reversed(below)
    return out


def session_status(s: dict, ok: bool | None, end: int | None) -> str:
    """By the success flag; else ended is interrupted, nothing done abandoned, and what is left runs."""
    if ok is not None:
        return "completed" if ok else "failed"
    if end:
        return "interrupted"
    return "running" if _dicts(s.get("turns")) or _dicts(s.get("steps")) else "abandoned"


@register("aiagent_v2")
def snapshot(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """raw: row_id, source_id, file_name, raw_text. A file delivered twice gives equal events."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for s, f, text, tz in zip(b["source_id"], b["file_name"], b["raw_text"], b["_tz"]):
                o, faults = one_json_object(text) if isinstance(text, str) else (None, [])
                base = {"source_id": s, "file": f, "rec": 0}
                if o and isinstance(o.get("opTree"), dict):
                    rows += snapshot_events(o["opTree"], base, tz if isinstance(tz, str) else None)
                else:
                    rows.append(base | {"kind": "source_error", "sub": 0, "severity": "ERR", "message": f"unreadable at {faults[0].offset}" if faults else "no tree"})
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return with_zone(raw, sources).select("source_id", "file_name", "raw_text", "_tz").mapInPandas(run, EVENT)


def as_events(df: DataFrame) -> DataFrame:
    """Rows of the canonical form; what ``df`` lacks is NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT])


# ---- files ------------------------------------------------------------------------------------------------
def read_lines(spark, path: str, glob: str = "*.jsonl") -> DataFrame:
    """file, line_no, raw_text of line files, gzipped or not; a file's lines keep their order."""
    t = spark.read.text(path, pathGlobFilter=glob, recursiveFileLookup=True).select(
        F.input_file_name().alias("file"), F.col("value").alias("raw_text"), F.monotonically_increasing_id().alias("line_no")
    )
    return t


def read_snapshots(spark, path: str) -> DataFrame:
    """file_name, raw_text of snapshot files; unfinished and hidden ones are passed over."""
    t = spark.read.text(path, wholetext=True, pathGlobFilter="*.json.gz", recursiveFileLookup=True).select(
        F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file_name"), F.col("value").alias("raw_text")
    )
    return t.where(~F.col("file_name").startswith(".") & ~F.col("file_name").contains(".tmp-"))


def json_pointer(value: Any, pointer: str) -> Any:
    """RFC 6901; a missing place is None."""
    if not pointer:
        return value
    for part in pointer.lstrip("/").split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict):
            value = value.get(part)
        elif isinstance(value, list) and part.isdigit() and int(part) < len(value):
            value = value[int(part)]
        else:
            return None
    return value


def read_payload(uri: str, roots: list[str], cap: int = 1 << 20) -> bytes:
    """Bytes of ``file://path[?json_pointer=P][#L<n>]``, at most ``cap``; only below a registered root."""
    import gzip
    import os
    from urllib.parse import parse_qs, unquote, urlsplit

    u = urlsplit(uri)
    if u.scheme != "file":
        raise ValueError("not a file")
    path = os.path.realpath(unquote(u.path))
    if not any(os.path.commonpath([path, os.path.realpath(r)]) == os.path.realpath(r) for r in roots):
        raise PermissionError("outside of the source's folder")
    with (gzip.open if path.endswith(".gz") else open)(path, "rb") as f:
        if u.fragment.startswith("L"):
            data = next((x for k, x in enumerate(f, 1) if k == int(u.fragment[1:])), b"")
        else:
            data = f.read(cap + 1) if "json_pointer" not in u.query else f.read()
    if "json_pointer" in u.query:
        v = json_pointer(load(data.decode("utf-8", "replace")), parse_qs(u.query)["json_pointer"][0])
        data = (v if isinstance(v, str) else json_text(v)).encode()
    return data[:cap]


def payload_preview(text: str, cap: int) -> tuple[str, bool]:
    """(preview of at most ``cap`` bytes, cut). A JSON object is cut behind its last whole value and closed, so it stays JSON."""
    if len(text.encode()) <= cap:
        return text, False
    start = len(text) - len(text.lstrip())
    best = ""
    try:
        if text[start : start + 1] != "{":
            raise SyntaxStop(start, "a record")
        closers = ""
        for kind, _, v, at in stream(text, start):
            if kind == OPEN:
                closers = ("}" if v == "{" else "]") + closers
                cut = text[start : at + 1]
            elif kind == CLOSE:
                closers = closers[1:]
                cut = text[start:at]
            else:
                cut = text[start : _END_OF_SCALAR.match(text, at).end()]
            if len(cut.encode()) + len(closers) > cap:
                break
            best = cut + closers
    except SyntaxStop:
        best = ""
    return best or text.encode()[:cap].decode("utf-8", "ignore"), True


_END_OF_SCALAR = re.compile(r'"(?:[^"\\]|\\.)*"|[^,}\]\s]+')


TEXT_KEYS = ("text", "content_text", "output_text")


def extract_text(raw: str, depth: int = 32) -> str:
    """The texts of a JSON payload joined by line ends, keys in order; what is no JSON or has no text stays as it is."""
    try:
        o = load(raw)
    except ValueError:
        return raw
    found: list[str] = []

    def walk(v: Any, k: int) -> None:
        if k > depth:
            return
        if isinstance(v, dict):
            for name in sorted(v):
                if name in TEXT_KEYS and isinstance(v[name], str):
                    found.append(v[name])
                else:
                    walk(v[name], k + 1)
        elif isinstance(v, list):
            for x in v:
                walk(x, k + 1)

    walk(o, 0)
    return "\n".join(found) if found else raw

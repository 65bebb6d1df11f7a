"""Session filters, request parameters, cursors and fingerprints.

A ``SessionFilter`` is a frozen value; ``predicates`` turns it into Column
conditions, OR within a dimension and AND across them, so Catalyst pushes what it can
to the scan. Semi-joins stand for filters on another table.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 100, 1000
SEARCH_DEFAULT, SEARCH_MAX = 50, 200
TOP_DEFAULT, TOP_MAX = 20, 200
IDLE_US = 10 * 60 * 1_000_000
TERMINAL = ("completed", "failed", "cancelled", "interrupted", "abandoned")
SEVERITIES = ("DBG", "INF", "WRN", "ERR")


class BadRequest(ValueError):
    """A parameter that can't be understood."""


@dataclass(frozen=True)
class SessionFilter:
    from_us: int | None = None
    to_us: int | None = None
    agents: tuple[str, ...] = ()
    models: tuple[str, ...] = ()
    tools: tuple[str, ...] = ()
    status: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    q: str = ""
    group: str = "root"
    order: str = "desc"
    limit: int = DEFAULT_LIMIT
    include_empty: bool = False

    def all_sessions(self) -> SessionFilter:
        return replace(self, group="all")


def array_param(values: Sequence[str]) -> tuple[str, ...]:
    """Repeated or comma-separated values: trimmed, without repeats, first order kept."""
    out: dict[str, None] = {}
    for v in values:
        if any(ord(c) < 0x20 for c in v):
            raise BadRequest("control character")
        parts = [p.strip() for p in v.split(",")]
        if not any(parts):
            raise BadRequest("present but empty")
        out |= dict.fromkeys(p for p in parts if p)
    return tuple(out)


def limit_param(value: str | None) -> int:
    if not value:
        return DEFAULT_LIMIT
    if not value.isdigit() or not 1 <= int(value) <= MAX_LIMIT:
        raise BadRequest(f"limit is from 1 to {MAX_LIMIT}")
    return int(value)


def clamped(value: int | None, default: int, most: int) -> int:
    return default if not value or value < 1 else min(value, most)


_ARRAYS = {"agents", "models", "tools", "status", "sources"}


def parse(params: dict[str, list[str]]) -> SessionFilter:
    """A filter from request parameters; anything malformed is a ``BadRequest``."""
    got: dict[str, object] = {}
    for k, v in params.items():
        if k in _ARRAYS:
            got[k] = array_param(v)
        elif k in ("from", "to"):
            if not v[0].lstrip("-").isdigit():
                raise BadRequest(f"{k} is no number")
            got[k + "_us"] = int(v[0])
        elif k == "limit":
            got["limit"] = limit_param(v[0])
        elif k == "include_empty":
            got["include_empty"] = v[0] in ("1", "true")
        elif k in ("q", "group", "order"):
            if any(ord(c) < 0x20 for c in v[0]):
                raise BadRequest("control character")
            got[k] = v[0]
    f = SessionFilter(**got)  # type: ignore[arg-type]
    if f.group not in ("root", "all") or f.order not in ("asc", "desc"):
        raise BadRequest("group or order")
    return f


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def predicates(f: SessionFilter, columns: Sequence[str], time: bool = True) -> list[Column]:
    """The conditions on a sessions table; ``to`` is inclusive."""
    p: list[Column] = []
    if time and f.from_us is not None:
        p.append(F.col("start_ts") >= f.from_us)
    if time and f.to_us is not None:
        p.append(F.col("start_ts") <= f.to_us)
    for col, vals in (("agent_name", f.agents), ("model", f.models), ("status", f.status), ("source_id", f.sources)):
        if vals:
            p.append(F.col(col).isin(*vals))
    if f.q:
        p.append(F.instr(ascii_lower(F.col("agent_name")), f.q.translate({c: c + 32 for c in range(65, 91)})) > 0)
    if f.group == "root":
        p.append(F.col("kind") == "root")
    if not f.include_empty and "op_count" in columns:
        p.append((F.col("op_count") > 0) | (F.col("turn_count") > 0))
    return p


def apply(sessions: DataFrame, f: SessionFilter, ops: DataFrame | None = None, time: bool = True) -> DataFrame:
    p = predicates(f, sessions.columns, time)
    out = sessions.where(reduce(lambda a, b: a & b, p)) if p else sessions
    if f.tools:
        used = ops.where((F.col("kind") == "tool") & F.col("tool").isin(*f.tools)).select(F.col("session_id").alias("id"))
        out = out.join(used, "id", "left_semi")
    return out


def effective_status(now_us: int) -> Column:
    """Terminal statuses pass; running with an end is completed, running but idle is stale."""
    s, idle = F.col("status"), F.greatest(F.coalesce("last_activity_ts", F.lit(0)), F.coalesce("start_ts", F.lit(0)))
    return (
        F.when(s.isin(*TERMINAL), s)
        .when(F.coalesce("end_ts", F.lit(0)) > 0, F.lit("completed"))
        .when(F.lit(now_us) - idle > IDLE_US, F.lit("stale"))
        .otherwise(s)
    )


def failure_ratio(failures: str, total: str) -> Column:
    return F.when(F.col(total) > 0, F.col(failures).cast("double") / F.col(total)).otherwise(0.0)


# ---- cursors ----------------------------------------------------------------------------------------------
_CURSOR = {"ts", "id", "sort", "order", "fp"}


def fingerprint(f: SessionFilter) -> str:
    """Changes whenever the filter does, but not with the order of its values; every part carries its length."""
    h = hashlib.sha256()
    for name in ("from_us", "to_us", "agents", "models", "tools", "status", "sources", "q", "group", "include_empty"):
        v = getattr(f, name)
        for part in (name, *(sorted(v) if isinstance(v, tuple) else [str(v)])):
            b = part.encode()
            h.update(len(b).to_bytes(8, "big") + b)
        h.update(b"\xff" * 8)
    return h.hexdigest()[:32]


def encode_cursor(ts: int, id_: str, f: SessionFilter, sort: str = "start_ts") -> str:
    raw = json.dumps({"ts": ts, "id": id_, "sort": sort, "order": f.order, "fp": fingerprint(f)}, separators=(",", ":"))
    return base64.urlsafe_b64encode(raw.encode()).rstrip(b"=").decode()


def decode_cursor(token: str, f: SessionFilter) -> tuple[int, str]:
    """(ts, id); unknown fields, trailing data and a changed filter are errors."""
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        o = json.loads(raw)
    except ValueError as x:
        raise BadRequest("cursor") from x
    if not isinstance(o, dict) or set(o) != _CURSOR or not isinstance(o["ts"], int) or not isinstance(o["id"], str):
        raise BadRequest("cursor")
    if o["fp"] != fingerprint(f) or o["order"] != f.order:
        raise BadRequest("the filter changed")
    return o["ts"], o["id"]


def page(df: DataFrame, f: SessionFilter, after: tuple[int, object] | None = None, id_col: str = "id", ts: str = "start_ts") -> DataFrame:
    """One keyset page and the row behind it, which tells that there is more."""
    key = F.struct(F.col(ts), F.col(id_col))
    if after is not None:
        at = F.struct(F.lit(after[0]).cast("bigint"), F.lit(after[1]))
        df = df.where(key < at if f.order == "desc" else key > at)
    down = f.order == "desc"
    return df.orderBy(F.col(ts).desc() if down else F.col(ts).asc(), F.col(id_col).desc() if down else F.col(id_col).asc()).limit(f.limit + 1)

"""Nested records as related flat tables that keep their parent links.

Each record is parsed in a stream into path-value-ordinal triples; a path that
repeats within its parent (turns, steps, ops, logs, ...) opens a group, so every
triple belongs to its nearest repeated ancestor. Objects between them give dotted
fields. Pivoting one group gives one flat table; what is no column of it is in
``rest``, so no value of a record is lost. Triples of a record come from one task in record order; only a pivot shuffles,
on (row, node), which no single record can skew beyond its own size.

Defined results: absent, null and empty arrays and maps have no nodes; array
elements of turns, steps, ops and references that are no objects have none but count
for positions; both are values of their parent. An array of any other name opens a
group named by its path, "op.logs[]", an element that is no object having the field
"value". The value of a column and of a session attribute is one text, however
nested, as it is written. A second spelling of a column's field is in ``rest``; a name
that is twice in one object gives both values. Unreadable records
and NULL texts give nothing; a NULL row id is -1; repeated rows each give their nodes; extra
columns are ignored; an empty table gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.bad_rows import known_id, ledger_of, plain_name, record_kind, with_zone
from loomspan.runtime import spread
from loomspan.sources.grammar import OPEN, VALUE, SyntaxStop, json_text, stream

_SCHEMA = (
    "src_table string, row_id bigint, node_kind string, node_path string, parent_path string, ordinal int, field string, value string"
)
_COLS = ["src_table", "row_id", "node_kind", "node_path", "parent_path", "ordinal", "field", "value"]

# The documented fields of each kind of node, the columns of its table.
FIELDS = {
    "session": ("id", "traceId", "agentId", "callPath", "sessionTitle", "startedAt", "endedAt", "success", "error", "latestStatus"),
    "turn": ("id", "index", "startedAt", "endedAt"),
    "step": ("id", "index", "startedAt", "endedAt", "kind"),
    "op": ("opId", "opIndex", "kind", "name", "status", "startedAt", "endedAt", "durationMs", "provider", "model", "error"),
    "attribute": ("value",),
    "payload_ref": ("kind", "opId", "turn", "opIndex", "format", "compression", "path", "sha256", "originalBytes", "captured", "truncated", "redacted"),
    "child_session": ("sessionId", "originId", "parentSessionId", "parentOpId", "status", "agentId", "callPath", "ledgerPath"),
}
#: The same of what lies around the nodes and of the documented arrays below them.
GROUPS = {
    "record": ("version", "reason", "recordType", "seq", "ts", "originId", "sessionId", "turn", "status"),
    "op.logs[]": ("timestamp", "severity", "message", "path"),
    "op.accounting[]": (
        "type", "provider", "model", "costUsd", "tokens.inputTokens", "tokens.outputTokens", "charactersIn", "charactersOut", "mcpServer", "command",
    ),
    "record.warnings[]": ("value",),
    "record.errors[]": ("value",),
}
COLUMNS = FIELDS | GROUPS
_KNOWN = {kind: {plain_name(f): f for f in names} for kind, names in COLUMNS.items()}

Triple = tuple[str, str, str, int, str | None, str | None]

# Which part of which node is a node of a kind of its own; a session is one object, all others are arrays of them.
SNAPSHOT = {
    ("record", "opTree"): "session", ("session", "turns"): "turn", ("session", "steps"): "step", ("turn", "ops"): "op",
    ("step", "ops"): "op", ("op", "childSession"): "session", ("session", "attributes"): "attribute",
}
LEDGER = {("record", "ops"): "op", ("op", "payloadRefs"): "payload_ref", ("op", "childSessions"): "child_session"}


def _text(v: Any) -> str | None:
    return v if v is None or isinstance(v, str) else json_text(v)


class _At:
    """An open object or array while a record streams by: to which node it belongs and where in it it stands."""

    __slots__ = ("role", "kind", "path", "parent", "ordinal", "prefix", "n", "start", "respelt")

    def __init__(self, role: int, kind: str, path: str, parent: str, ordinal: int, prefix: str = "", start: int = 0) -> None:
        self.role, self.kind, self.path, self.parent, self.ordinal, self.prefix, self.start = role, kind, path, parent, ordinal, prefix, start
        self.n = 0
        self.respelt: dict[str, int] | None = None


#: An object whose members are fields; an array of nodes; a map of nodes; an array that is a group; a value kept as one text.
FIELDS_OF, NODES, MAP, GROUP, TEXT = range(5)


def triples(text: str, opens: dict[tuple[str, str], str], values: bool = True) -> tuple[list[Triple], dict] | None:
    """(path-value-ordinal triples, members of the record itself) of a text that is exactly one object, else None.

    The record is never built: each event of the grammar goes to the node of the innermost repeated ancestor
    that is open. Members that are objects or arrays are empty ones in the second result.
    """
    out: list[Triple] = []
    top: dict[str, Any] = {}
    stack: list[_At] = []
    end = i = len(text) - len(text.lstrip(" \t\n\r"))
    if text[i : i + 1] != "{":
        return None
    owner = _At(FIELDS_OF, "record", "", "", 0)
    if values:
        out.append(("record", "", "", 0, None, None))

    def field(at: _At, name: str, value: Any) -> None:
        """A value of the node ``at`` belongs to; at its top a respelt name stands for the documented one that is not there."""
        if not at.prefix:
            as_ = _KNOWN.get(at.kind, _NONE).get(plain_name(name), name)
            if as_ != name:
                if at.respelt is None:
                    at.respelt = {}
                if as_ not in at.respelt:
                    at.respelt[as_] = len(out)
                    name = as_
            elif at.respelt is not None and name in at.respelt:
                k = at.respelt[name]
                if k >= 0:  # the documented name comes later: the respelt one keeps its own
                    out[k] = (*out[k][:4], at_names.pop(k), out[k][5])
                at.respelt[name] = -1
            elif name in COLUMNS.get(at.kind, ()):
                if at.respelt is None:
                    at.respelt = {}
                at.respelt[name] = -1
        out.append((at.kind, at.path, at.parent, at.ordinal, at.prefix + name, value))

    at_names: dict[int, str] = {}
    try:
        for what, name, v, pos in stream(text, i):
            if what == OPEN:
                if not stack:
                    stack.append(owner)
                    continue
                at = stack[-1]
                if at.role == TEXT:
                    at.n += 1
                    continue
                at.n += 1
                if len(stack) == 1:
                    top[name] = {} if v == "{" else []
                if at.role == FIELDS_OF:
                    kind = opens.get((at.kind, name)) if not at.prefix else None
                    here = f"{at.path}.{name}" if at.path else name
                    if kind == "attribute" and v == "{":
                        stack.append(_At(MAP, kind, here, at.path, at.ordinal, name, pos))
                    elif kind == "session" and v == "{":
                        out.append((kind, here, at.path, 0, None, None))
                        stack.append(_At(FIELDS_OF, kind, here, at.path, 0))
                    elif kind not in (None, "session", "attribute") and v == "[":
                        stack.append(_At(NODES, kind, here, at.path, at.ordinal, name, pos))
                    elif not values or _column(at, name):
                        stack.append(_At(TEXT, at.kind, at.path, at.parent, at.ordinal, name, pos))
                    elif v == "{":
                        stack.append(_At(FIELDS_OF, at.kind, at.path, at.parent, at.ordinal, f"{at.prefix}{name}.", pos))
                    else:
                        stack.append(_At(GROUP, f"{at.kind}.{at.prefix}{name}[]", f"{at.path}.{at.prefix}{name}" if at.path else f"{at.prefix}{name}", at.path, 0, "", pos))
                elif at.role == NODES and v == "{":
                    k, here = at.n - 1, f"{at.path}[{at.n - 1}]"
                    out.append((at.kind, here, at.parent, k, None, None))
                    stack.append(_At(FIELDS_OF, at.kind, here, at.parent, k))
                elif at.role == GROUP:
                    k, here = at.n - 1, f"{at.path}[{at.n - 1}]"
                    out.append((at.kind, here, at.parent, k, None, None))
                    if v == "{":
                        stack.append(_At(FIELDS_OF, at.kind, here, at.parent, k))
                    elif "value" in COLUMNS.get(at.kind, ()):
                        stack.append(_At(TEXT, at.kind, here, at.parent, k, "value", pos))
                    else:
                        stack.append(_At(GROUP, f"{at.kind}.value[]", f"{here}.value", here, 0, "", pos))
                else:  # what is no object among nodes, or a nested attribute
                    stack.append(_At(TEXT, at.kind, at.path, at.parent, at.n - 1, name or "", pos))
            elif what == VALUE:
                at = stack[-1]
                if at.role == TEXT:
                    continue
                at.n += 1
                if len(stack) == 1:
                    top[name] = v
                if at.role == MAP:
                    here = f"{at.path}.{name}"
                    out.append((at.kind, here, at.parent, at.n - 1, None, None))
                    if values:
                        out.append((at.kind, here, at.parent, at.n - 1, "value", _text(v)))
                elif not values:
                    continue
                elif at.role == FIELDS_OF:
                    k = len(out)
                    field(at, name, _text(v))
                    if out[k][4] != at.prefix + name:
                        at_names[k] = name
                elif at.role == NODES:
                    up = stack[-2]
                    out.append((up.kind, up.path, up.parent, up.ordinal, f"{at.prefix}[{at.n - 1}]", _text(v)))
                else:
                    here = f"{at.path}[{at.n - 1}]"
                    out.append((at.kind, here, at.parent, at.n - 1, None, None))
                    out.append((at.kind, here, at.parent, at.n - 1, "value", _text(v)))
            else:
                at = stack[-1]
                if at.role == TEXT and at.n:
                    at.n -= 1
                    continue
                stack.pop()
                if not stack:
                    end = pos
                    break
                up = stack[-1]
                raw = text[at.start : pos]
                if at.role == TEXT:
                    if up.role == MAP:
                        here = f"{up.path}.{at.prefix}"
                        out.append((up.kind, here, up.parent, up.n - 1, None, None))
                        if values:
                            out.append((up.kind, here, up.parent, up.n - 1, "value", raw))
                    elif not values:
                        continue
                    elif up.role == NODES:
                        two = stack[-2]
                        out.append((two.kind, two.path, two.parent, two.ordinal, f"{up.prefix}[{up.n - 1}]", raw))
                    elif up.role == GROUP:
                        out.append((at.kind, at.path, at.parent, at.ordinal, "value", raw))
                    else:
                        k = len(out)
                        field(up, at.prefix, raw)
                        if out[k][4] != up.prefix + at.prefix:
                            at_names[k] = at.prefix
                elif not at.n and values:  # nothing in it: a value of its parent, as it is
                    if at.role in (NODES, MAP):
                        out.append((up.kind, up.path, up.parent, up.ordinal, up.prefix + at.prefix, raw))
                    elif at.role == FIELDS_OF and at.prefix:
                        out.append((at.kind, at.path, at.parent, at.ordinal, at.prefix[:-1], raw))
                    elif at.role == GROUP:
                        if up.role == GROUP:
                            out.append((up.kind, at.parent, up.parent, up.n - 1, "value", raw))
                        else:
                            out.append((up.kind, up.path, up.parent, up.ordinal, at.kind[len(up.kind) + 1 : -2], raw))
    except SyntaxStop:
        return None
    return (out, top) if not text[end:].strip(" \t\n\r") else None


_NONE: dict[str, str] = {}


def _column(at: _At, name: str) -> bool:
    """Whether a nested value is kept as the text of one column."""
    cols = COLUMNS.get(at.kind, ())
    if at.prefix:
        return at.prefix + name in cols
    return name in cols or _KNOWN.get(at.kind, _NONE).get(plain_name(name)) is not None


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLS)


def snapshot_triples(snapshots: DataFrame, values: bool = True) -> DataFrame:
    """Path-value-ordinal triples; a triple without a field stands for the node itself.

    ``values=False`` leaves out the triples with fields, and the further groups, already in the parser.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, text in zip(b["row_id"], b["raw_text"]):
                got = triples(text, SNAPSHOT, values) if isinstance(text, str) else None
                if got:
                    rows += [("snapshot_files", rid, *t) for t in got[0]]
                if len(rows) > 50_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return known_id(spread(snapshots.select("row_id", "raw_text")), "row_id").mapInPandas(run, _SCHEMA)


def ledger_triples(ledger: DataFrame, sources: DataFrame, values: bool = True) -> DataFrame:
    """The same for the ops of valid turn_end lines."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rid, text, tz in zip(b["row_id"], b["raw_text"], b["_tz"]):
                got = triples(text, LEDGER, values) if isinstance(text, str) else None
                if got and record_kind(got[1]) == "turn_end" and ledger_of(got[1], tz if isinstance(tz, str) else None)[0]:
                    rows += [("ledger_lines", rid, *t) for t in got[0]]
                if len(rows) > 50_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return known_id(with_zone(ledger, sources).select("row_id", "raw_text", "_tz"), "row_id").mapInPandas(run, _SCHEMA)


def nodes(triples: DataFrame) -> DataFrame:
    """One row per node of the kinds in FIELDS."""
    return triples.where(F.col("field").isNull() & F.col("node_kind").isin(*FIELDS)).drop("field", "value")


def _pairs(keep: Column) -> Column:
    """The (field, value) pairs as an array; a map could not hold those of a row that is there twice."""
    return F.array_sort(F.collect_list(F.when(F.col("field").isNotNull() & keep, F.struct("field", "value")))).alias("rest")


def pivot_group(triples: DataFrame, kind: str, with_rest: bool = True) -> DataFrame:
    """The flat table of one kind of node, its documented fields as columns, all others in ``rest`` or in ``rest_values``."""
    t = triples.where(F.col("node_kind") == kind)
    column = lambda f: "value_json" if f == "value" else f.replace(".", "_").lower()
    named = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(column(f)) for f in COLUMNS[kind]]
    rest = _pairs(~F.col("field").isin(*COLUMNS[kind]))
    return t.groupBy("src_table", "row_id", "node_path", "parent_path", "ordinal").agg(*named, *([rest] if with_rest else []))


def rest_values(triples: DataFrame) -> DataFrame:
    """All values of nodes with a table of their own that are no column of it, one row each."""
    column = F.lit(False)
    for kind, names in COLUMNS.items():
        column = column | ((F.col("node_kind") == kind) & F.col("field").isin(*names))
    return triples.where(F.col("field").isNotNull() & F.col("node_kind").isin(*COLUMNS) & ~column).drop("parent_path", "ordinal")


def pivot_rest(triples: DataFrame) -> DataFrame:
    """The nodes of all arrays that have no table of their own, documented or not."""
    t = triples.where(F.col("node_kind").endswith("[]") & ~F.col("node_kind").isin(*GROUPS))
    return t.groupBy("src_table", "row_id", "node_kind", "node_path", "parent_path", "ordinal").agg(_pairs(F.lit(True)))

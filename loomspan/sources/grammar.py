"""Error-recovering descent grammars for JSON records and RFC 4180 CSV records.

Both parsers return the records they could read and located syntax errors.
After an error they resume at the next *validated* record start: a position
from which a whole record reads without an error and that the caller accepts as
a start, so that a quote or bracket lost in one record does not swallow the
following ones. Every position is tried, also inside the broken record, and
none is read again whose outcome is known, so recovery stays near-linear.

The JSON grammar is a stream of events (``stream``) with a stack of its own, so
nesting has no limit; ``json_records`` builds records from it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple


class SyntaxFault(NamedTuple):
    """Where a text stops being a record, and what was expected there."""

    offset: int
    expected: str


class Decimal64(float):
    """A JSON number with fraction or exponent; keeps its own digits."""

    text: str

    def __new__(cls, text: str) -> Decimal64:
        x = float.__new__(cls, text)
        x.text = text
        return x

    def __reduce__(self) -> tuple:
        return Decimal64, (self.text,)


class SyntaxStop(Exception):
    def __init__(self, offset: int, expected: str) -> None:
        self.fault = SyntaxFault(offset, expected)


_BLANK = re.compile(r"[ \t\n\r]*")
_PLAIN = re.compile(r'[^"\\\x00-\x1f]*')
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_HEX4 = re.compile(r"[0-9a-fA-F]{4}")
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_WORDS = {"true": True, "false": False, "null": None}
_START = re.compile(r'\{[ \t\n\r]*(?:"|\})')
# the usual member and element in one step; whatever they don't match goes the long way, which also locates errors
_SCALAR = r'(?:"([^"\\\x00-\x1f]*)"|(-?(?:0|[1-9][0-9]{0,400}))(?![.eE0-9])|(true|false|null)|([{\[]))[ \t\n\r]*'
_MEMBER = re.compile(r'[ \t\n\r]*"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*' + _SCALAR)
_ELEMENT = re.compile(r"[ \t\n\r]*()" + _SCALAR)
#: Longest number that is read as an integer; Python refuses to convert longer ones.
_INT_DIGITS = 4000


def _string(s: str, i: int) -> tuple[str, int]:
    """``i`` is behind the opening quote."""
    m = _PLAIN.match(s, i)
    j = m.end()
    if s[j : j + 1] == '"':
        return s[i:j], j + 1
    parts = [s[i:j]]
    while True:
        c = s[j : j + 1]
        if c == '"':
            return "".join(parts), j + 1
        if c != "\\":
            raise SyntaxStop(j, "closing quote" if not c else "no control character in a string")
        e = s[j + 1 : j + 2]
        if e == "u":
            h = _HEX4.match(s, j + 2)
            if not h:
                raise SyntaxStop(j, "four hexadecimal digits")
            code, j = int(h.group(), 16), j + 6
            if 0xD800 <= code < 0xDC00 and s[j : j + 2] == "\\u" and (low := _HEX4.match(s, j + 2)):
                if 0xDC00 <= (second := int(low.group(), 16)) < 0xE000:
                    code, j = 0x10000 + ((code - 0xD800) << 10) + second - 0xDC00, j + 6
            parts.append(chr(code) if not 0xD800 <= code < 0xE000 else "\ufffd")
        elif e in _ESCAPES and e:
            parts.append(_ESCAPES[e])
            j += 2
        else:
            raise SyntaxStop(j, "a known escape")
        m = _PLAIN.match(s, j)
        parts.append(m.group())
        j = m.end()


def _scalar(s: str, i: int) -> tuple[Any, int]:
    if s[i : i + 1] == '"':
        return _string(s, i + 1)
    if m := _NUMBER.match(s, i):
        text = m.group()
        return (Decimal64(text) if m.group(1) or m.group(2) or len(text) > _INT_DIGITS else int(text)), m.end()
    for word, v in _WORDS.items():
        if s.startswith(word, i):
            return v, i + len(word)
    raise SyntaxStop(i, "a value")


VALUE, OPEN, CLOSE = 0, 1, 2
Event = tuple[int, "str | None", Any, int]


def stream(s: str, i: int) -> Iterator[Event]:
    """Events of the object whose brace is at ``i``, as they are read.

    (VALUE, name, value, offset), (OPEN, name, "{" or "[", offset) and (CLOSE, None, None,
    offset behind it); name is None for elements of arrays. Raises ``SyntaxStop`` at an error.
    """
    yield OPEN, None, "{", i
    closers = ["}"]
    i = _BLANK.match(s, i + 1).end()
    fresh = True  # nothing stands in the innermost container yet
    while True:
        end = closers[-1]
        if fresh and s[i : i + 1] == end:
            i += 1
        else:
            # one member or element
            m = (_MEMBER if end == "}" else _ELEMENT).match(s, i)
            if m:
                name = m.group(1) if end == "}" else None
                kind = m.lastindex
                i = m.end()
                if kind == 2:
                    yield VALUE, name, m.group(2), m.start(2) - 1
                elif kind == 3:
                    yield VALUE, name, int(m.group(3)), m.start(3)
                elif kind == 4:
                    yield VALUE, name, _WORDS[m.group(4)], m.start(4)
                else:
                    c = m.group(5)
                    yield OPEN, name, c, m.start(5)
                    closers.append("}" if c == "{" else "]")
                    fresh = True
                    continue
            else:
                name, i = None, _BLANK.match(s, i).end()
                if end == "}":
                    if s[i : i + 1] != '"':
                        raise SyntaxStop(i, "a quoted name")
                    name, i = _string(s, i + 1)
                    i = _BLANK.match(s, i).end()
                    if s[i : i + 1] != ":":
                        raise SyntaxStop(i, "a colon")
                    i = _BLANK.match(s, i + 1).end()
                c, at = s[i : i + 1], i
                if c == "{" or c == "[":
                    yield OPEN, name, c, at
                    closers.append("}" if c == "{" else "]")
                    fresh, i = True, _BLANK.match(s, i + 1).end()
                    continue
                v, i = _scalar(s, i)
                yield VALUE, name, v, at
                i = _BLANK.match(s, i).end()
            fresh = False
            c = s[i : i + 1]
            if c == ",":
                i += 1
                continue
            if c != end:
                raise SyntaxStop(i, f"a comma or {end}")
            i += 1
        # one or more containers end here
        while True:
            closers.pop()
            yield CLOSE, None, None, i
            if not closers:
                return
            fresh = False
            i = _BLANK.match(s, i).end()
            c, end = s[i : i + 1], closers[-1]
            if c == ",":
                i += 1
                break
            if c != end:
                raise SyntaxStop(i, f"a comma or {end}")
            i += 1


def _object(s: str, i: int, known: dict[int, tuple[dict, int] | None] | None = None) -> tuple[dict, int]:
    """The object whose brace is at ``i`` and the offset behind it; of a name that is there twice the last value counts.

    ``known`` takes the outcome of every object begun on the way, whole or not.
    """
    cur: Any = None
    top: dict = {}
    above: list[Any] = []
    begun: list[int] = []
    at = i
    try:
        for kind, name, v, at in stream(s, i):
            if kind == VALUE:
                if name is None:
                    cur.append(v)
                else:
                    cur[name] = v
            elif kind == OPEN:
                new: Any = {} if v == "{" else []
                if cur is None:
                    top = new
                elif name is None:
                    cur.append(new)
                else:
                    cur[name] = new
                above.append(cur)
                cur = new
                if known is not None:
                    begun.append(at)
            else:
                if known is not None:
                    start = begun.pop()
                    if isinstance(cur, dict):
                        known[start] = cur, at
                cur = above.pop()
    except SyntaxStop:
        if known is not None:
            known |= dict.fromkeys(begun)
        raise
    return top, at


def json_records(text: str, is_start: Callable[[dict], bool] | None = None) -> tuple[list[dict], list[SyntaxFault]]:
    """All JSON objects of ``text`` and every place where it is not one.

    Blank space around a record belongs to none. Behind an error the parser
    resumes at the next brace from which a whole object reads and that
    ``is_start`` (default: any) accepts as a record.
    """
    records: list[dict] = []
    faults: list[SyntaxFault] = []
    i, n = _BLANK.match(text, 0).end(), len(text)
    known: dict[int, tuple[dict, int] | None] = {}
    while i < n:
        try:
            if text[i] != "{":
                raise SyntaxStop(i, "a record")
            record, i = _object(text, i)
            records.append(record)
        except SyntaxStop as stop:
            faults.append(stop.fault)
            if text[i] == "{":
                _outcome(text, i, known)
            i = next((k for k in _anchors(text, i + 1, known) if is_start is None or is_start(known[k][0])), n)
        i = _BLANK.match(text, i).end()
    return records, faults


def _outcome(text: str, at: int, known: dict[int, tuple[dict, int] | None]) -> tuple[dict, int] | None:
    if at not in known:
        try:
            _object(text, at, known)
        except SyntaxStop:
            known.setdefault(at, None)
    return known[at]


def _anchors(text: str, at: int, known: dict[int, tuple[dict, int] | None]) -> Iterator[int]:
    """Offsets from ``at`` on from which a whole object reads."""
    for m in _START.finditer(text, at):
        if _outcome(text, m.start(), known):
            yield m.start()


def one_json_object(text: str) -> tuple[dict | None, list[SyntaxFault]]:
    """The object if ``text`` is exactly one, else None with the reasons."""
    i = _BLANK.match(text, 0).end()
    if i == len(text):
        return None, [SyntaxFault(i, "a record")]
    try:
        if text[i] != "{":
            raise SyntaxStop(i, "a record")
        record, end = _object(text, i)
    except SyntaxStop as stop:
        return None, [stop.fault]
    end = _BLANK.match(text, end).end()
    return (record, []) if end == len(text) else (None, [SyntaxFault(end, "one record")])


def one_json_value(text: str) -> Any:
    """Any JSON value; ValueError if ``text`` is none. Nesting has no limit."""
    # as the only member of an object; its own end is checked, so the text can't close the object itself
    head = '{"v":'
    try:
        record, end = _object(head + text + "}", 0)
    except SyntaxStop as stop:
        raise ValueError(f"no JSON at {stop.fault.offset - len(head)}") from stop
    if end != len(head) + len(text) + 1 or len(record) != 1:
        raise ValueError("no JSON")
    return record["v"]


def _no_constant(name: str) -> Any:
    raise ValueError(name)


def load(text: str) -> Any:
    """Any JSON value, where only the value matters; ValueError if ``text`` is none.

    The standard parser reads what it can; what is too deep or has too many digits for it the grammar reads.
    """
    try:
        return json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return one_json_value(text)


def json_text(v: Any) -> str:
    """The value as JSON text; numbers keep their digits, nesting has no limit."""
    out: list[str] = []
    todo: list[Any] = [(v,)]
    while todo:
        x = todo.pop()
        if type(x) is str:  # a piece of text that is ready
            out.append(x)
            continue
        (x,) = x
        if isinstance(x, dict):
            todo.append("}")
            for k, (name, y) in enumerate(reversed(x.items())):
                todo += [(y,), json.dumps(name, ensure_ascii=False) + ":"]
                if k < len(x) - 1:
                    todo.append(",")
            todo.append("{")
        elif isinstance(x, (list, tuple)):
            todo.append("]")
            for k, y in enumerate(reversed(x)):
                todo.append((y,))
                if k < len(x) - 1:
                    todo.append(",")
            todo.append("[")
        else:
            out.append(x.text if isinstance(x, Decimal64) else json.dumps(x, ensure_ascii=False))
    return "".join(out)


class CsvRecord(NamedTuple):
    fields: list[str]
    quoted: list[bool]


_BARE = re.compile(r'[^",\r\n]*')
_IN_QUOTES = re.compile(r'[^"]*')


def _csv_record(s: str, i: int) -> tuple[CsvRecord, int]:
    """One record from ``i``; returns the position behind its line end."""
    fields: list[str] = []
    quoted: list[bool] = []
    while True:
        if s[i : i + 1] == '"':
            parts, i = [], i + 1
            while True:
                m = _IN_QUOTES.match(s, i)
                parts.append(m.group())
                i = m.end()
                if i >= len(s):
                    raise SyntaxStop(i, "closing quote")
                if s[i + 1 : i + 2] != '"':
                    break
                parts.append('"')
                i += 2
            fields.append("".join(parts))
            quoted.append(True)
            i += 1
        else:
            m = _BARE.match(s, i)
            fields.append(m.group())
            quoted.append(False)
            i = m.end()
        c = s[i : i + 1]
        if c == ",":
            i += 1
        elif c in ("", "\n", "\r"):
            if c == "\r" and s[i + 1 : i + 2] == "\n":
                i += 1
            return CsvRecord(fields, quoted), i + len(c)
        else:
            raise SyntaxStop(i, "a comma or a line end")


def csv_records(text: str, anchor: re.Pattern[str], is_start: Callable[[CsvRecord], bool]) -> tuple[list[CsvRecord], list[SyntaxFault]]:
    """All CSV records of ``text``. After broken quoting, reading resumes at the next line that opens like
    ``anchor`` and from which a record is read that ``is_start`` accepts."""
    records: list[CsvRecord] = []
    faults: list[SyntaxFault] = []
    i, n = 0, len(text)
    while i < n or (n == 0 and not records):
        try:
            record, i = _csv_record(text, i)
            records.append(record)
        except SyntaxStop as stop:
            faults.append(stop.fault)
            at, i = text.find("\n", i), n
            while at >= 0:
                if anchor.match(text, at + 1):
                    try:
                        candidate, _ = _csv_record(text, at + 1)
                        if is_start(candidate):
                            i = at + 1
                            break
                    except SyntaxStop:
                        pass
                at = text.find("\n", at + 1)
        if n == 0:
            break
    return records, faults


def json_type(v: Any) -> str | None:
    """The JSON type name of a parsed value; null has none."""
    if v is None:
        return None
    if v is True or v is False:
        return "boolean"
    if isinstance(v, str):
        return "string"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "number"
    return "array" if isinstance(v, list) else "object"

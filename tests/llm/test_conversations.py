from __future__ import annotations

import json
import random

import pytest

from loomspan.llm import conversations as C

SCHEMA = "line_id bigint, session_id string, agent_id string, uuid string, parent_uuid string, line_type string, is_meta boolean, is_compact_summary boolean, message string, chunk int, whole string"


def row(i, s, u, p, kind, content="text", agent=None, meta=None, role="same", compact=None):
    m = None if content is ... else json.dumps({"role": kind if role == "same" else role, "content": content})
    return i, s, agent, u, p, kind, meta, compact, m, 1, "clash"


def brute(rows):
    conv: dict = {}
    for i, s, a, u, p, kind, meta, compact, m, *_ in rows:
        o = json.loads(m) if m else {}
        role = (o.get("role") or "").strip().lower() if isinstance(o.get("role"), str) else ""
        role = role if role in C.ROLES else kind
        text = C._text_of(o.get("content"))
        sym = C.PROMPT if role == "user" and text and not meta and not compact else C.REPLY if role == "assistant" and text else C.OTHER
        conv.setdefault((s or "", a or ""), {}).setdefault(u, (p or None, sym))
    bad = set()
    for k, m in conv.items():
        answered, wrong = set(), False
        for u, (p, sym) in m.items():
            seen, x, near = {u}, p, None
            while x is not None:
                if x not in m or x in seen:
                    wrong = True
                    break
                if near is None and m[x][1] == C.PROMPT:
                    near = x
                seen.add(x)
                x = m[x][0]
            if sym == C.REPLY and near:
                answered.add(near)
        prompts = {u for u, (_, sym) in m.items() if sym == C.PROMPT}
        if wrong or not prompts or not any(sym == C.REPLY for _, sym in m.values()) or prompts - answered:
            bad.add(k)
    return bad


def world(seed):
    rnd = random.Random(seed)
    rows, i = [], 0
    for s in range(30):
        n, us = rnd.randint(1, 25), []
        for k in range(n):
            u = f"{s}-{k}"
            p = rnd.choice(us[-3:]) if us and rnd.random() < 0.97 else None
            p = "nowhere" if rnd.random() < 0.004 else p
            kind = "user" if k % 2 == 0 and rnd.random() < 0.95 else "assistant"
            rows.append(row(i, f"s{s}", u, p, kind, agent=rnd.choice([None, ""]), content=rnd.choice(["t", [{"type": "text", "text": "t"}], [{"type": "tool_use"}]]) if kind == "assistant" else "t" if rnd.random() < 0.5 else [{"type": "tool_result"}]))
            us.append(u)
            i += 1
            if rnd.random() < 0.1:
                rows.append((i, *rows[-1][1:]))
                i += 1
    rows += [row(i + k, "loop", f"l{k}", f"l{(k + 1) % 3}", ("user", "assistant", "user")[k]) for k in range(3)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_in_one_piece_and_in_chunks(spark, seed):
    rows = world(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for chunk in (C.CHUNK, 5):
        v, lines = C.examine(df, chunk, keep_lines=True)
        got = {(r["session_id"], r["agent_id"]) for r in v.where("reason <> ''").collect()}
        assert got == want
        kept = {(r["session_id"], r["agent_id"]) for r in lines.collect()}
        assert not kept & want
    a, b = (sorted(map(tuple, C.ordered(df, c).collect())) for c in (C.CHUNK, 5))
    assert a == b
    # nothing comes before what it answers, and apart from that the sequence numbers decide
    parent = {r[3]: r[4] for r in rows}
    line = {}
    for r in sorted(rows, key=lambda r: r[0]):
        line.setdefault((r[1], r[3]), r[0])
    place = {(x[0], x[3]): x[2] for x in a}
    for (s, u), i in line.items():
        if (s, i) in place and parent[u]:
            assert place[s, line[s, parent[u]]] < place[s, i]
    for x, y in zip(a, a[1:]):
        assert (x[2] == 0 and y[2] in (0, 1)) or y[2] == x[2] + 1 or y[2] == 0


CASES = {
    "sound": [("u", None, "user", "hi"), ("a", "u", "assistant", [{"type": "text", "text": "yes"}])],
    "role from the line": [("u", None, "user", "hi", None), ("a", "u", "assistant", "yes", "Assistant ")],
    "two answers": [("u", None, "user", "hi"), ("a", "u", "assistant", "x"), ("b", "u", "assistant", "y")],
}
BROKEN = {
    "blank prompt": [("u", None, "user", " \n"), ("a", "u", "assistant", "yes")],
    "meta prompt": [("u", None, "user", "hi", "same", True), ("a", "u", "assistant", "yes")],
    "no answer": [("u", None, "user", "hi"), ("v", "u", "user", "again"), ("a", "v", "assistant", "yes")],
    "blank answer": [("u", None, "user", "hi"), ("a", "u", "assistant", [{"type": "text", "text": " "}, {"type": "tool_use"}])],
    "lost parent": [("u", None, "user", "hi"), ("a", "u", "assistant", "yes"), ("b", "gone", "assistant", "yes")],
    "own parent": [("u", None, "user", "hi"), ("a", "u", "assistant", "yes"), ("b", "b", "system", ...)],
    "no message": [("u", None, "user", ...), ("a", None, "assistant", ...)],
    "no uuid": [(None, None, "user", "hi")],
}


def test_cases(spark):
    rows, i = [], 0
    for name, lines in (CASES | BROKEN).items():
        for u, p, kind, content, *more in lines:
            rows.append(row(i, name, u, p, kind, content, role=more[0] if more else "same", meta=more[1] if len(more) > 1 else None))
            i += 1
    rows.append(row(None, None, "u", None, "user", "x" * 300_000))
    got = {r["session_id"] for r in C.examine(spark.createDataFrame(rows, SCHEMA))[0].where("reason <> ''").collect()}
    assert got == set(BROKEN) | {""}
    empty = spark.createDataFrame([], SCHEMA)
    assert C.examine(empty)[0].count() == 0 and C.ordered(empty).count() == 0

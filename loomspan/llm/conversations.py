"""Rebuilding conversations from message rows, and finding those to drop.

Lines are partitioned by conversation, sorted by sequence number within it and run
through a finite-state automaton: a line's state follows from the state of the
line it answers and its own symbol (prompt, reply, other). Link errors, missing
roles' texts and prompts without reply are read off the states.

A conversation of more than ``chunk`` lines is cut into chunks of consecutive
sequence numbers, each in its own task and never longer than ``chunk``. A chunk
runs the automaton as far as its own lines lead; where a link leaves it, the
state stays open. The links between chunks form a small forest that is
closed by pointer doubling, so a conversation of any length gives the same result
as in one piece.

Defined results: NULL session ids form the session '', NULL agents the main
conversation ''; lines delivered twice (same uuid) count once; a line without
uuid can be no parent; a NULL line id is -1; unreadable or NULL messages have no text; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import running_total, spread, stage, unstage
from loomspan.sources.grammar import load

#: Lines of one task's chunk; bounds a task's memory to some 10 MB of links.
CHUNK = 16_384

OTHER, PROMPT, REPLY = 0, 1, 2
NONE, OPEN, ANSWERED = 0, 1, 2
#: The automaton: (state above, symbol) -> state. A prompt opens, a reply answers what is open.
STEP = {
    (NONE, OTHER): NONE, (NONE, REPLY): NONE, (NONE, PROMPT): OPEN,
    (OPEN, OTHER): OPEN, (OPEN, REPLY): ANSWERED, (OPEN, PROMPT): OPEN,
    (ANSWERED, OTHER): ANSWERED, (ANSWERED, REPLY): ANSWERED, (ANSWERED, PROMPT): OPEN,
}

ROLES = ("user", "assistant", "system")
_LINES = "session_id string, agent_id string, line_id bigint, uuid string, parent string, role string, symbol int"


def _text_of(content: object) -> bool:
    """Whether a message's content has non-blank text: itself, or in one of its text blocks."""
    if isinstance(content, str):
        return bool(content.strip())
    if isinstance(content, dict):
        content = [content]
    if isinstance(content, list):
        for x in content:
            if isinstance(x, dict) and x.get("type") == "text" and isinstance(x.get("text"), str) and x["text"].strip():
                return True
    return False


def symbols(transcripts: DataFrame) -> DataFrame:
    """One narrow row per line: links, role and symbol; the message goes no further."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            roles, syms = [], []
            for kind, quiet, m in zip(b["kind"], b["quiet"], b["message"]):
                role, text = None, False
                if isinstance(m, str):
                    try:
                        o = load(m)
                    except ValueError:
                        o = None
                    if isinstance(o, dict):
                        role = o.get("role")
                        text = _text_of(o.get("content"))
                    elif isinstance(o, str):
                        text = bool(o.strip())
                role = role.strip().lower() if isinstance(role, str) else ""
                if role not in ROLES:
                    role = kind
                roles.append(role)
                syms.append(PROMPT if role == "user" and text and not quiet else REPLY if role == "assistant" and text else OTHER)
            yield pd.DataFrame(
                {
                    "session_id": b["session_id"], "agent_id": b["agent_id"], "line_id": b["line_id"],
                    "uuid": b["uuid"], "parent": b["parent"], "role": roles, "symbol": syms,
                }
            )

    void = lambda c: F.when(F.col(c) != "", F.col(c))
    return spread(transcripts).select(
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce("agent_id", F.lit("")).alias("agent_id"),
        F.coalesce("line_id", F.lit(-1)).alias("line_id"),
        void("uuid").alias("uuid"),
        void("parent_uuid").alias("parent"),
        F.coalesce(F.lower(F.trim("line_type")), F.lit("")).alias("kind"),
        (F.coalesce("is_meta", F.lit(False)) | F.coalesce("is_compact_summary", F.lit(False))).alias("quiet"),
        "message",
    ).mapInPandas(run, _LINES)


_OUT = "tag string, session_id string, agent_id string, line_id bigint, uuid string, ref string, prompt string, n bigint, flag boolean, seq bigint"
_OUT_COLS = [x.split()[0] for x in _OUT.split(", ")]
#: Tags of the automaton's output. VERDICT: a whole conversation; the others: parts of a chunked one.
VERDICT, FACTS, LINE, EXIT, UNANSWERED, ANSWER = "verdict", "facts", "line", "exit", "unanswered", "answer"


def run_automaton(lines: list[tuple], whole: bool) -> list[tuple]:
    """One conversation (``whole``) or one chunk; lines: (line_id, uuid, parent, symbol) by line_id.

    Returns (tag, line_id, uuid, ref, prompt, n, flag, seq) rows. ``ref`` is the uuid a
    link leaves the chunk by, ``n`` the links to the top or to there, ``seq`` the highest line number on that way.
    """
    info: dict[str, tuple[str | None, int, int]] = {}
    loose: list[tuple[int, str | None, int]] = []  # lines without uuid
    for lid, u, p, sym in lines:
        if u is None:
            loose.append((lid, p, sym))
        elif u not in info:
            info[u] = (p, sym, lid)
    # uuid -> (ref by which the way up leaves, nearest prompt at or above, links up, state, looped, highest line number)
    Way = tuple[str | None, str | None, int, int, bool, int]
    done: dict[str, Way] = {}
    answered: set[str] = set()
    exits: dict[str, bool] = {}

    def above(p: str | None) -> Way:
        if p is None:
            return None, None, -1, NONE, False, -1
        if p in info:
            return done[p]
        exits.setdefault(p, False)
        return p, None, 0, NONE, False, -1

    def close(u: str | None, p: str | None, sym: int, lid: int) -> Way:
        ref, near, n, state, looped, seq = above(p)
        nxt = STEP[state, sym]
        if sym == REPLY:
            if near is not None:
                answered.add(near)
            elif ref is not None:
                exits[ref] = True
        links = 0 if looped else n if p is not None and p not in info else n + 1
        return ref, (u if sym == PROMPT and u is not None else near), links, nxt, looped, max(seq, lid)

    for u in info:
        way: list[str] = []
        on: set[str] = set()
        x: str | None = u
        while x is not None and x in info and x not in done and x not in on:
            way.append(x)
            on.add(x)
            x = info[x][0]
        if x is not None and x in on:  # a loop: it never ends at a line without parent
            for v in way:
                done[v] = (None, None, 0, NONE, True, info[v][2])
            continue
        for v in reversed(way):
            p, sym, lid = info[v]
            done[v] = close(v, p, sym, lid)
    lone_prompt = False
    lone: list[tuple] = []
    for lid, p, sym in loose:
        lone.append((lid, *close(None, p, sym, lid)))
        lone_prompt |= sym == PROMPT
    looped = any(d[4] for d in done.values())
    prompts = [u for u, (_, sym, _) in info.items() if sym == PROMPT]
    has_prompt = bool(prompts) or lone_prompt
    has_reply = any(s == REPLY for _, s, _ in info.values()) or any(s == REPLY for *_, s in loose)
    if whole:
        reason = (
            "broken link" if exits
            else "loop" if looped
            else "no prompt" if not has_prompt
            else "no assistant text" if not has_reply
            else "prompt without reply" if lone_prompt or len(answered) < len(prompts)
            else ""
        )
        return [(VERDICT, None, None, None, reason, len(info) + len(loose), reason != "", None)] + (
            [(LINE, info[u][2], u, None, None, done[u][2], False, done[u][5]) for u in info]
            + [(LINE, lid, None, None, None, n, False, seq) for lid, _, _, n, _, _, seq in lone]
            if reason == ""
            else []
        )
    out: list[tuple] = [(FACTS, None, None, None, "loop" if looped else "lone" if lone_prompt else "", int(has_prompt) + 2 * int(has_reply), looped, None)]
    out += [(LINE, info[u][2], u, d[0], d[1], d[2], d[4], d[5]) for u, d in done.items()]
    out += [(LINE, lid, None, ref, near, n, looped_, seq) for lid, ref, near, n, _, looped_, seq in lone]
    out += [(EXIT, None, None, r, None, None, f, None) for r, f in exits.items()]
    out += [(ANSWER if u in answered else UNANSWERED, None, u, None, None, None, None, None) for u in prompts]
    return out


def _automata_of(keep_lines: bool):
    """The automaton over a partition; lines of whole conversations go on only with ``keep_lines``."""
    return lambda batches: _automata(batches, keep_lines)


def _automata(batches: Iterator[pd.DataFrame], keep_lines: bool) -> Iterator[pd.DataFrame]:
    """Runs the automaton over sorted rows; a group may span batches, and is at most a chunk or a whole small conversation."""
    key: tuple | None = None
    group: list[tuple] = []
    rows: list[tuple] = []

    def flush() -> None:
        if key is not None:
            for tag, *rest in run_automaton(group, key[3]):
                if keep_lines or not key[3] or tag != LINE:
                    rows.append((tag, key[0], key[1], *rest))

    def frame() -> pd.DataFrame:
        p = pd.DataFrame(rows, columns=_OUT_COLS)
        for c in ("line_id", "n", "seq"):
            p[c] = p[c].astype("Int64")
        return p

    for b in batches:
        for s, a, c, w, lid, u, p, sym in zip(b["session_id"], b["agent_id"], b["chunk"], b["whole"], b["line_id"], b["uuid"], b["parent"], b["symbol"]):
            if (s, a, c, w) != key:
                flush()
                key, group = (s, a, c, w), []
            group.append((lid, u if isinstance(u, str) else None, p if isinstance(p, str) else None, sym))
        if len(rows) > 50_000:
            yield frame()
            rows = []
    flush()
    yield frame()


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["session_id"] == b["s_"]) & (a["agent_id"] == b["a_"])


def examine(
    transcripts: DataFrame, chunk: int = CHUNK, keep_lines: bool = False, flat: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """(verdicts, lines). verdicts: session_id, agent_id, n_lines, reason ('' if sound).

    lines (with ``keep_lines``): session_id, agent_id, line_id, links_up, seq of the sound conversations.
    ``flat`` is the staged result of ``symbols``, if the caller has it.
    """
    conv = ["session_id", "agent_id"]
    flat = flat if flat is not None else stage(symbols(transcripts))
    large = flat.groupBy(*conv).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > chunk)
    large = large.select(F.col("session_id").alias("s_"), F.col("agent_id").alias("a_"), "n_")
    # lines without a number are spread over as many chunks as the conversation needs
    spare = -1 - F.pmod(F.xxhash64("uuid"), F.ceil(F.col("n_") / chunk).cast("bigint"))
    cut = flat.join(large, _same(flat, large), "left").select(
        *conv,
        F.when(F.col("s_").isNotNull(), F.when(F.col("line_id") < 0, spare).otherwise(F.floor(F.col("line_id") / chunk))).otherwise(F.lit(0)).cast("bigint").alias("chunk"),
        F.col("s_").isNull().alias("whole"),
        "line_id",
        "uuid",
        "parent",
        "symbol",
    )
    out = cut.repartition(*conv, "chunk").sortWithinPartitions(*conv, "chunk", "line_id").mapInPandas(_automata_of(keep_lines), _OUT)
    out = stage(out)
    small = out.where(F.col("tag") == VERDICT).select(*conv, F.col("n").alias("n_lines"), F.col("prompt").alias("reason"))
    parts = out.where(F.col("tag") != VERDICT)
    chunked = out.where(F.col("tag") == FACTS)
    if chunked.isEmpty():
        verdicts = small
        lines = _once(out.where(F.col("tag") == LINE).select(*conv, "uuid", "line_id", F.col("n").alias("links_up"), "seq")) if keep_lines else None
    else:
        big = chunked.select(*[F.col(c).alias(x) for c, x in zip(conv, ("s_", "a_"))]).distinct()
        parts = parts.join(big, _same(parts, big), "left_semi")
        at = _close_exits(parts)
        verdicts = small.unionByName(_large_verdicts(parts, at))
        lines = None
        if keep_lines:
            few = out.where(F.col("tag") == LINE).join(big, _same(out, big), "left_anti").select(*conv, "uuid", "line_id", F.col("n").alias("links_up"), "seq")
            a = at.select(F.col("session_id").alias("s_"), F.col("agent_id").alias("a_"), F.col("ref").alias("r_"), F.col("n").alias("n_"), F.col("seq").alias("q_"))
            ln = parts.where(F.col("tag") == LINE)
            far = ln.join(a, _same(ln, a) & (ln["ref"] == a["r_"]), "left").select(
                *conv, "uuid", "line_id", (F.col("n") + F.coalesce(F.col("n_") + 1, F.lit(0))).alias("links_up"), F.greatest("seq", "q_").alias("seq")
            )
            bad = verdicts.where("reason <> ''").select(F.col("session_id").alias("s_"), F.col("agent_id").alias("a_"))
            lines = _once(few.unionByName(far.join(bad, _same(far, bad), "left_anti")))
    return verdicts, lines


def _once(lines: DataFrame) -> DataFrame:
    """A line delivered twice comes once, under its first number."""
    key = F.coalesce("uuid", F.concat(F.lit("\x1f"), F.col("line_id").cast("string")))
    return lines.groupBy("session_id", "agent_id", key.alias("k")).agg(F.min("line_id").alias("line_id"), F.min("links_up").alias("links_up"), F.min("seq").alias("seq")).drop("k")


def _close_exits(parts: DataFrame) -> DataFrame:
    """For every link between chunks: where it ends and the nearest prompt above.

    session_id, agent_id, ref, fate ('ok', 'missing', 'loop'), prompt ('' without), n, flag (a reply waits below).
    """
    conv = ["session_id", "agent_id"]
    lines = (
        parts.where(F.col("tag") == LINE)
        .groupBy(F.col("session_id").alias("s_"), F.col("agent_id").alias("a_"), F.col("uuid").alias("u_"))
        .agg(F.min_by(F.struct("ref", "prompt", "n", "flag", "seq"), "line_id").alias("at"))
    )
    refs = parts.where(F.col("tag") == EXIT).groupBy(*conv, "ref").agg(F.max("flag").alias("flag"))
    cur = stage(
        refs.join(lines, _same(refs, lines) & (refs["ref"] == lines["u_"]), "left").select(
            *conv,
            refs["ref"],
            refs["flag"],
            F.when(F.col("at").isNull(), "missing").when(F.col("at.flag"), "loop").when(F.col("at.ref").isNull(), "ok").alias("fate"),
            F.col("at.ref").alias("ptr"),
            F.when(F.col("at.prompt").isNotNull(), F.col("at.prompt")).when(F.col("at.ref").isNull(), "").alias("prompt"),
            F.coalesce(F.col("at.n"), F.lit(0)).alias("n"),
            F.coalesce(F.col("at.seq"), F.lit(-1)).alias("seq"),
        )
    )
    left, jumps, total = cur.where("fate is null").count(), 1, cur.count()
    while left and jumps <= 2 * total:
        up = cur.select(
            F.col("session_id").alias("s_"), F.col("agent_id").alias("a_"), F.col("ref").alias("r_"), F.col("fate").alias("f_"),
            F.col("ptr").alias("p_"), F.col("prompt").alias("q_"), F.col("n").alias("n_"), F.col("seq").alias("m_"),
        )
        moving = cur["fate"].isNull()
        nxt = stage(
            cur.join(up, moving & _same(cur, up) & (cur["ptr"] == up["r_"]), "left").select(
                *conv,
                "ref",
                "flag",
                F.coalesce("fate", "f_").alias("fate"),
                F.when(F.col("fate").isNull(), F.col("p_")).alias("ptr"),
                F.coalesce("prompt", "q_").alias("prompt"),
                (F.col("n") + F.when(F.col("fate").isNull(), F.col("n_") + 1).otherwise(0)).alias("n"),
                F.when(F.col("fate").isNull(), F.greatest("seq", "m_")).otherwise(F.col("seq")).alias("seq"),
            )
        )
        unstage(cur)
        cur, jumps = nxt, 2 * jumps
        left = cur.where("fate is null").count()
    # what still moves after as many jumps as there are links goes round
    return cur.withColumn("fate", F.coalesce("fate", F.lit("loop"))).withColumn("prompt", F.coalesce("prompt", F.lit("")))


def _large_verdicts(parts: DataFrame, at: DataFrame) -> DataFrame:
    conv = ["session_id", "agent_id"]
    facts = (
        parts.where(F.col("tag") == FACTS)
        .groupBy(*conv)
        .agg(
            F.max(F.col("prompt") == "loop").alias("looped"),
            F.max(F.col("prompt") == "lone").alias("lone"),
            F.max(F.col("n") % 2 == 1).alias("has_prompt"),
            F.max(F.col("n") >= 2).alias("has_reply"),
        )
    )
    sizes = parts.where(F.col("tag") == LINE).groupBy(*conv).agg(
        F.countDistinct(F.coalesce("uuid", F.col("line_id").cast("string"))).alias("n_lines")
    )
    fates = at.groupBy(*conv).agg(F.max(F.col("fate") == "missing").alias("missing"), F.max(F.col("fate") == "loop").alias("gone_round"))
    replied = at.where("flag and prompt <> ''").select(*conv, F.col("prompt").alias("uuid")).unionByName(
        parts.where(F.col("tag") == ANSWER).select(*conv, "uuid")
    )
    prompts = parts.where(F.col("tag").isin(UNANSWERED)).select(*conv, "uuid").distinct()
    silent = prompts.join(replied.distinct(), [*conv, "uuid"], "left_anti").groupBy(*conv).agg(F.lit(True).alias("silent"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return (
        facts.join(sizes, conv, "left")
        .join(fates, conv, "left")
        .join(silent, conv, "left")
        .select(
            *conv,
            "n_lines",
            F.when(no("missing"), "broken link")
            .when(no("looped") | no("gone_round"), "loop")
            .when(~no("has_prompt"), "no prompt")
            .when(~no("has_reply"), "no assistant text")
            .when(no("lone") | no("silent"), "prompt without reply")
            .otherwise("")
            .alias("reason"),
        )
    )


def ordered(transcripts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The sound conversations: session_id, agent_id, turn_no, line_id, role, symbol.

    Lines come by their sequence number, one that was delivered before what it answers right behind that;
    a line delivered twice comes once.
    """
    flat = stage(symbols(transcripts))
    _, lines = examine(transcripts, chunk, True, flat)
    numbered = running_total(lines.withColumn("one", F.lit(1).cast("bigint")), ["session_id", "agent_id"], ["seq", "links_up", "line_id"], "one", "turn_no")
    roles = flat.select("session_id", "agent_id", "line_id", "role", "symbol").dropDuplicates(["session_id", "agent_id", "line_id"])
    return numbered.join(roles, ["session_id", "agent_id", "line_id"]).select("session_id", "agent_id", "turn_no", "line_id", "role", "symbol")

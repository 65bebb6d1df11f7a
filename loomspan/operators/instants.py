"""Mixed timestamp forms and zones as one UTC microsecond value.

All valid interpretations of a value are generated as an array of candidates
(form, instant, cost). For each source the cheapest sequence of interpretations
in record order is chosen by the Viterbi algorithm: a switch of the form and a
jump back in time each cost ``SWITCH`` and ``BACK``, and reading against the
stated conventions costs more than any order can win back.

The sequences are range-partitioned on (source, record order), so a source with
a third of all rows spreads over many tasks. A row with one interpretation
splits its sequence exactly. Across partition borders the algorithm is the
(min, +) product of one small matrix per partition: pass 1 gives the matrices,
the driver multiplies them (as many as there are partitions, each at most
MAX_CANDIDATES squared), and pass 2 decodes every partition with its borders fixed.

Defined results: NULL, blank, zero, negative and impossible values have no
instant and take no part; digits finer than microseconds are cut off; repeated
rows each get their instant; a NULL zone is UTC; NULL sources form one
sequence; a NULL row id is -1; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.instants import Reading, readings
from loomspan.operators.bad_rows import known_id, ledger_record, time_text, with_zone
from loomspan.runtime import stage
from loomspan.sources.grammar import one_json_object

SWITCH, BACK = 1.0, 1.0
MAX_CANDIDATES = 8
#: Rows of one partition; a pandas frame of a partition takes some 100 bytes a row.
ROWS_A_TASK = 250_000

_COLS = ["src_table", "source_id", "ord", "row_id", "is_case", "n", "form", "us", "alt"]
_SCHEMA = "src_table string, source_id string, ord string, row_id bigint, is_case boolean, n int, form string, us bigint, alt string"
USUAL_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"


def _pack(found: list[Reading]) -> tuple[int, str | None, int | None, str | None]:
    if len(found) > MAX_CANDIDATES:  # two orders of day and month by three senses of a zone are the most there are
        raise AssertionError(f"{len(found)} readings")
    if not found:
        return 0, None, None, None
    alt = ";".join(f"{r.form}|{r.utc_us}|{r.cost}" for r in found) if len(found) > 1 else None
    return len(found), found[0].form, found[0].utc_us, alt


def _unpack(alt: str) -> list[Reading]:
    return [Reading(f, int(u), float(c)) for f, u, c in (x.split("|") for x in alt.split(";"))]


def _padded(c: Column) -> Column:
    return F.lpad(c.cast("string"), 20, "0")


def _odd_texts(df: DataFrame) -> DataFrame:
    """Candidates of the values in ``written``; df: src_table, source_id, ord, row_id, written, _tz."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, s, o, i, w, tz in zip(b["src_table"], b["source_id"], b["ord"], b["row_id"], b["written"], b["_tz"]):
                rows.append((t, s, o, i, True, *_pack(readings(w, tz if isinstance(tz, str) else None))))
            yield _frame(rows)

    return df.mapInPandas(run, _SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    p = pd.DataFrame(rows, columns=_COLS)
    p["us"] = p["us"].astype("Int64")
    return p


def text_values(df: DataFrame, src_table: str, row_id: str, column: str, sources: DataFrame) -> DataFrame:
    """Candidates of a text column. The usual form never leaves the JVM."""
    base = known_id(df, row_id).select(
        F.lit(src_table).alias("src_table"),
        "source_id",
        _padded(F.col(row_id)).alias("ord"),
        F.col(row_id).alias("row_id"),
        F.col(column).alias("written"),
    ).where(F.trim("written") != "")
    is_usual = F.col("written").rlike(USUAL_TEXT)
    usual = base.where(is_usual).select(
        "src_table",
        "source_id",
        "ord",
        "row_id",
        F.lit(False).alias("is_case"),
        F.lit(1).alias("n"),
        F.lit("isoz").alias("form"),
        F.unix_micros(F.try_to_timestamp("written", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX"))).alias("us"),
        F.lit(None).cast("string").alias("alt"),
    ).where("us > 0")
    return usual.unionByName(_odd_texts(with_zone(base.where(~is_usual), sources)))


def first_reading(written: Column, tz: Column) -> Column:
    """The cheapest reading of each written time on its own, without its neighbours. The usual form never leaves the JVM."""

    @F.pandas_udf("bigint")
    def odd(w: pd.Series, z: pd.Series) -> pd.Series:
        got = [readings(x, y if isinstance(y, str) else None) if isinstance(x, str) else [] for x, y in zip(w, z)]
        return pd.Series([g[0].utc_us if g else None for g in got], dtype="Int64")

    usual = written.rlike(USUAL_TEXT)
    at = F.unix_micros(F.try_to_timestamp(written, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSX")))
    return F.when(usual, F.when(at > 0, at)).otherwise(odd(F.when(~usual, written), tz))


def number_values(df: DataFrame, src_table: str, row_id: str, column: str, sources: DataFrame) -> DataFrame:
    """Candidates of an integer column whose usual form is microseconds."""
    base = known_id(df, row_id).select(
        F.lit(src_table).alias("src_table"),
        "source_id",
        _padded(F.col(row_id)).alias("ord"),
        F.col(row_id).alias("row_id"),
        F.col(column).cast("string").alias("written"),
        F.col(column).alias("us"),
    ).where("us > 0")
    is_usual = F.length("written") == 16
    usual = base.where(is_usual).select(
        "src_table", "source_id", "ord", "row_id", F.lit(False).alias("is_case"), F.lit(1).alias("n"),
        F.lit("epoch_us").alias("form"), "us", F.lit(None).cast("string").alias("alt"),
    )
    return usual.unionByName(_odd_texts(with_zone(base.where(~is_usual).drop("us"), sources)))


def ledger_values(ledger: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates of ``ts`` of the valid ledger lines."""
    import re

    usual = re.compile(USUAL_TEXT)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, name, no, i, text, tz in zip(b["source_id"], b["file_name"], b["line_no"], b["row_id"], b["raw_text"], b["_tz"]):
                tz = tz if isinstance(tz, str) else None
                obj, _ = ledger_record(text if isinstance(text, str) else None, tz)
                if obj is None:
                    continue
                v = obj.get("ts")
                w = time_text(v)
                if w is None:
                    continue
                case = not (isinstance(v, str) and usual.match(v))
                rows.append(("ledger_lines", s, f"{name}#{0 if pd.isna(no) else int(no):010d}#{i:020d}", i, case, *_pack(readings(w, tz))))
            yield _frame(rows)

    return known_id(with_zone(ledger, sources).select("source_id", "file_name", "line_no", "row_id", "raw_text", "_tz"), "row_id").mapInPandas(run, _SCHEMA)


def snapshot_values(snapshots: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates of ``opTree.startedAt``; the usual form is an integer of milliseconds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, i, text, tz in zip(b["source_id"], b["row_id"], b["raw_text"], b["_tz"]):
                obj, _ = one_json_object(text) if isinstance(text, str) else (None, None)
                tree = (obj or {}).get("opTree")
                v = tree.get("startedAt") if isinstance(tree, dict) else None
                w = time_text(v)
                if w is None:
                    continue
                case = not (isinstance(v, int) and len(w) == 13)
                rows.append(("snapshot_files", s, f"{i:020d}", i, case, *_pack(readings(w, tz if isinstance(tz, str) else None))))
            yield _frame(rows)

    return known_id(with_zone(snapshots, sources).select("source_id", "row_id", "raw_text", "_tz"), "row_id").mapInPandas(run, _SCHEMA)


def _step(a: Reading, b: Reading) -> float:
    return (SWITCH if a.form != b.form else 0.0) + (BACK if b.utc_us < a.utc_us else 0.0) + b.cost


def _forward(start: list[float], cands: list[list[Reading]]) -> tuple[list[float], list[list[int]]]:
    """From the costs of the first record's candidates to those of the last's, with back pointers."""
    v, back = start, []
    for prev, cur in zip(cands, cands[1:]):
        nxt, ptr = [], []
        for b in cur:
            k = min(range(len(prev)), key=lambda i: (v[i] + _step(prev[i], b), i))
            nxt.append(v[k] + _step(prev[k], b))
            ptr.append(k)
        v = nxt
        back.append(ptr)
    return v, back


def _decode(cands: list[list[Reading]], first: int | None, last: int | None) -> list[int]:
    """The cheapest choice, with the first and last record's candidate given or free."""
    inf = float("inf")
    start = [c.cost if first is None or i == first else inf for i, c in enumerate(cands[0])]
    v, back = _forward(start, cands)
    k = last if last is not None else min(range(len(v)), key=lambda i: (v[i], i))
    out = [k]
    for ptr in reversed(back):
        k = ptr[k]
        out.append(k)
    return out[::-1]


def _pieces(b: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """The partition in order, and [from, to) of each source's piece in it."""
    b = b.sort_values(["src_table", "source_id", "ord"], kind="stable", na_position="first").reset_index(drop=True)
    key = b["src_table"] + "\x1f" + b["source_id"].fillna("")
    cut = [0, *(i for i in (key != key.shift()).to_numpy().nonzero()[0] if i), len(b)]
    return b, list(zip(cut, cut[1:]))


def _cands(b: pd.DataFrame, i: int) -> list[Reading]:
    return _unpack(b.at[i, "alt"]) if b.at[i, "n"] > 1 else [Reading(b.at[i, "form"], int(b.at[i, "us"]), 0.0)]


def _to_anchor(b: pd.DataFrame, at: int, end: int, step: int) -> int:
    """The nearest row from ``at`` in direction ``step`` with one candidate, or the last one before ``end``."""
    while at + step != end and b.at[at, "n"] > 1:
        at += step
    return at


def _summary(b: pd.DataFrame) -> pd.DataFrame:
    """Pass 1: the partition's first and last pieces as seen from its borders."""
    b, pieces = _pieces(b)
    import json

    (f0, f1), (l0, l1) = pieces[0], pieces[-1]
    head = [_cands(b, i) for i in range(f0, _to_anchor(b, f0, f1, 1) + 1)]
    tail = [_cands(b, i) for i in range(_to_anchor(b, l1 - 1, l0 - 1, -1), l1)]
    inf = float("inf")
    unit = lambda i, c: [x.cost if k == i else inf for k, x in enumerate(c)]
    if len(pieces) == 1 and len(head) == f1 - f0:
        m = [_forward(unit(i, head[0]), head)[0] for i in range(len(head[0]))]
    else:
        # an anchor lies between: the cost of the way is a sum of both ends
        a = [min(_forward(unit(i, head[0]), head)[0]) for i in range(len(head[0]))]
        z = _forward([c.cost for c in tail[0]], tail)[0]
        m = [[x + y for y in z] for x in a]
    one = lambda i: f"{b.at[i, 'src_table']}\x1f{b.at[i, 'source_id'] if isinstance(b.at[i, 'source_id'], str) else ''}"
    row = {"first": head[0], "last": tail[-1], "m": m, "key_first": one(f0), "key_last": one(l1 - 1), "whole": len(pieces) == 1}
    return pd.DataFrame({"_part": [int(b.at[0, "_part"])], "summary": [json.dumps(row)]})


def _borders(rows: list[tuple[int, str]]) -> dict[int, tuple[int | None, int | None]]:
    """The (min, +) product over the partitions: the first and last candidate of each."""
    import json

    parts = []
    for p, text in sorted(rows):
        r = json.loads(text)
        r["first"], r["last"] = ([Reading(f, u, c) for f, u, c in r[k]] for k in ("first", "last"))
        parts.append((p, r))
    exits: list[list[float]] = []
    entry: list[tuple[list[float], list[int | None]]] = []
    for k, (_, r) in enumerate(parts):
        if k and parts[k - 1][1]["key_last"] == r["key_first"]:
            prev, e = parts[k - 1][1]["last"], exits[-1]
            # the matrix already holds the first record's own cost
            way = [[e[j] + _step(prev[j], c) - c.cost for j in range(len(prev))] for c in r["first"]]
            come = [min(w) for w in way], [w.index(min(w)) for w in way]
        else:
            come = [0.0] * len(r["first"]), [None] * len(r["first"])
        entry.append(come)
        cols = range(len(r["last"]))
        if r["whole"]:
            exits.append([min(come[0][i] + r["m"][i][j] for i in range(len(r["first"]))) for j in cols])
        else:
            exits.append([min(row[j] for row in r["m"]) for j in cols])
    chosen: dict[int, tuple[int | None, int | None]] = {}
    wanted: int | None = None
    for k in range(len(parts) - 1, -1, -1):
        p, r = parts[k]
        last = wanted if wanted is not None else exits[k].index(min(exits[k]))
        j = last if r["whole"] else min(range(len(r["last"])), key=lambda x: r["m"][0][x])
        costs = [entry[k][0][i] + r["m"][i][j] for i in range(len(r["first"]))]
        first = costs.index(min(costs))
        chosen[p] = (first, last)
        wanted = entry[k][1][first]
    return chosen


def viterbi(values: DataFrame) -> DataFrame:
    """Chooses each row's interpretation: src_table, source_id, row_id, is_case, form, utc_us."""
    spark = values.sparkSession
    values = stage(values.where("n > 0"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), values.count() // ROWS_A_TASK)
    parted = stage(
        values.repartitionByRange(n, "src_table", "source_id", "ord").withColumn("_part", F.spark_partition_id())
    )
    rows = parted.groupBy("_part").applyInPandas(_summary, "_part int, summary string").collect()  # one a partition
    fixed = spark.sparkContext.broadcast(_borders([(r["_part"], r["summary"]) for r in rows]))

    def decode(b: pd.DataFrame) -> pd.DataFrame:
        b, pieces = _pieces(b)
        first, last = fixed.value[int(b.at[0, "_part"])]
        us, form, n_of = b["us"].astype("int64").to_numpy().copy(), b["form"].to_numpy().copy(), b["n"].to_numpy()
        for lo, hi in pieces:
            i = lo
            many = [x for x in (n_of[lo:hi] > 1).nonzero()[0] + lo]
            k = 0
            while k < len(many):
                i = j = many[k]
                while k + 1 < len(many) and many[k + 1] == j + 1:
                    k += 1
                    j = many[k]
                k += 1
                a, z = max(lo, i - 1), min(hi - 1, j + 1)
                cands = [_cands(b, x) for x in range(a, z + 1)]
                pick = _decode(cands, first if a == 0 and lo == 0 else None, last if z == len(b) - 1 else None)
                for x, c, q in zip(range(a, z + 1), cands, pick):
                    us[x], form[x] = c[q].utc_us, c[q].form
        return pd.DataFrame(
            {"src_table": b["src_table"], "source_id": b["source_id"], "row_id": b["row_id"], "is_case": b["is_case"], "form": form, "utc_us": us}
        )

    return parted.groupBy("_part").applyInPandas(
        decode, "src_table string, source_id string, row_id bigint, is_case boolean, form string, utc_us bigint"
    )


def project_times(transcripts: DataFrame, ledger: DataFrame, snapshots: DataFrame, sessions: DataFrame, sources: DataFrame) -> DataFrame:
    return viterbi(
        text_values(transcripts, "transcript_lines", "line_id", "line_timestamp", sources)
        .unionByName(ledger_values(ledger, sources))
        .unionByName(snapshot_values(snapshots, sources))
        .unionByName(number_values(sessions, "sessions", "row_id", "start_ts", sources))
    )

"""Additive time-bucket rollups over six dimensions, tail collapse, series and top-N."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.filters import BadRequest, SessionFilter
from loomspan.operators.filters import apply as filter_sessions
from loomspan.operators.stats import count_if, money
from loomspan.operators.windows import positions
from loomspan.runtime import stage

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000
SPANS = {"hour": HOUR_US, "day": DAY_US}
OTHER, CAP = "__other__", 2000
DIMENSIONS = ("total", "agent", "model", "provider", "tool", "cwd")
MEASURES = ("op_count", "tokens_in", "tokens_out", "cost_usd", "failures", "duration_us", "session_starts")
#: metric -> measure of a rollup row
METRICS = {
    "cost": "cost_usd", "tokens_in": "tokens_in", "tokens_out": "tokens_out", "calls": "op_count",
    "failures": "failures", "duration_us": "duration_us", "sessions": "session_starts",
}
KEYS = ["bucket_ts", "source_format", "dimension", "dimension_value"]


def bucket(c: str, span_us: int) -> Column:
    """Start of the bucket, also for times before 1970."""
    return F.col(c) - F.pmod(F.col(c), F.lit(span_us))


def joined(ops: DataFrame, sessions: DataFrame, sources: DataFrame) -> DataFrame:
    s = sessions.select(F.col("id").alias("session_id"), "source_id", "agent_name", "cwd")
    f = sources.select(F.col("id").alias("source_id"), "source_format")
    return ops.join(s, "session_id").join(f, "source_id")


def _fan(*pairs: tuple[str, Column]) -> Column:
    """Dimension rows of one record; an empty value makes none."""
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("dimension_value")) for d, v in pairs])
    return F.filter(rows, lambda x: (x["dimension"] == "total") | (F.coalesce(x["dimension_value"], F.lit("")) != ""))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(
        "bucket_ts", "source_format", F.col("d.dimension").alias("dimension"), F.col("d.dimension_value").alias("dimension_value")
    ).agg(*[F.sum(m).cast("double" if m == "cost_usd" else "bigint").alias(m) for m in MEASURES])


def _op_rows(ops: DataFrame, sessions: DataFrame, sources: DataFrame, span_us: int) -> DataFrame:
    tool = F.when(F.col("namespace") != "", F.concat_ws(".", "namespace", "tool")).otherwise(F.col("tool"))
    took = F.when(F.col("end_ts") > F.col("start_ts"), F.col("end_ts") - F.col("start_ts")).otherwise(0)
    return joined(ops, sessions, sources).select(
        bucket("start_ts", span_us).alias("bucket_ts"),
        "source_format",
        F.explode(
            _fan(
                ("total", F.lit("")),
                ("agent", F.col("agent_name")),
                ("model", F.when(F.col("kind") == "llm", F.col("model"))),
                ("provider", F.col("provider")),
                ("tool", F.when((F.col("kind") == "tool") & (F.col("tool") != ""), tool)),
                ("cwd", F.col("cwd")),
            )
        ).alias("d"),
        F.lit(1).cast("bigint").alias("op_count"),
        "tokens_in",
        "tokens_out",
        F.col("cost_usd").cast("decimal(38,6)").alias("cost_usd"),
        (F.col("status") == "failed").cast("bigint").alias("failures"),
        took.alias("duration_us"),
        F.lit(0).cast("bigint").alias("session_starts"),
    )


def _start_rows(sessions: DataFrame, sources: DataFrame, span_us: int) -> DataFrame:
    f = sources.select(F.col("id").alias("source_id"), "source_format")
    zero = F.lit(0).cast("bigint")
    return sessions.join(f, "source_id").select(
        bucket("start_ts", span_us).alias("bucket_ts"),
        "source_format",
        F.explode(_fan(("total", F.lit("")), ("agent", F.col("agent_name")), ("cwd", F.col("cwd")))).alias("d"),
        *[zero.alias(c) for c in ("op_count", "tokens_in", "tokens_out")],
        F.lit(0).cast("decimal(38,6)").alias("cost_usd"),
        *[zero.alias(c) for c in ("failures", "duration_us")],
        F.lit(1).cast("bigint").alias("session_starts"),
    )


def fold(ops: DataFrame, sessions: DataFrame, sources: DataFrame, span_us: int) -> DataFrame:
    """Rollup rows of operations by their own start and of session starts by the session's.

    The fan-out is a generator behind the joins and ends in partial aggregation, so
    only (bucket, dimension, value) groups are shuffled.
    """
    return _summed(_op_rows(ops, sessions, sources, span_us).unionByName(_start_rows(sessions, sources, span_us)))


def regroup(rollup: DataFrame, keys: list[str]) -> DataFrame:
    return rollup.groupBy(*keys).agg(*[(money(m) if m == "cost_usd" else F.sum(m)).alias(m) for m in MEASURES])


def collapse(rollup: DataFrame, cap: int = CAP) -> DataFrame:
    """Keeps the cap - 1 largest values per (bucket, format, dimension) if there are more than cap; the rest becomes one.

    Only values of groups that are too large are ranked, over range partitions with offsets, so a group of any size stays distributed.
    """
    group = ["bucket_ts", "source_format", "dimension"]
    rollup = stage(rollup)  # read three times, folded once
    large = rollup.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap).drop("_n")
    over = rollup.join(large, group, "left_semi")
    # NULLs can't be compared in a join but group alike; values of a rollup are never NULL
    under = rollup.join(large, group, "left_anti")
    ranked = positions(over.withColumn("_c", -F.col("op_count")), group, ["_c", "dimension_value"], "_r")
    name = F.when(F.col("_r") >= cap, OTHER).otherwise(F.col("dimension_value"))
    return under.unionByName(regroup(ranked.withColumn("dimension_value", name).drop("_r", "_c"), KEYS).select(*under.columns))


def merged(closed: DataFrame, ops: DataFrame, sessions: DataFrame, sources: DataFrame, span_us: int, now_us: int) -> DataFrame:
    """Stored closed buckets and the open ones folded live; one clock reading decides for both, so none counts twice."""
    open_from = now_us - now_us % span_us
    late = _op_rows(ops.where(F.col("start_ts") >= open_from), sessions, sources, span_us)
    late = late.unionByName(_start_rows(sessions.where(F.col("start_ts") >= open_from), sources, span_us))
    return closed.where(F.col("bucket_ts") < open_from).unionByName(_summed(late))


#: What series may be grouped by, and what may be ranked: the first are the defaults.
GROUPS = ("total", "source_format", "model", "provider", "tool", "agent", "cwd")
RANKED = ("model", "provider", "tool", "agent", "cwd")


def dimension_param(value: str, allowed: tuple[str, ...]) -> str:
    """A dimension's name, the first allowed one by default; anything else is a BadRequest."""
    if value and value not in allowed:
        raise BadRequest(f"no dimension {value}")
    return value or allowed[0]


def window(f: SessionFilter, now_us: int) -> tuple[int, int]:
    """[from, to) of statistics; without an end the present microsecond still counts."""
    return f.from_us or 0, f.to_us if f.to_us is not None else now_us + 1


def is_stored(f: SessionFilter) -> bool:
    """Whether stored buckets can answer: only times may be set."""
    return not (f.agents or f.models or f.tools or f.status or f.sources or f.q)


def aggregate(stored: DataFrame, ops: DataFrame, sessions: DataFrame, sources: DataFrame, f: SessionFilter, span_us: int, now_us: int, dimension: str = "", metric: str = "cost") -> DataFrame:
    """The series of a request, ordered by bucket, value and key.

    Closed buckets come from the stored rollup where only times are set, else from a fold of the filtered sessions; the
    open bucket is always folded. One reading of the clock decides, and a bucket counts by its start within [from, to).
    """
    dimension = dimension_param(dimension, GROUPS)
    lo, hi = window(f, now_us)
    open_from = now_us - now_us % span_us
    live_from = lo if not is_stored(f) else max(lo, open_from)
    kept = filter_sessions(sessions, f.all_sessions(), ops, time=False)
    late = _op_rows(ops.where(F.col("start_ts") >= live_from - live_from % span_us), kept, sources, span_us)
    late = _summed(late.unionByName(_start_rows(kept.where(F.col("start_ts") >= live_from - live_from % span_us), sources, span_us)))
    rows = late.where(F.col("bucket_ts") >= live_from) if not is_stored(f) else stored.where(F.col("bucket_ts") < open_from).unionByName(late.where(F.col("bucket_ts") >= open_from))
    rows = rows.where((F.col("bucket_ts") >= lo) & (F.col("bucket_ts") < hi))
    return series(rows, dimension, metric).orderBy("bucket_ts", F.desc("value"), "key")


def in_key_order(rollup: DataFrame) -> DataFrame:
    """Rollup rows in the order of their keys."""
    return rollup.orderBy(*KEYS)


def series(rollup: DataFrame, dimension: str, metric: str) -> DataFrame:
    """bucket_ts, key, value of one dimension and metric, over all formats; source_format is a dimension too."""
    by_format = dimension == "source_format"
    r = rollup.where(F.col("dimension") == ("total" if by_format else dimension))
    key = F.col("source_format" if by_format else "dimension_value").alias("key")
    m = METRICS[metric]
    return r.groupBy("bucket_ts", key).agg((money(m) if m == "cost_usd" else F.sum(m)).alias("value"))


def top(rollup: DataFrame, dimension: str, metric: str, n: int) -> DataFrame:
    s = series(rollup, dimension, metric)
    v = money("value") if METRICS[metric] == "cost_usd" else F.sum("value")
    return s.groupBy("key").agg(v.alias("value")).orderBy(F.desc("value"), "key").limit(n)


def failure_rate(rollup: DataFrame, dimension: str, keep: int) -> DataFrame:
    """Failures per call of the ``keep`` most called values and of all others together, as ratios of sums."""
    r = rollup.where(F.col("dimension") == dimension)
    best = r.groupBy("dimension_value").agg(F.sum("op_count").alias("c")).orderBy(F.desc("c"), "dimension_value").limit(keep)
    best = best.select(F.col("dimension_value").alias("_kept"))
    name = F.coalesce("_kept", F.lit("other"))
    return (
        r.join(F.broadcast(best), r["dimension_value"] == best["_kept"], "left")  # as many rows as are kept
        .groupBy("bucket_ts", name.alias("key"))
        .agg(F.sum("failures").alias("failures"), F.sum("op_count").alias("calls"))
        .withColumn("rate", F.when(F.col("calls") > 0, F.round(F.col("failures") / F.col("calls"), 9)).otherwise(0.0))
    )


def hourly_events(events: DataFrame) -> DataFrame:
    """Events per hour and type from the stream table."""
    ts = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return ts.groupBy(bucket("us", HOUR_US).alias("bucket_ts"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), money("value").alias("total"), count_if(F.col("value") < 0).alias("negative")
    )

"""Mixing sources to target shares of tokens, small sources repeated up to a cap.

*Entropy balancing*: each document's rate is the one closest to 1 (in relative
entropy) under the token constraints and the cap on repeats, an exponential tilt
``min(cap, exp(lam_s * tokens))``. The multipliers solve the convex dual by Newton
steps; each step is one aggregate over the counts by source and size (two sums a source, map-side
combined), guarded by a bracket that shrinks until it ends, so it converges for any sizes. Rates become whole copies
by systematic rounding along range-partitioned sorted order: each document gets
its rate rounded down or up; what a source's token sum then errs goes to its
shortest documents, so it errs by less than the shortest one left.

The total is the largest at which no source needs more than its cap; it follows
from the scarcest source. Defined results: sources match after trimming and
lower-casing; documents of other or NULL sources and those without tokens are
not chosen; target sources without documents reach share 0 and the others keep
their proportions; repeated rows are documents of their own; empty tables give
an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.runtime import running_total, small_rows, stage

#: Target sources, at most; multipliers and wanted tokens of that many are sent around.
MAX_SOURCES = 100_000
TOLERANCE = 1e-9


def normal_source(c: str):
    return F.lower(F.trim(F.col(c)))


def _rate(lam: str, cap: str, scale: float):
    x = F.least(F.col(lam) * F.col("n_tokens") / F.lit(scale), F.lit(700.0))
    return F.least(F.col(cap).cast("double"), F.exp(x))


def histogram(docs: DataFrame) -> DataFrame:
    """source, n_tokens, n: all that the dual depends on. Documents are read once for all Newton steps."""
    return docs.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n"))


def solve(sizes: DataFrame, targets: dict[str, tuple[float, int]]) -> tuple[dict[str, float], dict[str, float], float]:
    """(multiplier by source, wanted tokens by source, scale). sizes: source, n_tokens, n; targets: share and cap by source.

    A multiplier of infinity means that the source is used up to its cap.
    """
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n")).alias("w"), F.sum("n").alias("n"))
    held = {r["source"]: (r["w"], r["n"]) for r in totals.collect()}
    live = {s: t for s, t in targets.items() if t[0] > 0 and t[1] > 0 and held.get(s, (0, 0))[0]}
    if not live:
        return {}, {}, 1.0
    share = sum(t[0] for t in live.values())
    total = min(cap * held[s][0] / (w / share) for s, (w, cap) in live.items())
    wanted = {s: w / share * total for s, (w, _) in live.items()}
    scale = sum(held[s][0] for s in live) / sum(held[s][1] for s in live)
    lam: dict[str, float] = {}
    lo: dict[str, float] = {}
    hi: dict[str, float] = {}
    for s, (_, cap) in live.items():
        if wanted[s] >= cap * held[s][0] * (1 - 1e-12):
            lam[s] = math.inf
        else:
            lam[s], lo[s], hi[s] = 0.0, -math.inf, math.inf
    moving = sorted(lo)
    slow: dict[str, int] = {}
    last: dict[str, float] = {}
    while moving:
        now = spark.createDataFrame([(s, lam[s], live[s][1]) for s in moving], "source string, lam double, cap int")
        r = _rate("lam", "cap", scale)
        t = F.col("n_tokens") / F.lit(scale)
        exact = lambda c: F.sum((c * F.col("n")).cast("decimal(38,12)")).cast("double")  # noqa: E731  # whatever the order of tasks
        sums = (
            sizes.join(F.broadcast(now), "source")  # as many rows as there are target sources
            .groupBy("source")
            .agg(exact(t * r).alias("got"), exact(F.when(r < F.col("cap"), t * t * r).otherwise(0.0)).alias("slope"))
        )
        for x in sums.collect():
            s, got, slope = x["source"], x["got"], x["slope"]
            want = wanted[s] / scale
            if abs(got - want) <= TOLERANCE * want:
                moving.remove(s)
                continue
            if got < want:
                lo[s] = lam[s]
            else:
                hi[s] = lam[s]
            width = hi[s] - lo[s]
            step = lam[s] + (want - got) / slope if slope > 0 else math.nan
            # a Newton step outside of the bracket, or the second one in a row that less than halves it, is replaced by
            # a bisection, or by doubling while the bracket is open; so it ends at neighbouring floats at the latest
            slow[s] = slow.get(s, 0) + 1 if width > 0.5 * last.get(s, math.inf) else 0
            last[s] = width
            if not lo[s] < step < hi[s] or slow[s] > 1:
                slow[s] = 0
                a, b = lo[s], hi[s]
                step = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else 2 * a + 1 if math.isfinite(a) else 2 * b - 1
            if step in (lo[s], hi[s]):
                moving.remove(s)
            lam[s] = step
    return lam, wanted, scale


def mix(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, rate, copies of the chosen documents (copies > 0).

    docs: doc_id, source, n_tokens; targets: source, target_share, max_repeats, one row per source.
    """
    spark = docs.sparkSession
    aims = {
        (r["source"] or "").strip().lower(): (float(r["target_share"] or 0), int(r["max_repeats"] or 0))
        for r in small_rows(targets.select("source", "target_share", "max_repeats"), MAX_SOURCES, "target sources")
    }
    base = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), normal_source("source").alias("source"), "n_tokens").where(
        F.col("source").isin(*aims) & (F.col("n_tokens") > 0)
    )
    base = stage(base)
    lam, wanted, scale = solve(stage(histogram(base)), aims)
    known = spark.createDataFrame(
        [(s, 1e300 if math.isinf(x) else x, aims[s][1]) for s, x in lam.items()], "source string, lam double, cap int"
    )
    # units of 1e-9 make the running sums exact, whatever the partitions
    unit = 1_000_000_000
    rated = base.join(F.broadcast(known), "source").withColumn("rate", F.when(F.col("lam") > 1e299, F.col("cap").cast("double")).otherwise(_rate("lam", "cap", scale)))
    rated = rated.withColumn("part", F.round((F.col("rate") - F.floor("rate")) * unit).cast("bigint"))
    summed = running_total(rated, ["source"], ["n_tokens", "doc_id"], "part", "before")
    half = unit // 2
    extra = F.floor((F.col("before") + F.col("part") + half) / unit) - F.floor((F.col("before") + half) / unit)
    rounded = stage(
        summed.select(
            "doc_id", "source", "n_tokens", "rate", "cap", F.least(F.col("cap"), F.floor("rate") + extra).cast("bigint").alias("copies")
        )
    )
    return _settle(rounded, wanted).where("copies > 0")


def _settle(rounded: DataFrame, wanted: dict[str, float]) -> DataFrame:
    """Moves a source's rounding error to its shortest documents: one copy more or less each,
    from the shortest on, as long as their tokens don't exceed the error."""
    spark = rounded.sparkSession
    got = {r["source"]: r["t"] for r in rounded.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    error = spark.createDataFrame(
        [(s, int(round(w - got.get(s, 0)))) for s, w in wanted.items()], "source string, error bigint"
    )
    open_ = ((F.col("error") > 0) & (F.col("copies") < F.col("cap"))) | ((F.col("error") < 0) & (F.col("copies") > 0))
    marked = rounded.join(F.broadcast(error), "source").withColumn("room", F.when(open_, F.col("n_tokens")).otherwise(0))
    summed = running_total(marked, ["source"], ["n_tokens", "doc_id"], "room", "before")
    moved = (F.col("room") > 0) & (F.col("before") + F.col("room") <= F.abs("error"))
    return summed.select(
        "doc_id",
        "source",
        "n_tokens",
        "rate",
        (F.col("copies") + F.when(moved, F.signum("error").cast("bigint")).otherwise(0)).cast("int").alias("copies"),
    )


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, tokens, actual_share, n_docs, most_copies of every target source."""
    got = chosen.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"),
        F.count(F.lit(1)).alias("n_docs"),
        F.max("copies").alias("most_copies"),
    )
    total = got.agg(F.sum("tokens").alias("all_tokens"))
    return (
        targets.select(normal_source("source").alias("source"), "target_share", "max_repeats")
        .join(got, "source", "left")
        .join(F.broadcast(total))  # a single row
        .select(
            "source",
            "target_share",
            "max_repeats",
            F.coalesce("tokens", F.lit(0)).alias("tokens"),
            F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
            F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        )
    )

"""Related sessions, temporal prices and comparison of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.stats import money
from loomspan.operators.windows import positions
from loomspan.runtime import stage


def related_by_hash(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """Pairs of sessions with the same first prompt in different sources of different formats.

    Hash classes keep one row per (hash, format, source) with its sessions counted, so a
    prompt that a third of all sessions share makes as many rows as it has
    sources squared, not sessions squared.
    """
    s = (
        sessions.where("first_user_message_hash <> ''")
        .join(sources.select(F.col("id").alias("source_id"), "source_format"), "source_id")
        .groupBy(F.col("first_user_message_hash").alias("h"), "source_id", "source_format")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    )
    a, b = s.alias("a"), s.alias("b")
    return a.join(
        b, (F.col("a.h") == F.col("b.h")) & (F.col("a.source_id") != F.col("b.source_id")) & (F.col("a.source_format") != F.col("b.source_format"))
    ).select(F.col("a.h").alias("prompt_hash"), F.col("a.source_id"), F.col("b.source_id").alias("other_source_id"), F.col("a.first_id"), F.col("b.first_id").alias("other_id"), F.col("b.n").alias("n_others"))


def hash_members(sessions: DataFrame, sources: DataFrame) -> DataFrame:
    """id, prompt_hash, source_id, source_format of every session in a class of ``related_by_hash``: who is meant by its first ids."""
    return sessions.where("first_user_message_hash <> ''").join(sources.select(F.col("id").alias("source_id"), "source_format"), "source_id").select(
        "id", F.col("first_user_message_hash").alias("prompt_hash"), "source_id", "source_format"
    )


#: Starts of one directory that fall into one bucket of the search by time, about.
STARTS = 256


def related_by_time(sessions: DataFrame, wanted: DataFrame, now_us: int, most: int = 10) -> DataFrame:
    """For sessions without a prompt hash: others of the same directory that started while it ran, the ``most`` first.

    Starts of a directory are numbered in order; what began while a session ran is a range of numbers, of which only the
    first are wanted. They are looked up in buckets of numbers, as many as can hold them, so a directory that a third of all sessions
    share gives no more pairs than any other: per session those of its own source and itself, which are passed over, and ``most`` more.
    """
    s = sessions.join(wanted.select("id"), "id", "left_semi").where("coalesce(first_user_message_hash, '') = '' and start_ts is not null and cwd <> ''")
    s = s.select(F.col("id").alias("session_id"), "cwd", F.col("start_ts").alias("s0"), F.coalesce("end_ts", F.lit(now_us)).alias("s1"), F.col("source_id").alias("_src"))
    r = sessions.where("start_ts is not null and cwd <> ''").select("cwd", F.col("start_ts").alias("r0"), F.col("id").alias("related_id"), F.coalesce("source_id", F.lit("")).alias("_rs"))
    r = positions(r, ["cwd"], ["r0", "related_id"], "n").withColumn("bucket", F.floor((F.col("n") - 1) / STARTS).cast("bigint"))
    r = stage(r)
    edges = r.groupBy(F.col("cwd").alias("_c"), "bucket").agg(F.min("r0").alias("b0"), F.max("r0").alias("b1"), F.countDistinct("_rs").alias("n_src"), F.min("_rs").alias("one_src"))
    # of the buckets that a session's time touches, each but the first and last gives a partner unless all its starts are of the
    # session's own source; so most + 1 of the others hold the partners that are wanted
    touched = s.join(edges, (F.col("cwd") == F.col("_c")) & (F.col("b1") >= F.col("s0")) & (F.col("b0") <= F.col("s1")))
    useful = touched.where("n_src > 1 or one_src <> coalesce(_src, '')")
    first = useful.groupBy("session_id").agg(F.slice(F.array_sort(F.collect_list("bucket")), 1, most + 1).alias("bs"))
    near = s.join(first, "session_id").select(*s.columns, F.explode("bs").alias("_b"))
    pairs = near.join(
        r.select(F.col("cwd").alias("_c"), F.col("bucket").alias("_rb"), "r0", "related_id", "_rs"),
        (F.col("cwd") == F.col("_c")) & (F.col("_b") == F.col("_rb")) & (F.col("r0") >= F.col("s0")) & (F.col("r0") <= F.col("s1")) & (F.col("session_id") != F.col("related_id")) & (F.coalesce("_src", F.lit("")) != F.col("_rs")),
    )
    w = Window.partitionBy("session_id").orderBy("r0", "related_id")
    return pairs.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).select("session_id", "related_id", "pos", (F.col("r0") - F.col("s0")).alias("after_us"))


def related(sessions: DataFrame, sources: DataFrame, wanted: DataFrame, now_us: int, most: int = 10) -> DataFrame:
    """session_id, related_id, basis ("hash" or "time"), pos: one list per wanted session, at most ``most``, those with the same prompt first.

    A session's partners by hash are the first of each other source and format; all of them are in ``hash_members``.
    """
    h = hash_members(sessions, sources)
    classes = related_by_hash(sessions, sources).select("prompt_hash", "source_id", F.col("other_id").alias("related_id"))
    by_hash = h.join(wanted.select("id"), "id", "left_semi").select(F.col("id").alias("session_id"), "prompt_hash", "source_id").join(classes, ["prompt_hash", "source_id"])
    by_hash = by_hash.select("session_id", "related_id", F.lit("hash").alias("basis"), F.lit(0).cast("bigint").alias("after_us"))
    both = by_hash.unionByName(related_by_time(sessions, wanted, now_us, most).select("session_id", "related_id", F.lit("time").alias("basis"), "after_us"))
    w = Window.partitionBy("session_id").orderBy("basis", "after_us", "related_id")
    return both.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most).drop("after_us")


# ---- prices -----------------------------------------------------------------------------------------------
#: Token counts of an operation with their price per million.
PRICED = {"tokens_in": "input_per_million", "tokens_out": "output_per_million", "tokens_cache_read": "cache_read_per_million", "tokens_cache_write": "cache_write_per_million"}


def price_keys(prices: DataFrame) -> DataFrame:
    """One row per lower-cased provider and model alias and tier.

    prices: provider, provider_aliases, model, model_aliases, effective_day and a price per million of each token class.
    """
    every = lambda n, a: F.array_distinct(F.transform(F.concat(F.array(n), F.coalesce(a, F.array().cast("array<string>"))), F.lower))
    return prices.select(F.explode(every("provider", "provider_aliases")).alias("provider_key"), "model", "model_aliases", "effective_day", *PRICED.values()).select(
        "provider_key", F.explode(every("model", "model_aliases")).alias("model_key"), "effective_day", *PRICED.values()
    )


def priced(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """As-of join: each operation with the latest tier effective at its start; unpriced ones stay with NULL.

    The tiers of a key travel as one sorted array, so an operation is never
    multiplied: an equi-join and a filter within the array. An operation without a time has the latest tier; one in front of the first tier none.
    """
    tiers = keys.groupBy("provider_key", "model_key").agg(F.array_sort(F.collect_list(F.struct("effective_day", *PRICED.values()))).alias("tiers"))
    day = F.floor(F.col("start_ts") / 86_400_000_000).cast("bigint")
    timeless = F.coalesce(F.col("start_ts"), F.lit(0)) <= 0
    o = ops.withColumn("_day", F.when(~timeless, day)).withColumn("_p", F.lower(F.coalesce("provider", F.lit("")))).withColumn("_m", F.lower(F.coalesce("model", F.lit(""))))
    j = o.join(tiers, (o["_p"] == tiers["provider_key"]) & (o["_m"] == tiers["model_key"]), "left")
    due = F.filter("tiers", lambda t: F.col("_day").isNull() | (t["effective_day"] <= F.col("_day")))
    j = j.withColumn("_t", F.when(F.size(due) > 0, F.element_at(due, -1)))
    cost = F.lit(0.0)
    for n, p in PRICED.items():
        if n in ops.columns:
            cost = cost + F.coalesce(F.col(n), F.lit(0)) * F.coalesce(F.col(f"_t.{p}"), F.lit(0.0)) / 1_000_000
    j = j.withColumn("priced_usd", F.when(F.col("_t").isNotNull(), F.round(cost, 9))).withColumn("tier_day", F.col("_t.effective_day"))
    return j.drop("_day", "_p", "_m", "_t", "tiers", "provider_key", "model_key")


def on_finalize(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """``cost_usd`` of finished model operations: what the source says, or the price where it says 0; others keep theirs."""
    llm = (F.col("kind") == "llm") & (F.coalesce("cost_usd", F.lit(0.0)) == 0)
    p = priced(ops, keys)
    return p.withColumn("cost_usd", F.when(llm & F.col("priced_usd").isNotNull(), F.col("priced_usd")).otherwise(F.col("cost_usd"))).drop("priced_usd", "tier_day")


def repriced(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """ops with a price where there is none yet: model operations of a named model with fresh input tokens and cost 0."""
    due = (F.col("kind") == "llm") & (F.col("cost_usd") == 0) & (F.col("tokens_in") > 0) & (F.coalesce("model", F.lit("")) != "")
    p = priced(ops, keys)
    new = F.coalesce(F.when(F.col("priced_usd") > 0, F.col("priced_usd")), F.lit(0.0))
    return p.withColumn("cost_usd", F.when(due, new).otherwise(F.col("cost_usd"))).drop("priced_usd", "tier_day")


def cost_cascade(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turn costs, session costs) after prices changed: sums of operations, then sums of turns."""
    turns = ops.groupBy("session_id", "turn_seq").agg(money("cost_usd").alias("cost_usd"))
    return turns, turns.groupBy("session_id").agg(money("cost_usd").alias("cost_usd"))


def price_misses(priced_ops: DataFrame) -> DataFrame:
    """One warning per lower-cased provider and model without a price."""
    return (
        priced_ops.where("kind = 'llm' and priced_usd is null")
        .groupBy(F.lower(F.coalesce("provider", F.lit(""))).alias("provider"), F.lower(F.coalesce("model", F.lit(""))).alias("model"))
        .agg(F.count(F.lit(1)).alias("n_ops"))
    )


# ---- comparison of two to four sessions -------------------------------------------------------------------
def _picked(ops: DataFrame, ids: list) -> DataFrame:
    if not 2 <= len(set(ids)) <= 4:
        raise ValueError("compare from 2 to 4 sessions")
    return ops.where(F.col("session_id").isin(*ids))


def tool_histogram(ops: DataFrame, ids: list) -> DataFrame:
    """Calls per tool with a column per session, and whether all sessions use it."""
    p = _picked(ops, ids).where("kind = 'tool'").groupBy("tool").pivot("session_id", ids).agg(F.count(F.lit(1)))
    cols = [f"s{k}" for k in range(len(ids))]
    p = p.toDF("tool", *cols).fillna(0, cols)
    return p.withColumn("common", F.forall(F.array(*cols), lambda n: n > 0))


def tool_changes(ops: DataFrame, ids: list) -> DataFrame:
    """tool, change: used by all sessions, or, beside the first one, added or removed."""
    h = tool_histogram(ops, ids)
    first, later = F.col("s0") > 0, F.array_max(F.array(*[f"s{k}" for k in range(1, len(ids))])) > 0
    return h.select("tool", F.when(F.col("common"), "common").when(~first, "added").when(~later, "removed").otherwise("some").alias("change"))


def only_in(ops: DataFrame, ids: list) -> DataFrame:
    """session_id, kind, name of failures that no other of the sessions has."""
    name = F.coalesce("tool", "model", F.lit(""))
    f = _picked(ops, ids).where("status = 'failed'").groupBy("kind", name.alias("name")).agg(F.min("session_id").alias("session_id"), F.countDistinct("session_id").alias("_n"))
    return f.where("_n = 1").select("session_id", "kind", "name")


def kind_distribution(ops: DataFrame, ids: list) -> DataFrame:
    return _picked(ops, ids).groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"))


def best_worst(sessions: DataFrame, ops: DataFrame, ids: list) -> DataFrame:
    """Shortest, longest, cheapest and dearest session; ties go to the smaller id. An end before the start is duration 0."""
    s = sessions.where(F.col("id").isin(*ids)).select(
        "id", F.when(F.col("end_ts") > F.col("start_ts"), F.col("end_ts") - F.col("start_ts")).otherwise(0).alias("took")
    )
    c = ops.where(F.col("session_id").isin(*ids)).groupBy(F.col("session_id").alias("_s")).agg(money("cost_usd").alias("cost"))
    j = s.join(c, s["id"] == c["_s"], "left").withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    return j.agg(
        F.min_by("id", F.struct("took", "id")).alias("fastest"),
        F.min_by("id", F.struct(-F.col("took"), "id")).alias("slowest"),
        F.min_by("id", F.struct("cost", "id")).alias("cheapest"),
        F.min_by("id", F.struct(-F.col("cost"), "id")).alias("dearest"),
    )


def common_errors(ops: DataFrame, ids: list) -> DataFrame:
    """Failed (kind, name) composites with the number of sessions, in all of them or only in one."""
    name = F.coalesce("tool", "model", F.lit(""))
    g = _picked(ops, ids).where("status = 'failed'").groupBy("kind", name.alias("name")).agg(
        F.countDistinct("session_id").alias("n_sessions"), F.min_by("session_id", F.struct("start_ts", "session_id")).alias("example")
    )
    return g.withColumn("in_all", F.col("n_sessions") == len(set(ids)))


def shared_values(sessions: DataFrame, ids: list, fields: list[str]) -> DataFrame:
    """Each field with its distinct values over the sessions, and whether they diverge."""
    s = sessions.where(F.col("id").isin(*ids))
    long = s.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit("")).alias("value")) for f in fields])).alias("x"))
    return long.groupBy("x.field").agg(F.countDistinct("x.value").alias("n_values"), F.min("x.value").alias("least_value")).withColumn("shared", F.col("n_values") == 1)

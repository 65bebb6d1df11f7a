"""Ordered per-key computations that stay distributed for keys of any size.

A plain window puts a whole key in one task. Here rows are range-partitioned on
(keys, order); windows run within (partition, key), and what a key carries over a
partition border, one small row per border, goes through the driver.
``order`` must be a total order within the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.runtime import running_total, stage


def ranged(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Adds ``_part``: partitions of contiguous (keys, order) ranges."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(df.repartitionByRange(n, *[F.col(c) for c in (*keys, *order)]).withColumn("_part", F.spark_partition_id()))


def carry_last(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, include_row: bool = False, partitions: int | None = None) -> DataFrame:
    """Adds the last non-null ``value`` of the earlier rows of the key (or up to the row itself)."""
    r = ranged(df, keys, order, partitions)
    w = Window.partitionBy("_part", *keys).orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if include_row else -1)
    local = r.withColumn("_loc", F.last(value, ignorenulls=True).over(frame))
    ends = r.groupBy("_part", *keys).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_v"), F.count(F.lit(1)).alias("_n")
    )
    several = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").drop("_c", "_n")
    cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    rows = sorted(ends.alias("a").join(several.alias("b"), cond, "left_semi").select("_part", "_v", *keys).collect(), key=lambda x: x["_part"])  # at most 2 keys a partition
    held: dict[tuple, object] = {}
    carried = []
    for x in rows:
        k = tuple(x[c] for c in keys)
        carried.append((x["_part"], *k, held.get(k)))
        if x["_v"] is not None:
            held[k] = x["_v"]
    schema = T.StructType(
        [T.StructField("_p", T.IntegerType())]
        + [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
        + [T.StructField("_carry", df.schema[value].dataType)]
    )
    c = df.sparkSession.createDataFrame(carried, schema)
    on = [local["_part"] == c["_p"]] + [local[k].eqNullSafe(c[f"_k{i}"]) for i, k in enumerate(keys)]
    return local.join(F.broadcast(c), on, "left").withColumn(out, F.coalesce("_loc", "_carry")).drop("_part", "_loc", "_p", "_carry", *[f"_k{i}" for i in range(len(keys))])


def cumulative_to_delta(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """What a cumulative counter grew by since the key's last reading, never below 0; NULL readings give NULL."""
    x = carry_last(df, keys, order, value, "_prev")
    return x.withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(F.expr(f"try_subtract({value}, coalesce(_prev, 0))"), F.lit(0)))).drop("_prev")


def numbered_turns(df: DataFrame, keys: Sequence[str], order: Sequence[str], is_prompt: str, turn: str = "turn_seq") -> DataFrame:
    """A new turn at each prompt; what comes before the first prompt is turn 0."""
    one = df.withColumn("_one", F.col(is_prompt).cast("bigint"))
    x = running_total(one, keys, order, "_one", "_before")
    return x.withColumn(turn, F.col("_before") + F.col("_one")).drop("_one", "_before")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """The row's number within its key, from 1."""
    x = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, "_one", "_before")
    return x.withColumn(out, F.col("_before") + 1).drop("_one", "_before")


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by partial aggregation instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def fifo_pairs(starts: DataFrame, ends: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The n-th start of a key with its n-th end; starts without end stay. Order columns of ends get the prefix end_."""
    a = positions(starts, keys, order, "nth")
    b = positions(ends.select(*keys, *order), keys, order, "nth").select(*keys, "nth", *[F.col(c).alias(f"end_{c}") for c in order])
    return a.join(b, [*keys, "nth"], "left")


def next_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """The next row's ``value`` within the key, as for a turn that the next one supersedes. ``order`` are numbers."""
    back = [f"_b{k}" for k in range(len(order))]
    x = df.withColumns({b: -F.col(c) for b, c in zip(back, order)})
    return carry_last(x, keys, back, value, out).drop(*back)


def last_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The given columns of each key's last row, by partial aggregation."""
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return g.select(*keys, *[F.col("_r")[c].alias(c) for c in columns])

"""Spark session, table access and the few physical helpers all operators share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_staged: list[tuple[SparkSession, str]] = []


def build_session(app: str = "loomspan", cpus: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session instead."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a temporary one only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomspan-")
        spark.sparkContext.setCheckpointDir(named)
        atexit.register(shutil.rmtree, named[7:], True)
    return named


def stage(df: DataFrame) -> DataFrame:
    """Cuts the lineage: writes ``df`` to the shared folder and reads it back.

    A written table outlives lost executors, keeps exact statistics for AQE and
    is columnar, so later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _staged:
        atexit.register(_drop_all)
    _staged.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def kept_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table that lives as long as the session."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_drop_all)
    _staged.append((spark, path))
    return path


def unstage(df: DataFrame) -> None:
    """Deletes the files of a staged table whose readers have ended."""
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        for entry in [e for e in _staged if e[1].rstrip("/").endswith(os.path.basename(f))]:
            _delete(*entry)
            _staged.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may already be gone
        if path.startswith("file:"):
            shutil.rmtree(path.split(":", 1)[1].replace("//", "", 1), ignore_errors=True)


def _drop_all() -> None:
    for entry in _staged:
        _delete(*entry)


def small_rows(df: DataFrame, limit: int, what: str) -> list:
    """All rows of a table that must be small to be sent around; one row too many is an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows


def spread(df: DataFrame) -> DataFrame:
    """Uses all cores where a table is stored in fewer splits than there are, which only a small one is.

    Rows and results stay the same; a table of many splits is passed through without a shuffle.
    Meant for plain scans: counting the splits behind a join would run the join.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def blank_to_null(c: Column) -> Column:
    """An empty string and NULL both mean "no value"."""
    return F.when(F.trim(c) != "", c)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, partitions: int | None = None
) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the earlier rows of the same ``keys``, in ``order``.

    No key is ever gathered in one task. Rows are range-partitioned on
    (keys, order), so a hot key spreads over many partitions; each partition
    sums its own groups, and only the groups that reach over a partition
    boundary, at most one open group per partition, send an offset through
    the driver (as many values as there are partitions). ``order`` must be a
    total order within the keys; NULL values count as 0.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [*keys, *order]
    ranged = df.repartitionByRange(n, *[F.col(c) for c in cols]).withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged)
    sums = ranged.groupBy("_part", *keys).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_s"))
    # groups within a single partition need no offset
    spread = sums.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if keys else None
    if keys:
        cond = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        over = sums.alias("a").join(spread.where("_n > 1").alias("b"), cond, "left_semi")
    else:
        over = sums
    rows = sorted(over.select("_part", "_s", *keys).collect(), key=lambda r: r["_part"])  # <= 2 groups a partition
    run: dict[tuple, object] = {}
    offsets = []
    for r in rows:
        k = tuple(r[x] for x in keys)
        offsets.append((r["_part"], *k, run.get(k, 0)))
        run[k] = run.get(k, 0) + r["_s"]
    vt = sums.schema["_s"].dataType
    schema = T.StructType(
        [T.StructField("_p", T.IntegerType())]
        + [T.StructField(f"_k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
        + [T.StructField("_off", vt)]
    )
    zero = 0.0 if isinstance(vt, T.DoubleType) else 0
    off = spark.createDataFrame([(*o[:-1], o[-1] + zero if o[-1] is not None else zero) for o in offsets], schema)
    w = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("_loc", F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(w), F.lit(zero)))
    cond = [local["_part"] == off["_p"]] + [local[k].eqNullSafe(off[f"_k{i}"]) for i, k in enumerate(keys)]
    return (
        local.join(F.broadcast(off), cond, "left")
        .withColumn(out, F.col("_loc") + F.coalesce(F.col("_off"), F.lit(zero)))
        .drop("_part", "_loc", "_p", "_off", *[f"_k{i}" for i in range(len(keys))])
    )

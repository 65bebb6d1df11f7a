"""Micro-batch ingestion: the event log, derived tables, rollups, progress and the change feed.

Batch and stream share the folds. A batch is written under its own id, so a
repeated batch replaces itself; derived rows are recomputed for the touched keys
only. The log is partitioned by the hash of the session, so a batch reads the hit partitions of it alone.
Late data of any age is accepted: it marks the bucket of its session's start, before and after the
change, which is recomputed; no watermark drops anything. An open bucket is never stored: it is written by the first
batch, or ``close_buckets``, after it has ended.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.operators import merge
from loomspan.operators.rollups import DAY_US, bucket
from loomspan.operators.stats import count_if
from loomspan.runtime import small_rows, stage, unstage

MAX_SUBSCRIPTIONS = 10_000
#: A batch closes after this time or at this many files, whichever is first.
TRIGGER, FILES = "500 milliseconds", 1000
#: Hash partitions of the log and of the sessions table.
PARTS = 64
#: Change-feed lines older than this are pruned; a source without events for as long is stale.
KEEP_US = STALE_US = 5 * 60 * 1_000_000
EVENT = "event_id bigint, kind string, payload string"


def read_events(spark: SparkSession, paths: list[str], schema: str = EVENT, files: int = FILES) -> DataFrame:
    """One stream over the event files of all sources, at most ``files`` of each in a batch."""
    one = lambda p: spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(p)
    return reduce(DataFrame.unionByName, [one(p) for p in paths])


def _part(source: Column, native: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(source, F.lit("")), F.coalesce(native, F.lit(""))), F.lit(parts)).cast("int")


def append(batch: DataFrame, batch_id: int, log: str) -> None:
    """Writes a batch under its id, by session; running it again gives the same files' content."""
    native = F.coalesce(merge.field("NativeID"), merge.field("SessionNativeID"))
    batch.withColumn("part", _part(merge.field("SourceID"), native)).write.mode("overwrite").partitionBy("part").parquet(f"{log}/batch={batch_id}")


def read_log(spark: SparkSession, log: str, parts: list[int] | None = None) -> DataFrame:
    """The event log, or only some of its partitions; the others are not read."""
    df = spark.read.schema(EVENT + ", part int, batch bigint").option("basePath", log).parquet(log)
    return df if parts is None else df.where(F.col("part").isin(*parts))


def touched(batch: DataFrame, keys: list[str]) -> DataFrame:
    return batch.select(*keys).distinct()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _overwrite(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``df`` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def refresh_sessions(spark: SparkSession, log: str, batch: DataFrame, out: str) -> DataFrame | None:
    """Recomputes the hash partitions of the sessions table that the batch touches; only those are read and overwritten.

    Returns the staged (bucket_ts) of the sessions it touched, as they were and as they are, or None if there are none.
    """
    keys = merge.session_events(batch).select("source_id", "native_id").distinct()
    hit = [r[0] for r in keys.select(_part(F.col("source_id"), F.col("native_id"))).distinct().collect()]  # at most PARTS
    if not hit:
        return None
    rows = merge.fold_sessions(merge.session_events(read_log(spark, log, hit))).withColumn("part", _part(F.col("source_id"), F.col("native_id")))
    rows = stage(rows)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("source_id", "native_id")]
    dirty = rows.alias("a").join(keys.alias("b"), same, "left_semi").select(bucket("start_ts", DAY_US).alias("bucket_ts"))
    if _exists(spark, out):
        before = spark.read.schema(rows.schema).parquet(out).where(F.col("part").isin(*hit))
        dirty = dirty.unionByName(before.alias("a").join(keys.alias("b"), same, "left_semi").select(bucket("start_ts", DAY_US).alias("bucket_ts")))
    dirty = stage(dirty.where("bucket_ts is not null").distinct())
    _overwrite(rows, out, "part")
    unstage(rows)
    return dirty


def fold_buckets(sessions: DataFrame) -> DataFrame:
    """bucket_ts, source_id, agent_name, session_starts, failures of sessions by the day of their start."""
    s = sessions.where("start_ts is not null").withColumn("bucket_ts", bucket("start_ts", DAY_US))
    return s.groupBy("bucket_ts", F.coalesce("source_id", F.lit("")).alias("source_id"), F.coalesce("agent_name", F.lit("")).alias("agent_name")).agg(
        F.count(F.lit(1)).alias("session_starts"), count_if(F.col("status") == "failed").alias("failures")
    )


_SESSIONS = "source_id string, start_ts bigint, agent_name string, status string, part int"
_BUCKETS = "source_id string, agent_name string, session_starts bigint, failures bigint, bucket_ts bigint"


def refresh_buckets(spark: SparkSession, sessions: str, out: str, dirty: DataFrame | None, now_us: int) -> None:
    """Recomputes the dirty buckets that are closed, and those that have closed unstored; one reading of the clock decides."""
    open_from = now_us - now_us % DAY_US
    s = spark.read.schema(_SESSIONS).parquet(sessions)
    due = s.select(bucket("start_ts", DAY_US).alias("bucket_ts")).where("bucket_ts is not null").distinct()
    if _exists(spark, out):
        due = due.join(spark.read.schema(_BUCKETS).parquet(out).select("bucket_ts").distinct(), "bucket_ts", "left_anti")
    if dirty is not None:
        due = due.unionByName(dirty).distinct()
    due = stage(due.where(F.col("bucket_ts") < open_from))
    fresh = fold_buckets(s).join(due, "bucket_ts", "left_semi")
    # a bucket that has lost its last session keeps an empty row, so that it is overwritten too
    gone = due.join(fresh.select("bucket_ts").distinct(), "bucket_ts", "left_anti").select("bucket_ts", F.lit("").alias("source_id"), F.lit("").alias("agent_name"), F.lit(0).cast("bigint").alias("session_starts"), F.lit(0).cast("bigint").alias("failures"))
    _overwrite(stage(fresh.unionByName(gone)), out, "bucket_ts")
    unstage(due)


def close_buckets(spark: SparkSession, tables: str, now_us: int) -> None:
    """Stores what has closed since the last batch, for a source that has become idle."""
    refresh_buckets(spark, f"{tables}/sessions", f"{tables}/rollup", None, now_us)


def rebuild(spark: SparkSession, log: str, tables: str, now_us: int) -> None:
    """Makes all derived tables anew from the log: after a backfill that deferred them, or to repair them."""
    s = merge.fold_sessions(merge.session_events(read_log(spark, log))).withColumn("part", _part(F.col("source_id"), F.col("native_id")))
    s.write.mode("overwrite").partitionBy("part").parquet(f"{tables}/sessions")
    stored = fold_buckets(spark.read.schema(_SESSIONS).parquet(f"{tables}/sessions"))
    stored.where(F.col("bucket_ts") < now_us - now_us % DAY_US).write.mode("overwrite").partitionBy("bucket_ts").parquet(f"{tables}/rollup")
    progress(read_log(spark, log)).write.mode("overwrite").parquet(f"{tables}/progress")


def links(spark: SparkSession, tables: str) -> DataFrame:
    """Sessions with their resolved parents and roots: what the resolver finds at any time, from the sessions table."""
    return merge.linked(spark.read.parquet(f"{tables}/sessions"))


def progress(events: DataFrame) -> DataFrame:
    """source_id, last_seq, last_ts, n_errors of each source."""
    return events.groupBy(merge.field("SourceID").alias("source_id")).agg(
        F.max("event_id").alias("last_seq"), F.max(merge.number("Ts")).alias("last_ts"), count_if(F.col("kind") == "source_error").alias("n_errors")
    )


def refresh_progress(spark: SparkSession, batch: DataFrame, out: str) -> DataFrame:
    """Merges a batch's progress: the greatest sequence number and time. A batch that is repeated counts its errors once only if it is the last one."""
    new = progress(batch)
    old = spark.read.parquet(out) if _exists(spark, out) else new.limit(0)
    # as many rows as there are sources
    merged = stage(old.unionByName(new).groupBy("source_id").agg(F.max("last_seq").alias("last_seq"), F.max("last_ts").alias("last_ts"), F.sum("n_errors").alias("n_errors")))
    merged.write.mode("overwrite").parquet(out)
    return merged


def lifecycle(progress: DataFrame, sources: DataFrame, now_us: int, stale_us: int = STALE_US) -> DataFrame:
    """source_id, state: disabled, waiting (nothing seen yet), failing (errors), stale (nothing seen for long) or live."""
    s = sources.select(F.col("id").alias("_id"), "enabled")
    j = s.join(progress, s["_id"] == progress["source_id"], "left")
    state = (
        F.when(F.col("enabled") == 0, "disabled").when(F.col("last_seq").isNull(), "waiting").when(F.col("n_errors") > 0, "failing")
        .when(F.lit(now_us) - F.coalesce("last_ts", F.lit(0)) > stale_us, "stale").otherwise("live")
    )
    return j.select(F.col("_id").alias("source_id"), state.alias("state"))


def state_changes(before: DataFrame, after: DataFrame, ts_us: int, batch_id: int) -> DataFrame:
    """Feed lines of sources whose state is another one now."""
    b = before.select(F.col("source_id").alias("_s"), F.col("state").alias("_was"))
    x = after.join(b, after["source_id"] == b["_s"], "left").where("_was is null or _was <> state")
    return x.select("source_id", F.lit(None).cast("string").alias("native_id"), F.lit(ts_us).alias("ts_us"), F.lit("source_status_changed").alias("kind"), F.lit(batch_id).alias("batch_id"))


def notifications(batch: DataFrame, batch_id: int) -> DataFrame:
    """The change feed of a batch: sessions that changed, and one line for the statistics of each source."""
    ev = merge.session_events(batch)
    a = ev.select("source_id", "native_id", "ts").groupBy("source_id", "native_id").agg(F.max("ts").alias("ts_us")).withColumn("kind", F.lit("session_changed"))
    s = ev.groupBy("source_id").agg(F.max("ts").alias("ts_us")).select("source_id", F.lit(None).cast("string").alias("native_id"), "ts_us", F.lit("stats_invalidated").alias("kind"))
    return a.unionByName(s).withColumn("batch_id", F.lit(batch_id))


def prune(spark: SparkSession, feed: str, now_us: int, keep_us: int = KEEP_US) -> list[str]:
    """Deletes the feed's partitions that were written before ``keep_us`` ago; returns their paths."""
    if not _exists(spark, feed):
        return []
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(feed)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [x.getPath() for x in fs.listStatus(p) if x.isDirectory() and x.getPath().getName().startswith("written=") and int(x.getPath().getName()[8:]) < now_us - keep_us]
    for x in old:
        fs.delete(x, True)
    return [x.toString() for x in old]


def matching(feed: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Feed lines for each subscriber; a NULL in a subscription matches everything."""
    small = subscriptions.sparkSession.createDataFrame(small_rows(subscriptions, MAX_SUBSCRIPTIONS, "subscriptions"), subscriptions.schema)
    f, s = feed.alias("f"), small.alias("s")
    return f.join(
        F.broadcast(s),  # at most MAX_SUBSCRIPTIONS rows
        F.coalesce(F.col("s.source_id") == F.col("f.source_id"), F.lit(True)) & F.coalesce(F.col("s.kind") == F.col("f.kind"), F.lit(True)),
    ).select("s.subscriber", "f.kind", "f.source_id", "f.native_id", "f.ts_us")


def coalesced(matches: DataFrame, every_us: int = 1_000_000) -> DataFrame:
    """At most one line per subscriber, kind and source in a second."""
    return matches.groupBy("subscriber", "kind", "source_id", bucket("ts_us", every_us).alias("second")).agg(F.max("ts_us").alias("ts_us"), F.count(F.lit(1)).alias("n"))


def step(spark: SparkSession, batch: DataFrame, batch_id: int, log: str, tables: str, now_us: int, sources: DataFrame | None = None) -> None:
    """All that one batch does: log, sessions, buckets, progress, states and feed. Running it again changes nothing."""
    append(batch, batch_id, log)
    kept = spark.read.schema(EVENT + ", part int").parquet(f"{log}/batch={batch_id}")
    dirty = refresh_sessions(spark, log, kept, f"{tables}/sessions")
    if dirty is not None:
        refresh_buckets(spark, f"{tables}/sessions", f"{tables}/rollup", dirty, now_us)
        unstage(dirty)
    feed = notifications(kept, batch_id)
    p = refresh_progress(spark, kept, f"{tables}/progress")
    if sources is not None:
        path = f"{tables}/states"
        now = stage(lifecycle(p, sources, now_us))
        before = stage(spark.read.parquet(path)) if _exists(spark, path) else now.limit(0)
        feed = feed.unionByName(state_changes(before, now, now_us, batch_id))
        now.write.mode("overwrite").parquet(path)
    feed.write.mode("overwrite").parquet(f"{tables}/notify/written={now_us - now_us % 60_000_000}/batch={batch_id}")
    prune(spark, f"{tables}/notify", now_us)


def start(stream: DataFrame, log: str, tables: str, checkpoint: str, once: bool = False, sources: DataFrame | None = None, clock=None) -> StreamingQuery:
    """Runs the ingestion, exactly once in effect: a batch that is repeated replaces what it wrote."""
    import time

    now = clock or (lambda: int(time.time() * 1_000_000))
    w = stream.writeStream.foreachBatch(lambda batch, i: step(batch.sparkSession, batch, i, log, tables, now(), sources)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=TRIGGER)).start()


def event_windows(stream: DataFrame, ts: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Windowed counts of a stream with a watermark, for callers who prefer bounded state over late data."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select("w.start", "event_type", "n")

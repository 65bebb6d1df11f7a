"""Two-sided completeness checks between source artifacts and derived ones.

Artifacts are rows (key, cls, availability, sha256, bytes): both sides are grouped by key hash once
and joined fully outer; leftovers of a key's classes are matched without class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("availability", "hash_domain", "sha256", "bytes", "chars", "selector")
# Which availabilities each class may have; other classes are not restricted.
ALLOWED = {"payload": ("present", "truncated", "redacted"), "log": ("present",)}


def _side(a: DataFrame, p: str) -> DataFrame:
    have = lambda f: F.col(f) if f in a.columns else F.lit(None).cast("string")
    extra = [F.max(F.coalesce(have("synthetic").cast("boolean"), F.lit(False))).alias(f"{p}_synthetic"), F.max(F.coalesce(have("reason") != "", F.lit(False))).alias(f"{p}_documented")]
    return a.groupBy("key", "cls").agg(F.count(F.lit(1)).alias(f"{p}_n"), *[F.min(have(f)).alias(f"{p}_{f}") for f in FIELDS], *extra)


def findings(source: DataFrame, derived: DataFrame) -> DataFrame:
    """key, cls, code, field of everything that is not as it should be.

    In this order, one rule a key and class: a corrupt source artifact; duplicates on either side; differing fields of a
    pair, unless the derived one says it can't be verified; then what matches without class, missing and extra ones. A synthetic
    derived artifact is no finding if its reason is documented. ``chars`` count only where the source has them.
    """
    j = _side(source, "s").join(_side(derived, "d"), ["key", "cls"], "full_outer")
    corrupt = F.coalesce(F.col("s_availability") == "corrupt", F.lit(False))
    many = F.coalesce(F.col("s_n") > 1, F.lit(False)) | F.coalesce(F.col("d_n") > 1, F.lit(False))
    bad = j.where(corrupt).select("key", "cls", F.lit("corrupt").alias("code"), F.lit("source").alias("field"))
    dup = j.where(~corrupt & many).select("key", "cls", F.lit("duplicate").alias("code"), F.when(F.col("d_n") > 1, "derived").otherwise("source").alias("field"))
    both = j.where(~corrupt & ~many & F.col("s_n").isNotNull() & F.col("d_n").isNotNull())
    vague = F.coalesce(F.col("d_availability") == "unverifiable", F.lit(False))
    unsure = both.where(vague).select("key", "cls", F.lit("unverifiable").alias("code"), F.lit("availability").alias("field"))
    counts = lambda f: F.col("s_chars").isNotNull() if f == "chars" else F.lit(True)
    diff = both.where(~vague).select(
        "key",
        "cls",
        F.explode(F.array_compact(F.array(*[F.when(counts(f) & ~F.col(f"s_{f}").eqNullSafe(F.col(f"d_{f}")), F.lit(f)) for f in FIELDS]))).alias("field"),
    ).select("key", "cls", F.lit("differs").alias("code"), "field")
    left = j.where(F.col("d_n").isNull() & ~corrupt).select("key", F.col("cls").alias("s_cls"))
    right = j.where("s_n is null").select("key", F.col("cls").alias("d_cls"), "d_synthetic", "d_documented")
    # what matches without class is one finding, the rest is missing or extra
    m = left.groupBy("key").agg(F.min("s_cls").alias("s_cls"), F.count(F.lit(1)).alias("ns")).join(
        right.groupBy("key").agg(F.min("d_cls").alias("d_cls"), F.count(F.lit(1)).alias("nd"), F.min("d_synthetic").alias("made"), F.min("d_documented").alias("said")), "key", "full_outer"
    )
    alone = F.col("ns").isNull()
    rest = m.where(~(alone & F.col("made") & F.col("said"))).select(
        "key",
        F.coalesce("s_cls", "d_cls").alias("cls"),
        F.when(alone & F.col("made"), "undocumented synthetic").when(alone, "extra").when(F.col("nd").isNull(), "missing").otherwise("class mismatch").alias("code"),
        F.coalesce("d_cls", F.lit("")).alias("field"),
    )
    return bad.unionByName(dup).unionByName(unsure).unionByName(diff).unionByName(rest)


def artifacts(ev: DataFrame) -> DataFrame:
    """Artifacts of canonical events: key, cls, availability, hash_domain, sha256, bytes, chars, selector of sessions, operations, payloads and logs."""
    key = lambda *c: F.concat_ws("\x1f", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("source_id", "session", *c)])
    none = F.lit(None)
    shape = lambda df, cls, k, sha=none, n=none, chars=none, sel=none: df.select(
        k.alias("key"), F.lit(cls).alias("cls"), F.lit("present").alias("availability"), F.when(sha.isNotNull(), "stored").alias("hash_domain"), sha.cast("string").alias("sha256"), n.cast("bigint").alias("bytes"),
        chars.cast("bigint").alias("chars"), sel.cast("string").alias("selector"),
    ).dropDuplicates(["key", "cls"])
    c = F.col
    out = shape(ev.where("kind = 'session_started'"), "session", key())
    out = out.unionByName(shape(ev.where("kind = 'op_started'"), "op", key("turn_seq", "op_seq")))
    refs = ev.where("kind = 'payload_ref'")
    out = out.unionByName(shape(refs, "payload", key("turn_seq", "op_seq", "payload_kind", "location"), c("sha256"), c("bytes_in"), none, c("location")))
    logs = ev.where("kind = 'log_entry'")
    return out.unionByName(shape(logs, "log", key("turn_seq", "op_seq", "ts", "severity", "message"), F.sha2("message", 256), F.octet_length("message"), F.length("message")))


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("code", "cls", "field").agg(F.count(F.lit(1)).alias("n"))


def disallowed(artifacts: DataFrame) -> DataFrame:
    """Artifacts whose availability their class does not know."""
    bad = F.lit(False)
    for cls, ok in ALLOWED.items():
        bad = bad | ((F.col("cls") == cls) & ~F.coalesce(F.col("availability").isin(*ok), F.lit(False)))
    return artifacts.where(bad)


def sample(found: DataFrame, n: int) -> DataFrame:
    """The first n findings in order: a bounded report."""
    return found.orderBy("code", "key", "cls", "field").limit(n)


def fingerprints(files: DataFrame) -> DataFrame:
    """path, bytes, sha256 of binaryFile rows: a frozen view of the source."""
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def changed_since(files: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new or have another fingerprint."""
    return files.join(before.select("path", F.col("sha256").alias("_old")), "path", "left").where("_old is null or _old <> sha256").drop("_old")

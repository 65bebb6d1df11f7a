"""The canonical event form: one wide row per event, nullable fields of all variants."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

_S, _L, _D, _I, _B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()

#: Arrival order is (file, rec, sub); every event has kind, source_id, ts and session.
EVENT = T.StructType(
    [
        T.StructField(n, t)
        for n, t in (
            ("kind", _S), ("source_id", _S), ("file", _S), ("rec", _L), ("sub", _I), ("ts", _L), ("session", _S),
            ("root", _S), ("parent", _S), ("parent_op", _S), ("session_kind", _S), ("agent", _S), ("model", _S), ("provider", _S),
            ("cwd", _S), ("call_path", _S), ("turn_seq", _L), ("op_seq", _L), ("parent_op_seq", _L), ("op_kind", _S), ("name", _S),
            ("namespace", _S), ("child_session", _S), ("status", _S), ("error_class", _S), ("error_message", _S), ("end_ts", _L),
            ("tokens_in", _L), ("tokens_out", _L), ("tokens_cache_read", _L), ("tokens_cache_write", _L), ("cost_usd", _D), ("ctx_used", _L),
            ("bytes_in", _L), ("bytes_out", _L), ("payload_kind", _S), ("format", _S), ("location", _S), ("sha256", _S),
            ("severity", _S), ("message", _S), ("extras", _S),
        )
    ]
)
COLUMNS = EVENT.fieldNames()
KINDS = (
    "session_started", "session_updated", "session_finalized", "turn_started", "turn_finalized", "op_started",
    "op_finalized", "payload_ref", "log_entry", "source_progress", "source_error",
)

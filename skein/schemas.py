"""Schemas of the tables that the readers expect."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _I, _S, _D, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampType()


def _of(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


EDGES = _of(source=_L, target=_L, connection_type=_S, strength=_D, auto_detected=T.BooleanType(), discovered_at=_TS)
RAW_CHUNKS = _of(text=_S, start_index=_I, end_index=_I, token_count=_I, chunker_type=_S)
MATCHES = _of(start_offset=_I, end_offset=_I, confidence=_D, method=_S)
JOBS = _of(job_id=_L, status=_S, created_at=_TS, retry_count=_I, next_retry_at=_TS, last_error=_S)
REVIEWS = _of(card_id=_L, reviewed_at=_TS, rating=_I)
SCHEDULE = _of(card_id=_L, reps=_I, lapses=_I, stability=_D, difficulty=_D, last_review=_TS, next_review=_TS, state=_S)

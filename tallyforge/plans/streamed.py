"""Streaming queries over events, each equal to its batch SQL once the stream has ended."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..streaming import streams as S


def _run(t, rows, mode):
    return S.drained(rows, "s" + uuid.uuid4().hex, mode)


QUERIES = [
    ("z20_stream_daily_counts", lambda t: _run(t, S.windowed_counts(S.event_stream(t.spark, t.dir), "ts", ["event_type"], "1 day"), "complete").select(F.col("start").cast("date").alias("day"), "event_type", "n"), "select cast(ts as date) as day, event_type, count(*) n from events group by all"),
    ("z20_stream_first_users", lambda t: _run(t, S.first_seen(S.event_stream(t.spark, t.dir), "ts", ["user_id"], "60 days"), "append").select("user_id"), "select distinct user_id from events"),
]

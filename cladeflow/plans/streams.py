"""Queries that run as Structured Streaming jobs over the events and the alignment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cladeflow.plans.dynamics import _TRIAGE, screening_model
from cladeflow.session import shared_dir, table
from cladeflow.streaming import screen as ss


def _stream(s, d, name):
    return s.readStream.schema(table(s, d, name).schema).parquet(f"{d}/{name}.parque[t]")


def _at(s):
    return f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"


def stream_event_windows(s, d):
    """Six-hour windows by type, from the stream."""
    w = ss.windowed_counts(_stream(s, d, "events"), "ts", "event_type", "6 hours", "1 day")
    out = ss.run_to_table(w, _at(s), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_triage(s, d):
    """Every taxon screened as it arrives, the clock calibrated beforehand."""
    x, m, anchors = screening_model(s, d)
    x = x.select("taxon", "date", "seq", "d")
    path = f"{_at(s)}-in"
    x.write.parquet(path)
    stream = s.readStream.schema(x.schema).parquet(path)
    out = ss.run_to_table(ss.screen(stream, m, anchors, "taxon", "d", "date", "seq"), _at(s))
    return out.select("taxon", "status", (F.round("z", 4) + 0.0).alias("z"))


def stream_sessions(s, d):
    """Sessions of a user: events less than four hours apart."""
    w = ss.sessions(_stream(s, d, "events").select("ts", "user_id"), "ts", "user_id", "4 hours", "1 day")
    out = ss.run_to_table(w, _at(s), "complete")
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


QUERIES = {f.__name__: f for f in (stream_event_windows, stream_triage, stream_sessions)}
ORACLE = {
    "stream_event_windows": "select strftime(time_bucket(interval 6 hours, ts, timestamp '2024-01-01'), '%Y-%m-%d %H:%M:%S') \"start\", event_type, count(*) n, round(sum(value), 4) total from events group by all",
    "stream_triage": _TRIAGE.format("round(z, 4) + 0e0 z"),
    "stream_sessions": "with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 4 hours then 0 else 1 end f from events), s as (select *, sum(f) over (partition by user_id order by ts rows unbounded preceding) k from e) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') \"start\", count(*) n from s group by user_id, k",
}

"""Queries that run a stream over the events table to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..storage import folder
from .frames import Family, Frames

family = Family()
add = family.add


def _stream(f: Frames):
    raw = streaming.events(f.spark, f"{f.dir}/events.parquet*", f.table("events").schema)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def done(stream, label: str, mode: str = "append", keep: list[str] | None = None):
    """What the drained stream wrote, with times as the input has them."""
    out = streaming.drained(stream, label, mode, keep)
    return out.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else c for c, t in out.dtypes])


_O = "(PARTITION BY user_id ORDER BY ts, event_id)"
add("k02_dedupe_once", lambda f: done(streaming.once_ever(_stream(f).select("user_id", "event_type"), ["user_id", "event_type"]), "dedupe"), "SELECT DISTINCT user_id, event_type FROM events")
add("k02_dedupe_watermark", lambda f: done(streaming.once_within(_stream(f), ["event_id"], "ts", "2 days").select("event_id"), "dedupe-late"), "SELECT event_id FROM events")
add("k03_late_release", lambda f: done(streaming.late_release(_stream(f).select("user_id", "ts", (F.col("event_type") == "purchase").alias("ready")), "user_id", "ts", "ready", 86_400), "release"), "SELECT user_id, first_at, coalesce(bought, first_at + INTERVAL 1 DAY) AS released_at, CASE WHEN bought IS NOT NULL THEN 'ready' ELSE 'timeout' END AS reason FROM (SELECT user_id, first_at, min(ts) FILTER (WHERE event_type = 'purchase' AND ts < first_at + INTERVAL 1 DAY) AS bought FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS first_at FROM events) GROUP BY user_id, first_at) WHERE bought IS NOT NULL OR first_at + INTERVAL 1 DAY < (SELECT max(ts) FROM events)")
add("k04_stream_drops", lambda f: done(streaming.drops(_stream(f), "user_id", ["ts", "event_id"], "value", 50.0), "drops").select("user_id", "event_id", "value", "before"), f"SELECT user_id, event_id, value, before FROM (SELECT *, lag(value) OVER {_O} AS before FROM events) WHERE round((before - value) / before * 100, 4) >= 50")
add("k06_stream_changes", lambda f: done(streaming.changes(_stream(f), "user_id", ["ts", "event_id"], "event_type"), "changes").select("user_id", "event_id", "event_type"), f"SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER {_O} AS p FROM events) WHERE p IS DISTINCT FROM event_type")
add("k11_tumbling_windows", lambda f: done(streaming.tumbling(_stream(f), "ts", "1 day", ["event_type"], "0 seconds"), "windows", "update", ["window_start", "event_type"]), "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
add("k11_sliding_windows", lambda f: done(streaming.tumbling(_stream(f), "ts", "7 days", [], "0 seconds", "1 day"), "sliding", "update", ["window_start"]), "SELECT w AS window_start, count(*) AS n, round(sum(value), 2) AS total FROM events, (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS w) WHERE ts >= w AND ts < w + INTERVAL 7 DAY GROUP BY w")


def _dirty(f: Frames):
    """The recomputed aggregates of the keys that the stream touched."""
    target, offsets = folder(f.spark, "dirty"), folder(f.spark, "dirty-offsets")
    full = lambda df: df.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    streaming.recompute_dirty(_stream(f).where("event_type = 'purchase'"), "user_id", full, f.table("events"), target, offsets)
    return streaming.newest_versions(f.spark, target, "user_id")


add("k07_k08_dirty_recompute", _dirty, "SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY user_id")

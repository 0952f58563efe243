"""Streaming queries over the event table, compared with their batch result in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topolake.sources.batches import Target, append_stream
from topolake.sources.storage import shared_dir
from topolake.streaming import events as E

Q: dict = {}
SQL: dict[str, str] = {}


def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"windows_{uuid.uuid4().hex}"
    return E.run_once(E.windowed(E.read(spark, sf_dir)), name).select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


Q["stream_windowed_counts"] = stream_windowed_counts
SQL["stream_windowed_counts"] = "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL"


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = E.run_written(E.sessions(E.read(spark, sf_dir)), "sessions")
    return got.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))


Q["stream_sessions"] = stream_sessions
SQL["stream_sessions"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)
SELECT user_id, CAST(sum(new) AS BIGINT) AS n_sessions, CAST(count(*) AS BIGINT) AS n_events FROM g GROUP BY 1"""


def stream_committed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream appended batch by batch, twice over: what the log has is not written again."""
    target = Target(spark, f"{shared_dir(spark)}/events-{uuid.uuid4().hex}")
    events = E.read(spark, sf_dir)
    for _ in range(2):
        append_stream(events, target)
    return target.read(events.schema).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


Q["stream_committed_events"] = stream_committed_events
SQL["stream_committed_events"] = "SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL"

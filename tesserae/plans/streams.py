"""Streams drained over the stored tables; each query gives the final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.plans.store import _F, _NEW, _newest
from tesserae.session import table
from tesserae.streaming import windows
from tesserae.streaming.ingest import VersionedTable, drain, ended, file_stream, shared_folder


def _stream(spark: SparkSession, base: str, name: str) -> DataFrame:
    return file_stream(spark, f"{base}/{name}.parque[t]", table(spark, base, name).schema)


def stream_ingest_update(spark: SparkSession, base: str) -> DataFrame:
    """The file register after a stream of all scans: the latest row of each path."""
    folder = shared_folder(spark, "files")
    s = _stream(spark, base, "files").select("path", "size", "mtime", "paper_id", "loaded_at")
    t = VersionedTable(spark, f"{folder}/table", s.schema)
    drain(s, t.upsert_batch(["path"], *_newest()), f"{folder}/checkpoint")
    return t.read()


def _windowed(spark: SparkSession, base: str, name: str, shape) -> DataFrame:
    """Windows in append mode: each is written once, when the watermark has passed it, and its state is dropped."""
    folder = shared_folder(spark, name)
    s = shape(ended(_stream(spark, base, "events"), "ts", folder))
    t = VersionedTable(spark, f"{folder}/table", s.schema)
    drain(s, t.append_batch(), f"{folder}/checkpoint")
    return t.read()


def stream_tumbling(spark: SparkSession, base: str) -> DataFrame:
    return _windowed(spark, base, "tumbling", windows.tumbling).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def stream_sliding(spark: SparkSession, base: str) -> DataFrame:
    return _windowed(spark, base, "sliding", windows.sliding).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def stream_sessions(spark: SparkSession, base: str) -> DataFrame:
    return _windowed(spark, base, "sessions", windows.sessions).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "finish")})


QUERIES = {f.__name__: f for f in (stream_ingest_update, stream_tumbling, stream_sliding, stream_sessions)}
ORACLE = {
    "stream_ingest_update": f"SELECT {_F} FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY {_NEW}) = 1",
    "stream_tumbling": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL",
    "stream_sliding": "SELECT strftime(d, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS d FROM events) GROUP BY ALL",
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS gap FROM events),
s AS (SELECT user_id, ts, sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS finish, count(*) AS n FROM s GROUP BY user_id, k""",
}

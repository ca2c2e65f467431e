"""Streams over events, run for what is there; their SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming import events as st

NTZ = "timestamp_ntz"


def _times(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(NTZ) for c, t in df.dtypes if t == "timestamp"})


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    x = st.windowed(st.stream_of(spark, d, "events"), "ts", "event_type", "value", "1 day")
    return _times(st.run(x, "complete")).withColumn("total", F.round("total", 4))


DAILY_SQL = "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) + INTERVAL 1 DAY AS TIMESTAMP) AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def stream_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Windows of eight days that slide by one: the last seven days, both ends in."""
    x = st.windowed(st.stream_of(spark, d, "events"), "ts", "event_type", "value", "8 days", "1 day")
    return _times(st.run(x, "complete")).withColumn("total", F.round("total", 4))


TRAILING_SQL = """SELECT CAST(date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS TIMESTAMP) AS start, CAST(date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) + INTERVAL 8 DAYS AS TIMESTAMP) AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events, (SELECT unnest(range(8)) AS k) GROUP BY ALL"""


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    x = st.sessions(st.stream_of(spark, d, "events"), "ts", "user_id", "2 hours")
    return _times(st.run(x, "complete"))


SESSIONS_SQL = """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k"""


def stream_first(spark: SparkSession, d: str) -> DataFrame:
    """Which (user, kind) pairs occurred: repeats are dropped while the watermark holds their state."""
    x = st.first_of(st.stream_of(spark, d, "events"), "ts", ["user_id", "event_type"], "60 days")
    return st.run(x.select("user_id", "event_type"))


FIRST_SQL = "SELECT DISTINCT user_id, event_type FROM events"


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """When a kind of event's last five values average above 150, at most once a day."""
    return _times(st.run(st.alerts(st.stream_of(spark, d, "events"), "event_type", "ts", "value", above=150.0)))


QUERIES = {"stream_daily": stream_daily, "stream_trailing": stream_trailing, "stream_sessions": stream_sessions, "stream_first": stream_first, "stream_alerts": stream_alerts}
ORACLE = {"stream_daily": DAILY_SQL, "stream_trailing": TRAILING_SQL, "stream_sessions": SESSIONS_SQL, "stream_first": FIRST_SQL}

"""Windows over events, as batch queries over the same functions that run on streams."""

from pyspark.sql import functions as F

from ..streaming import windows as W
from .registry import cents, query


@query("""SELECT strftime(time_bucket(INTERVAL 1 day, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY ALL""")
def stream_tumbling(t):
    out = W.windowed(t.events, "ts", "1 day", None, "1 hour", ["event_type"], {"n": F.count("*"), "total": F.sum(cents("value"))})
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.col("total").cast("double").alias("total"))


@query("""SELECT strftime(s, '%Y-%m-%d %H') AS hour, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 6 hour, ts), time_bucket(INTERVAL 6 hour, ts) - INTERVAL 6 hour]) AS s FROM events) GROUP BY 1""")
def stream_sliding(t):
    out = W.windowed(t.events, "ts", "12 hours", "6 hours", "1 hour", [], {"n": F.count("*")})
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 hour THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(t):
    out = W.sessions(t.events, "ts", "2 hours", "1 hour", ["user_id"], {"n": F.count("*")})
    return out.select("user_id", F.unix_micros(F.col("start").cast("timestamp")).alias("start_us"), "n")

"""Registered queries for the streaming extension."""

from __future__ import annotations


from ..sources import fixtures as X
from ..streaming import stream as ST
from .registry import register

W = X.with_views


@register("stream_price_locf", W("nego") + """
SELECT conv_id, event_id, speaker, price,
       last_value(price IGNORE NULLS) OVER (PARTITION BY conv_id, speaker ORDER BY turn_no
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price_filled
FROM nego""")
def q_stream_price_locf(spark, sf_dir):
    return ST.run_available_now(ST.stream_price_locf(ST.event_stream(spark, sf_dir)), "stream_locf")


@register("stream_window_stats", """
SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, avg(value) AS mean_value
FROM events GROUP BY 1, 2""")
def q_stream_window_stats(spark, sf_dir):
    return ST.run_to_end(ST.event_stream(spark, sf_dir), ST.stream_window_stats, "stream_window")


SESSIONS = """
WITH e AS (SELECT user_id AS conv_id, ts, event_id, value, CAST(event_id % 2 AS INTEGER) AS speaker,
                  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(CAST(500.0 + value * 10.0 AS DECIMAL(12,2))) AS BIGINT) END AS price FROM events)
, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS brk
        FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY ts, event_id))
, s AS (SELECT *, sum(brk) OVER (PARTITION BY conv_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g)"""


@register("stream_final_outcome", SESSIONS + """
, a AS (SELECT conv_id, sid, min(ts) AS session_start, count(*) AS n,
               arg_max_null(speaker, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS last_speaker,
               arg_max_null(price, CAST(epoch_us(ts) AS HUGEINT) * 1000000 + event_id) AS final_price
        FROM s GROUP BY conv_id, sid)
SELECT conv_id, session_start, n, CASE WHEN last_speaker = 0 THEN 'Reject' ELSE 'Accept' END AS outcome, final_price FROM a""")
def q_stream_final_outcome(spark, sf_dir):
    """Every session of every conversation, the last ones included."""
    return ST.run_to_end(ST.event_stream(spark, sf_dir), ST.stream_final_outcome, "stream_outcome")


@register("stream_mean_reward", SESSIONS + """
SELECT conv_id, min(ts) AS session_start, count(*) AS n, avg(value) AS mean_reward FROM s GROUP BY conv_id, sid""")
def q_stream_mean_reward(spark, sf_dir):
    return ST.run_to_end(ST.event_stream(spark, sf_dir), ST.stream_mean_reward, "stream_reward")

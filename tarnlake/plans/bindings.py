"""The test tables as plays, frames and episodes, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.core.session import table

#: An event is a play: level from its day, steps from its value, the outcome from its type.
EV = """ev AS (
  SELECT user_id, event_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
    CAST(floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3.0) AS INTEGER) AS level,
    CAST(1 + floor(value / 10) AS BIGINT) AS steps,
    CASE event_type WHEN 'purchase' THEN 'win' WHEN 'error' THEN 'loss' ELSE 'incomplete' END AS outcome,
    epoch_us(ts) / 1e6 AS sec
  FROM events)"""

EPISODES = EV + """, ep AS (
  SELECT user_id, level, list(steps ORDER BY ts, event_id) AS s, list(outcome ORDER BY ts, event_id) AS o
  FROM ev GROUP BY ALL),
epx AS (
  SELECT user_id, level, i, s[i] AS steps, o[i] AS outcome, list_position(o, 'win') AS fw, len(s) AS n
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM ep))"""


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 3.0).cast("int")
    outcome = F.when(F.col("event_type") == "purchase", "win").when(F.col("event_type") == "error", "loss").otherwise("incomplete")
    return e.select(
        "user_id", "event_id", "ts", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"), level.alias("level"),
        (1 + F.floor(F.col("value") / 10)).cast("long").alias("steps"), outcome.alias("outcome"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("sec"),
    )


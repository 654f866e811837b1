"""Queries over ordered events and turns: deltas, windows, guards, buckets, sessions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import guards
from .registry import query


@query("step_deltas", "SELECT event_id, CAST(date_diff('millisecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS BIGINT) AS ms FROM events")
def step_deltas(t, spark):
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.floor(ms / 1000)
    return t("events").select("event_id", (at - F.lag(at).over(w)).alias("ms"))


@query("phase_rollup", "SELECT user_id, round(sum(value) FILTER (WHERE event_type = 'click'), 4) AS click, round(sum(value) FILTER (WHERE event_type = 'view'), 4) AS view_, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY 1")
def phase_rollup(t, spark):
    of = lambda k: F.round(F.sum(F.when(F.col("event_type") == k, F.col("value"))), 4)
    return t("events").groupBy("user_id").agg(of("click").alias("click"), of("view").alias("view_"), F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query("change_only", "WITH l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, event_type FROM l WHERE event_type IS DISTINCT FROM before")
def change_only(t, spark):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("before", before).where(~F.col("event_type").eqNullSafe(F.col("before"))).select("event_id", "user_id", "event_type")


@query("repeat_tool_window", "SELECT event_id, count(*) FILTER (WHERE TRUE) OVER w AS seen, CAST((CASE WHEN lag(event_type, 1) OVER o = event_type THEN 1 ELSE 0 END) + (CASE WHEN lag(event_type, 2) OVER o = event_type THEN 1 ELSE 0 END) + (CASE WHEN lag(event_type, 3) OVER o = event_type THEN 1 ELSE 0 END) AS INT) AS repeats FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def repeat_tool_window(t, spark):
    """How often each of the last three steps was of the same kind."""
    o = Window.partitionBy("user_id").orderBy("ts", "event_id")
    same = lambda k: F.when(F.lag("event_type", k).over(o) == F.col("event_type"), 1).otherwise(0)
    return t("events").select("event_id", F.count(F.lit(1)).over(o.rowsBetween(-3, -1)).alias("seen"), (same(1) + same(2) + same(3)).alias("repeats"))


@query("session_windows", "WITH l AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM l) SELECT user_id, CAST(sid AS BIGINT) AS sid, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1, 2")
def session_windows(t, spark):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) <= 7_200_000_000, 0).otherwise(1)
    return t("events").withColumn("b", gap).withColumn("sid", F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("user_id", "sid").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("tumbling_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(t, spark):
    return t("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("recent_episodes", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def recent_episodes(t, spark):
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id", "event_type")


@query("first_last_turn", "SELECT conv_id, count(*) AS n, arg_min(md5(text), turn) AS first_turn, arg_max(md5(text), turn) AS last_turn FROM conversations GROUP BY 1")
def first_last_turn(t, spark):
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.md5("text"), "turn").alias("first_turn"), F.max_by(F.md5("text"), "turn").alias("last_turn"))


@query("loop_guard")
def loop_guard(t, spark):
    return guards.loop_guard(t("events"))


@query("token_bucket")
def token_bucket(t, spark):
    return guards.token_bucket(t("events"), rate=1 / 3600, capacity=5)

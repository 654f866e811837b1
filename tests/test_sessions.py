"""Sessions and guards: the batch against SQL and plain Python, the streams against the batch across restarts."""

import math
import time

import pytest
from pyspark.sql import functions as F

from tessera.plans.registry import QUERIES
from tessera.streaming import sessions as S

SF = "/root/testdata/sf0.001"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def run_to_end(df, out, checkpoint):
    df.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def in_files(df, folder, cuts):
    """The rows of df as a function that adds the k-th file to a folder."""
    return lambda k: df.where(cuts[k]).coalesce(1).write.mode("append").parquet(folder)


def test_session_stream_equals_the_batch_across_restarts(rocks, tmp_path):
    events = rocks.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    q = events.agg(F.percentile_approx(F.unix_micros("ts"), [0.3, 0.7], 10_000)).first()[0]
    us = F.unix_micros("ts")
    add = in_files(events, str(tmp_path / "in"), [us < q[0], (us >= q[0]) & (us < q[1]), us >= q[1]])
    for k in range(4):  # each run is a restart from the checkpoint
        if k < 3:
            add(k)
        else:  # a step of another user, much later, lets all that is due come
            rocks.sql("SELECT -1L AS event_id, TIMESTAMP '2031-01-01' AS ts, -1L AS user_id").write.mode("append").parquet(str(tmp_path / "in"))
        stream = rocks.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        run_to_end(S.session_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted(map(tuple, rocks.read.parquet(str(tmp_path / "out")).where("user_id >= 0").select("user_id", "kind", "us", "event_id").collect()))
    want = sorted(map(tuple, S.session_rows(events).select("user_id", "kind", "us", "event_id").collect()))
    assert got == want and {r[1] for r in got} == {"step", "ping", "done"}


def test_sessions_of_ties_and_nulls(spark):
    beat, gap = 10, 30
    at = [(1, 0), (1, 0), (1, 10), (1, 40), (1, 71), (2, 5), (None, 5), (3, None)]
    rows = [(k, u, s) for k, (u, s) in enumerate(at)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_micros("s").alias("ts"))
    got = sorted(((r.user_id, r.us, r.kind, r.event_id) for r in S.session_rows(events, beat, gap).collect()))
    want = [(1, 0, "step", 0), (1, 0, "step", 1), (1, 10, "step", 2), (1, 20, "ping", 2), (1, 30, "ping", 2), (1, 40, "done", 2), (1, 40, "step", 3), (1, 50, "ping", 3), (1, 60, "ping", 3), (1, 70, "done", 3), (1, 71, "step", 4), (1, 81, "ping", 4), (1, 91, "ping", 4), (1, 101, "done", 4)]
    want += [(2, 5, "step", 5), (2, 15, "ping", 5), (2, 25, "ping", 5), (2, 35, "done", 5)]
    assert got == sorted(want)


def test_live_stream_pings_by_the_clock(rocks, tmp_path):
    events = rocks.sql("SELECT 1L AS event_id, current_timestamp() AS ts, 7L AS user_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = S.session_stream(rocks.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 1_000_000, 3_000_000, live=True)
    q = stream.writeStream.format("memory").queryName("live_sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()
    kinds = []
    for _ in range(60):
        time.sleep(1)
        kinds = [r.kind for r in rocks.table("live_sessions").orderBy("us").collect()]
        if "done" in kinds:
            break
    q.stop()
    assert kinds == ["step", "ping", "ping", "done"]


def hashed(text):
    v = [0.0] * 256
    for i, c in enumerate(text):
        h = 5381 * 33 + ord(c)
        v[h % 2**32 % 256] += 0.5
        v[(h * 33 + ord(text[i + 1]) if i + 1 < len(text) else h) % 2**32 % 256] += 1
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def brute_guard(turns):
    """turns: (turn, action, text) of one conversation, in order."""
    history, blocked, out = [], 0, []
    for n, action, text in turns:
        v = hashed(text or "")
        same = [w for a, w in history[-3:] if a == action]
        best = max((sum(x * y for x, y in zip(v, w, strict=True)) for w in same), default=0.0)
        reason = "repeat" if len(same) >= 2 else "alike" if best >= 0.92 else None
        if reason:
            blocked += 1
        else:
            history.append((action, v))
        out.append((n, ("degraded" if blocked >= 2 else "blocked") if reason else "admitted", reason, len(same), round(best, 9)))
    return out


def by_conversation(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.turn)):
        out.setdefault(r.conv_id, []).append((r.turn, r.state, r.reason, r.repeats, round(r.best, 9)))
    return out


def test_turn_guard_against_plain_python(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = {c: brute_guard(sorted((r.turn, r.role, r.text) for r in turns if r.conv_id == c)) for c in {r.conv_id for r in turns}}
    got = by_conversation(QUERIES["turn_guard"](spark, SF).collect())
    assert got == want and {s for rows in got.values() for _, s, *_ in rows} == {"admitted", "blocked", "degraded"}


LOOP = [(0, "a", "look up the rule"), (1, "a", "something else entirely 12345"), (2, "a", "zzz"), (3, "b", "q"), (4, "a", "zzz"), (5, "b", "q"), (6, "c", None), (7, "c", ""), (8, "a", "look up the rule")]


def test_blocked_turns_leave_the_history(spark):
    frame = spark.createDataFrame([(1, *r) for r in LOOP], "conv_id long, turn long, action string, text string")
    got = by_conversation(S.guarded(frame).collect())[1]
    assert got == brute_guard(LOOP)
    assert [x[2] for x in got] == [None, None, "repeat", None, "repeat", "alike", None, None, None]


def test_guard_stream_equals_the_batch_across_restarts(rocks, tmp_path):
    turns = rocks.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", F.col("role").alias("action"), "text")
    add = in_files(turns, str(tmp_path / "in"), [F.col("turn") < 2, (F.col("turn") >= 2) & (F.col("turn") < 5), F.col("turn") >= 5])
    for k in range(3):
        add(k)
        stream = rocks.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))
        run_to_end(S.guard_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    got = by_conversation(rocks.read.parquet(str(tmp_path / "out")).collect())
    assert got == by_conversation(S.guarded(turns).collect())

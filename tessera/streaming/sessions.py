"""Sessions of events and guarded turns: batch scans, and the same as Structured Streaming with state.

``session_rows`` turns each user's events into the rows that a listener of the session gets: a step for
each event, a ping after each ``beat`` of silence, and done after ``gap`` of it. ``session_stream`` gives the
same rows from a stream: one processor for each user keeps the last event and sets a timer for what is due
next. With event time the rows are those of the batch, whatever the files and restarts; with processing
time (``live``) pings and done come by the clock, as a listener who waits wants them.

``guarded`` admits or blocks each turn of a conversation by the last admitted ones; ``guard_stream`` is its
streaming side, with the ring of admitted turns as state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.vectors import state_vector
from ..operators.spans import Scan, in_order

SESSION = "user_id long, kind string, us long, event_id long"
BEAT_US, GAP_US = 1_800_000_000, 7_200_000_000


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def session_rows(events: DataFrame, beat: int = BEAT_US, gap: int = GAP_US) -> DataFrame:
    """user_id, kind (step, ping, done), us (when), event_id (of the last step). Silence is measured from a
    step to the user's next one; done ends it, so that no ping follows. Without a next one the session
    is done after ``gap``. Events without a user or a time have no session."""
    own = events.select("user_id", _micros("ts").alias("us"), "event_id").where("user_id IS NOT NULL AND us IS NOT NULL")
    after = F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    silence = own.withColumn("next", after)
    end = F.least(F.coalesce("next", F.col("us") + gap), F.col("us") + gap)
    pings = F.when(end > F.col("us") + beat, F.transform(F.sequence(F.col("us") + beat, end - 1, F.lit(beat)), lambda t: F.struct(F.lit("ping").alias("kind"), t.alias("us"))))
    done = F.when(F.coalesce(F.col("next") >= F.col("us") + gap, F.lit(True)), F.array(F.struct(F.lit("done").alias("kind"), (F.col("us") + gap).alias("us"))))
    step = F.array(F.struct(F.lit("step").alias("kind"), F.col("us").alias("us")))
    none = F.array().cast("array<struct<kind:string,us:long>>")
    every = F.concat(step, F.coalesce(pings, none), F.coalesce(done, none))
    return silence.select("user_id", "event_id", F.explode(every).alias("r")).select("user_id", "r.kind", "r.us", "event_id")


class SessionProcessor(StatefulProcessor):
    """State of a user: time and id of the last step, how many pings followed it, and whether it was done."""

    def __init__(self, beat: int, gap: int, live: bool):
        self.beat, self.gap, self.live = beat, gap, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, event_id long, pings long, done boolean")

    def _silent(self, key: tuple, upto: int, strict: bool) -> list[tuple]:
        """What is due in the silence since the last step, before ``upto`` or (if not strict) at it."""
        if not self.last.exists():
            return []
        us, event, pings, done = self.last.get()
        rows, reached = [], lambda t: t < upto or (t == upto and not strict)
        while not done and us + (pings + 1) * self.beat < us + self.gap and reached(us + (pings + 1) * self.beat):
            pings += 1
            rows.append((*key, "ping", us + pings * self.beat, event))
        if not done and reached(us + self.gap):
            done = True
            rows.append((*key, "done", us + self.gap, event))
        self.last.update((us, event, pings, done))
        return rows

    def _set_timer(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        us, _, pings, done = self.last.get()
        if not done:
            due = min(us + (pings + 1) * self.beat, us + self.gap)
            self.handle.registerTimer(-(-due // 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out = []
        for us, event in pd.concat(list(rows))[["us", "event_id"]].sort_values(["us", "event_id"]).itertuples(index=False):
            if self.live:
                us = timerValues.getCurrentProcessingTimeInMs() * 1000
            # done at the time of a next step still ends the session before it
            out += self._silent(key, int(us) if not self._ends_at(int(us)) else int(us) + 1, True)
            out.append((*key, "step", int(us), int(event)))
            self.last.update((int(us), int(event), 0, False))
        self._set_timer()
        yield _frame(out)

    def _ends_at(self, us: int) -> bool:
        return self.last.exists() and self.last.get()[0] + self.gap == us

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that is due by now, not only what this timer was set for
        now = timerValues.getCurrentProcessingTimeInMs() if self.live else timerValues.getCurrentWatermarkInMs()
        out = self._silent(key, max(now, expiredTimerInfo.getExpiryTimeInMs()) * 1000, False)
        self._set_timer()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SESSION.split(", ")]).astype({"us": "int64", "event_id": "int64"})


def session_stream(events: DataFrame, beat: int = BEAT_US, gap: int = GAP_US, *, late: str = "0 seconds", live: bool = False) -> DataFrame:
    """session_rows of a streaming DataFrame, for writeStream with the RocksDB state store. Events may be
    ``late`` by that much; later ones are dropped. ``live``: pings and done by the clock, not by event time."""
    stamped = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.col("ts").cast("timestamp").alias("ts"), _micros("ts").alias("us"), "event_id")
    if not live:
        stamped = stamped.withWatermark("ts", late)
    return stamped.groupBy("user_id").transformWithStateInPandas(SessionProcessor(beat, gap, live), SESSION, "Append", "ProcessingTime" if live else "EventTime")


class Guard:
    """Blocks a turn if its action came ``repeats`` times among the last admitted ``history`` turns, or if its
    vector's cosine with one of the same action there is at least ``alike``. Blocked turns don't become
    history. From the ``recoveries``-th blocked turn on the session is degraded."""

    def __init__(self, history: int = 3, repeats: int = 2, alike: float = 0.92, recoveries: int = 2):
        self.repeats, self.alike, self.recoveries = repeats, alike, recoveries
        self.ring: deque[tuple[str, np.ndarray]] = deque(maxlen=history)
        self.blocked = 0

    def take(self, action: str, text: str | None) -> tuple[str, str | None, int, float]:
        """state, reason, repeats, best cosine."""
        vector, same = state_vector(text), [v for a, v in self.ring if a == action]
        best = max((float(vector @ v) for v in same), default=0.0)
        reason = "repeat" if len(same) >= self.repeats else "alike" if best >= self.alike else None
        if reason is None:
            self.ring.append((action, vector))
            return "admitted", None, len(same), best
        self.blocked += 1
        return "degraded" if self.blocked >= self.recoveries else "blocked", reason, len(same), best


GUARDED = "conv_id long, turn long, state string, reason string, repeats int, best double"


def guarded(turns: DataFrame, **rules) -> DataFrame:
    """conv_id, turn, state, reason, repeats and best of each turn (conv_id, turn, action, text). A null text
    counts as empty (its vector is zero, like nothing)."""

    class Turns(Scan):
        def __init__(self, key):
            super().__init__(key)
            self.guard = Guard(**rules)

        def take(self, turn, action, text):
            return [(*self.key, turn, *self.guard.take(action, text))]

    return in_order(turns, ["conv_id"], ["turn", "action", "text"], Turns, GUARDED)


class GuardProcessor(StatefulProcessor):
    """State of a conversation: the admitted turns that count, each with its vector, and the blocked ones' number."""

    def __init__(self, rules: dict):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "action string, vector binary")
        self.blocked = handle.getValueState("blocked", "n int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        guard = Guard(**self.rules)
        guard.ring.extend((a, np.frombuffer(v)) for a, v in self.ring.get())
        guard.blocked = self.blocked.get()[0] if self.blocked.exists() else 0
        frame = pd.concat(list(rows)).sort_values(["turn", "action"])
        out = [(*key, int(n), *guard.take(a, x)) for n, a, x in zip(frame["turn"], frame["action"], frame["text"], strict=True)]
        if guard.ring:
            self.ring.put([(a, v.tobytes()) for a, v in guard.ring])
        self.blocked.update((guard.blocked,))
        yield pd.DataFrame(out, columns=[x.split()[0] for x in GUARDED.split(", ")]).astype({"repeats": "int32"})

    def close(self) -> None:
        pass


def guard_stream(turns: DataFrame, **rules) -> DataFrame:
    """guarded() of a streaming DataFrame, for writeStream with the RocksDB state store. Turns of one batch are
    ordered; a turn that comes in a later batch comes after those before, as in a live session."""
    return turns.select("conv_id", "turn", "action", "text").groupBy("conv_id").transformWithStateInPandas(GuardProcessor(rules), GUARDED, "Append", "None")

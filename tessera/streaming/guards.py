"""Stateful operators over a user's ordered events: they stream through a task in key order, and
hold only the state of one key. ``stream_counts`` is their Structured Streaming side."""

from __future__ import annotations

import re
from collections import deque

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spans import Scan, in_order


def _ordered(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id", "event_type")


def loop_guard(events: DataFrame, history: int = 3, repeats: int = 2, recoveries: int = 2) -> DataFrame:
    """A step is blocked if its kind came ``repeats`` times among the last admitted ``history``
    steps; after ``recoveries`` blocked steps the user is degraded. Blocked steps don't count as
    history, which empties when one is blocked."""

    class Guard(Scan):
        blocked = 0

        def __init__(self, key):
            super().__init__(key)
            self.last = deque(maxlen=history)

        def take(self, us, event, kind):
            refused = self.last.count(kind) >= repeats
            self.blocked += refused
            self.last.clear() if refused else self.last.append(kind)
            return [(event, *self.key, "degraded" if self.blocked > recoveries else "blocked" if refused else "admitted")]

    return in_order(_ordered(events), ["user_id"], ["us", "event_id", "event_type"], Guard, "event_id long, user_id long, state string")


def token_bucket(events: DataFrame, rate: float, capacity: float) -> DataFrame:
    """rate: tokens a second. An event takes one token or is refused."""

    class Bucket(Scan):
        tokens, at = capacity, None

        def take(self, us, event, kind):
            self.tokens = min(capacity, self.tokens + (0 if self.at is None else (us - self.at) / 1e6 * rate))
            self.at, admitted = us, self.tokens >= 1
            self.tokens -= admitted
            return [(event, *self.key, admitted)]

    return in_order(_ordered(events), ["user_id"], ["us", "event_id", "event_type"], Bucket, "event_id long, user_id long, admitted boolean")


class AnswerText(Scan):
    """The value of "action_input" in a JSON object that comes in pieces, once its "action" says answer
    or finish: decoded piece by piece, escapes and pairs of surrogates across pieces included. Nothing else gets
    out. Half a pair gives U+FFFD; an escape that JSON doesn't know stays as it is."""

    ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "\\": "\\", "/": "/"}
    ACTION = regex.compile(r'"action"\s*:\s*"(?:answer|finish)"')
    INPUT = regex.compile(r'"action_input"\s*:\s*"')
    UNIT = re.compile(r"\\u([0-9a-fA-F]{4})")
    LOW = re.compile(r"\\(?:u(?:[dD](?:[c-fC-F][0-9a-fA-F]?)?)?)?")  # how a low surrogate may begin

    def __init__(self, key):
        super().__init__(key)
        self.wanted, self.rest, self.state = False, "", "head"
        self.open = {"action": "", "input": ""}  # what may begin one of the keys
        self.waiting: list[str] | None = None  # the value's pieces, until its action is known

    def decode(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            c = text[i]
            if c == '"':
                self.state = "done"
                return "".join(out)
            if c != "\\":
                out.append(c)
                i += 1
                continue
            if text[i + 1 : i + 2] != "u":
                if i + 2 > len(text):
                    break
                out.append(self.ESCAPES.get(text[i + 1], text[i : i + 2]))
                i += 2
                continue
            m = self.UNIT.match(text, i)
            if m is None:
                if len(text) < i + 6 and '"' not in text[i:]:
                    break  # goes on in the next piece
                out.append(text[i : i + 2])
                i += 2
                continue
            unit, at = int(m[1], 16), i + 6
            if 0xD800 <= unit < 0xDC00:
                low = self.UNIT.match(text, at)
                if low is None and (at == len(text) or self.LOW.fullmatch(text, at)):
                    break
                if low is not None and 0xDC00 <= int(low[1], 16) < 0xE000:
                    unit, at = 0x10000 + ((unit - 0xD800) << 10) + int(low[1], 16) - 0xDC00, at + 6
            out.append("\ufffd" if 0xD800 <= unit < 0xE000 else chr(unit))
            i = at
        self.rest = text[i:]
        return "".join(out)

    def _find(self, name: str, pattern, piece: str) -> str | None:
        """What follows a key that is complete now; only what may begin one is kept."""
        held = self.open[name] + piece
        m = pattern.search(held, partial=True)
        self.open[name] = held[m.start() :] if m else ""
        return held[m.end() :] if m and not m.partial else None

    def take(self, n, piece):
        if self.state == "done":
            return []
        if self.state == "head":
            self.wanted = self.wanted or self._find("action", self.ACTION, piece) is not None
            if self.waiting is None:
                value = self._find("input", self.INPUT, piece)
                self.waiting = None if value is None else [value]
            else:
                self.waiting.append(piece)
            if not self.wanted or self.waiting is None:
                return []
            self.state, piece, self.waiting = "value", "".join(self.waiting), None
        text = self.decode(self.rest + piece)
        return [(*self.key, n, text)] if text else []


def answer_text(pieces: DataFrame) -> DataFrame:
    """conv_id, n, text: what of each piece (conv_id, n, piece) belongs to the answer."""
    return in_order(pieces, ["conv_id"], ["n", "piece"], AnswerText, "conv_id long, n long, text string")


def stream_counts(spark: SparkSession, path: str, schema, *, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts of event types by event time, with late data allowed for; for writeStream."""
    events = spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))

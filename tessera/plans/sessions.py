"""Queries over sessions: what a listener gets of them, and turns guarded against loops."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, state_vector
from ..streaming import sessions
from .registry import query

SESSION_SQL = """
WITH l AS (
    SELECT user_id, event_id, epoch_us(ts) AS us, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx
    FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL
), ends AS (SELECT *, least(coalesce(nx, us + 7200000000), us + 7200000000) AS e FROM l)
SELECT user_id, 'step' AS kind, us, event_id FROM l
UNION ALL
SELECT user_id, 'ping', us + k * 1800000000, event_id FROM ends, range(1, 5) r(k) WHERE us + k * 1800000000 < e
UNION ALL
SELECT user_id, 'done', us + 7200000000, event_id FROM l WHERE nx IS NULL OR nx >= us + 7200000000
"""


@query("session_events", SESSION_SQL)
def session_events(t, spark):
    """Steps, pings and the end of every user's sessions; streaming.sessions gives the same as a stream."""
    return sessions.session_rows(t("events"))


@query("turn_guard")
def turn_guard(t, spark):
    """Every turn admitted, blocked or degraded by repeats and by the cosine of hashed vectors."""
    return sessions.guarded(t("conversations").select("conv_id", "turn", F.col("role").alias("action"), "text"))


SIMILARITY_SQL = """
WITH c AS (SELECT conv_id, turn, role, unnest(range(1, length(text) + 1)) AS i, text FROM conversations WHERE text IS NOT NULL),
o AS (SELECT conv_id, turn, (177573 + ord(text[i])) % 4294967296 AS one, CASE WHEN i < length(text) THEN ((177573 + ord(text[i])) * 33 + ord(text[i + 1])) % 4294967296 ELSE (177573 + ord(text[i])) % 4294967296 END AS two FROM c),
v AS (SELECT conv_id, turn, b, sum(w) AS w FROM (SELECT conv_id, turn, one % 256 AS b, 0.5::DOUBLE AS w FROM o UNION ALL SELECT conv_id, turn, two % 256, 1.0::DOUBLE FROM o) GROUP BY 1, 2, 3),
n AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS n FROM v GROUP BY 1, 2),
p AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
near AS (SELECT a.conv_id, a.turn, b.turn AS other FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.role = b.role AND b.rn BETWEEN a.rn - 3 AND a.rn - 1),
s AS (SELECT near.conv_id, near.turn, near.other, sum(x.w * y.w) / max(nx.n * ny.n) AS c
      FROM near JOIN v x ON x.conv_id = near.conv_id AND x.turn = near.turn JOIN v y ON y.conv_id = near.conv_id AND y.turn = near.other AND y.b = x.b
      JOIN n nx ON nx.conv_id = near.conv_id AND nx.turn = near.turn JOIN n ny ON ny.conv_id = near.conv_id AND ny.turn = near.other GROUP BY 1, 2, 3)
SELECT p.conv_id, p.turn, CAST((SELECT count(*) FROM near WHERE near.conv_id = p.conv_id AND near.turn = p.turn) AS INT) AS repeats,
    round(coalesce((SELECT max(c) FROM s WHERE s.conv_id = p.conv_id AND s.turn = p.turn), 0), 6) AS best
FROM p
"""


@query("turn_similarity", SIMILARITY_SQL)
def turn_similarity(t, spark):
    """How many of the last three turns have the same role, and the greatest cosine with one of them."""
    turns = t("conversations")

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            own = pa.array([state_vector(x).tolist() for x in batch.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "turn", "role")), own], names=["conv_id", "turn", "role", "v"])

    own = turns.select("conv_id", "turn", "role", "text").mapInArrow(vectors, "conv_id long, turn long, role string, v array<double>")
    w = Window.partitionBy("conv_id").orderBy("turn")
    near = [F.lag(F.struct("role", "v"), k).over(w) for k in (1, 2, 3)]
    placed = own.select("conv_id", "turn", "role", "v", *(n.alias(f"n{k}") for k, n in enumerate(near)))
    same = [F.when(F.col(f"n{k}.role") == F.col("role"), cosine(F.col("v"), F.col(f"n{k}.v"))) for k in range(3)]
    repeats = sum((s.isNotNull().cast("int") for s in same[1:]), same[0].isNotNull().cast("int"))
    return placed.select("conv_id", "turn", repeats.alias("repeats"), F.round(F.greatest(*(F.coalesce(s, F.lit(0.0)) for s in same)), 6).alias("best"))

"""Chains of replaced codes and graphs of dependent steps, for all keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def chain_ends(links: DataFrame) -> DataFrame:
    """code, valid_end, hops, since, path, status of every code that links(code, next, since) names, by pointer
    jumping: each round joins every open pointer with the pointer it points to, so that chains of n codes take
    log n rounds. Of several successors the latest holds. valid: nothing replaced it, so it is its own end.
    superseded: since is when its last successor came, path the codes from the next one to the end. cycle: the
    code is in a cycle or leads into one; it has neither end nor path. Rows without a code or a next are left out."""
    known = links.where("code IS NOT NULL AND next IS NOT NULL")
    one = known.groupBy("code").agg(F.max(F.struct("since", "next")).alias("l")).select("code", F.col("l.next").alias("end"), F.col("l.since").alias("since"))
    ends = known.select(F.col("next").alias("code")).distinct().join(one, "code", "left_anti")
    closed = stored(ends.select("code", F.col("code").alias("end"), F.lit(0).alias("hops"), F.lit(None).cast(one.schema["since"].dataType).alias("since"), F.array().cast(f"array<{one.schema['code'].dataType.simpleString()}>").alias("path")))
    open_ = stored(one.select("code", "end", F.lit(1).alias("hops"), "since", F.array("end").alias("path")))
    left, before = open_.count(), None
    # A chain's codes are all on the way of its first one, so each round closes some while any chain is open: a round
    # that closes none has left only cycles. Paths are never longer than twice the longest chain.
    while left and left != before:
        # what an open pointer points to is open or closed itself
        ahead = closed.unionByName(open_).select(F.col("code").alias("end"), F.col("end").alias("end2"), F.col("hops").alias("hops2"), F.col("since").alias("since2"), F.col("path").alias("path2"))
        both = open_.join(ahead, "end")
        moved = stored(both.select("code", F.col("end2").alias("end"), (F.col("hops") + F.col("hops2")).alias("hops"), F.coalesce("since2", "since").alias("since"), F.concat("path", "path2").alias("path")))
        ended = moved.join(ends.select(F.col("code").alias("end")), "end", "left_semi")
        closed, open_ = stored(closed.unionByName(ended)), stored(moved.join(ends.select(F.col("code").alias("end")), "end", "left_anti"))
        left, before = open_.count(), left
    done = closed.withColumn("status", F.when(F.col("hops") == 0, "valid").otherwise("superseded"))
    stuck = open_.withColumns({"end": F.lit(None).cast(one.schema["end"].dataType), "hops": F.lit(None).cast("int"), "since": F.lit(None).cast(one.schema["since"].dataType), "path": F.lit(None).cast(open_.schema["path"].dataType), "status": F.lit("cycle")})
    return done.unionByName(stuck).withColumnRenamed("end", "valid_end")


def step_status(steps: DataFrame, needs: DataFrame) -> DataFrame:
    """graph, step, status, wave. steps(graph, step, outcome): what a step comes to if it runs. needs(graph, step,
    other, hard): it waits for another step of its graph; after a hard one that isn't a success it is skipped.
    All graphs advance together, one wave of steps a round, which are those that wait for nothing more; what is
    left then waits for itself, and all steps of such graphs are refused, as are those of graphs where a step
    waits for one that isn't there. Repeated rows of a step or a need count once (the least outcome; hard before soft)."""
    own = steps.where("graph IS NOT NULL AND step IS NOT NULL").groupBy("graph", "step").agg(F.min(F.coalesce("outcome", F.lit("failed"))).alias("outcome"))
    edges = stored(needs.groupBy("graph", "step", "other").agg(F.bool_or("hard").alias("hard")).where("graph IS NOT NULL AND step IS NOT NULL"))
    count = edges.groupBy("graph", "step").agg(F.count(F.lit(1)).alias("waits"))
    rest = stored(own.join(count, ["graph", "step"], "left").select("graph", "step", "outcome", F.coalesce("waits", F.lit(0)).alias("waits"), F.lit(False).alias("cut")))
    wave, placed = 0, []
    while True:
        ready = rest.where("waits = 0").select("graph", "step", F.when(F.col("cut"), "skipped").otherwise(F.col("outcome")).alias("status"), F.lit(wave).alias("wave"))
        if ready.isEmpty():
            break
        ready = stored(ready)
        placed.append(ready)
        met = ready.select("graph", F.col("step").alias("other"), "status").join(edges, ["graph", "other"])
        hits = met.groupBy("graph", "step").agg(F.count(F.lit(1)).alias("met"), F.bool_or(F.col("hard") & (F.col("status") != "success")).alias("bad"))
        waiting = rest.where("waits > 0").join(hits, ["graph", "step"], "left")
        rest = stored(waiting.select("graph", "step", "outcome", (F.col("waits") - F.coalesce("met", F.lit(0))).alias("waits"), (F.col("cut") | F.coalesce("bad", F.lit(False))).alias("cut")))
        wave += 1
    refused = rest.select("graph").distinct()
    out = rest.select("graph", "step", F.lit("refused").alias("status"), F.lit(None).cast("int").alias("wave"))
    for part in placed:
        out = out.unionByName(part.join(refused, "graph", "left_anti")).unionByName(part.join(refused, "graph", "left_semi").select("graph", "step", F.lit("refused").alias("status"), F.lit(None).cast("int").alias("wave")))
    return out

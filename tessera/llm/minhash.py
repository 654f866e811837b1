"""Links between sets of 64-bit elements with Jaccard similarity of at least a threshold.

Fast similarity sketching: every element is thrown into one of ``size`` bins in round after round;
a coordinate keeps the element with the smallest hash of the first round that filled it. Rounds
``size`` to ``2 * size - 1`` throw all elements into one bin each, so that every coordinate fills.
As a coordinate looks at the first round that reached it, rounds after the last empty one change
nothing and are left out.

``link_classes`` bands the sketches and verifies candidates on the full sets:

1. Equal sets are one class; only classes go on.
2. ``bands`` bands of ``rows`` coordinates make buckets. A pair of similarity s meets in none with
   probability (1 - s^rows)^bands: 3e-8 at 0.75 with 64 bands of 5.
3. In each bucket, members are compared with a pivot, the member that meets most others. Verified
   pairs become links, and links become components. A pivot leaves its bucket, and the others of
   buckets with more than one component meet the next. What is left after ``PIVOTS`` of them:
   members outside their neighbourhood's largest component are compared with all of the
   neighbourhood, in pairs of blocks, of which nothing but links leaves. So a large group of near
   copies costs a few comparisons a member, and no link between components is lost.
4. Elements that only one candidate set holds are counted. A set of n elements, u of
   them its own, shares at most n - u with any other; pairs for which this is too few can't be
   links and are never made. Copies with many changes of their own, and texts that share a passage
   but not the rest, drop out here.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, relabel
from .shared import cut, drop, drop_with_shuffles
from .words import mix

BANDS, ROWS = 64, 5
#: Members of a bucket that meet all others of it one after another, before blocks are compared.
PIVOTS = 2
#: Sets in a block of the last comparison.
BLOCK = 256
_LOW48 = np.uint64((1 << 48) - 1)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROUND = np.uint64(0xD6E8FEB86659FD93)


def sketch(values: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Sketches (n, size) of n sets; set k has values[first[k]:first[k + 1]]. Empty sets: zeros."""
    n, counts = len(first) - 1, np.diff(first)
    done = np.zeros((n, size), dtype=np.uint64)
    rows = np.flatnonzero(counts > 0)  # sets with empty coordinates
    of = np.repeat(np.arange(len(rows)), counts[rows])
    out = np.full((len(rows), size), _EMPTY, dtype=np.uint64)
    for i in range(2 * size):
        if not len(rows):
            break
        with np.errstate(over="ignore"):
            h = mix(values + _ROUND * np.uint64(i + 1))
        at = of * size
        at += ((h >> np.uint64(48)) * np.uint64(size) >> np.uint64(16)).view(np.int64) if i < size else i - size
        h &= _LOW48
        h |= np.uint64(i) << np.uint64(48)
        np.minimum.at(out.reshape(-1), at, h)
        empty = (out == _EMPTY).any(axis=1)
        kept = empty[of]
        if 4 * np.count_nonzero(kept) <= 3 * len(of):  # by elements: sets with many of them are full first
            done[rows[~empty]] = out[~empty]
            values, of = values[kept], (np.cumsum(empty) - 1)[of[kept]]
            rows, out = rows[empty], out[empty]
    done[rows] = out
    return done


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key (n, bands) for each band."""
    n = len(sketches)
    parts = sketches.reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
    for j in range(rows):
        with np.errstate(over="ignore"):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key


def list_array(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """An Arrow array of lists of longs."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))


def jaccard_at_least(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """For sorted sets: 100 * intersection >= percent * union."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = len(a) - 1
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b = batch.column("set_a"), batch.column("set_b")
            ok = np.zeros(len(batch), dtype=bool)
            for k in range(len(batch)):
                y = np.frombuffer(b[k].as_buffer(), dtype=np.uint64)
                x = np.frombuffer(a[k].as_buffer(), dtype=np.uint64)
                ok[k] = jaccard_at_least(x, y, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok)], names=["a", "b", "linked"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with linked: whether the full sets are similar enough. sets: node, elements."""
    members = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("set_a")), "a")
    both = members.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("set_b")), "b")
    return both.mapInArrow(_verify(percent), "a binary, b binary, linked boolean")


def busy_buckets(each: DataFrame) -> DataFrame:
    """bucket, node, n of all buckets with n >= 2 nodes. each: node, bucket."""
    shared = (
        each.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.bit_xor(F.xxhash64("node")).alias("all"))
        .where("n > 1")
        .groupBy("n", "lo", "all")  # buckets of the same members are one
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", "n")
    )
    return each.join(shared, "bucket")


def _each(batches):
    """A row for each element of each set, with the set's first 8 bytes."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), dtype=np.int64) for x in batch.column("elements")]
        if sets:
            h = np.repeat(node_hashes(batch.column("node")).view(np.int64), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.concatenate(sets))], names=["h", "element"])


def own_elements(sets: DataFrame) -> DataFrame:
    """node, size and own: how many elements a set has, and how many that no other set here has."""
    once = sets.mapInArrow(_each, "h long, element long").groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.max("h").alias("h")).where("n = 1")
    own = once.groupBy("h").agg(F.count(F.lit(1)).alias("own"))
    sized = sets.select("node", node_hash("node").alias("h"), (F.octet_length("elements") / 8).cast("long").alias("size"))
    return sized.join(own, "h", "left").select("node", "size", F.coalesce("own", F.lit(0)).alias("own"))


def link_classes(members: DataFrame, sets: DataFrame, *, percent: int, prune_first: bool = True) -> DataFrame:
    """node, root of all nodes that meet another. members: bucket, node, n, as busy_buckets() gives
    them; sets: node, elements. Both are tables that cut() made, and are dropped. ``prune_first``:
    own elements are counted before any comparison, not after the first ones."""
    nodes = members.groupBy("node").agg(F.sum("n").alias("meets"))
    sized = sets.select("node", (F.octet_length("elements") / 8).cast("long").alias("size"), F.lit(0).cast("long").alias("own"))
    about = own_elements(sets) if prune_first else sized
    about = cut(about.where(100 * (F.col("size") - F.col("own")) >= percent * F.col("size")).join(nodes, "node"))
    state = cut(members.select("node").distinct().withColumn("root", F.col("node")))
    left = cut(members.drop("n").join(about, "node").withColumn("root", F.col("node")))
    drop_with_shuffles(members, about)
    for turn in range(PIVOTS):
        one = F.struct(F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), F.col("own").alias("own_b"))
        # One row for each bucket of more than one component: so one join tells these, and meets their pivots.
        pivot = left.groupBy("bucket").agg(F.max_by(one, F.struct("meets", "node")).alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket", "p.*")
        met = cut(left.join(pivot, "bucket").where("node <> b"))  # a pivot has met all of its bucket and leaves it
        if met.isEmpty():
            drop_with_shuffles(left, met, sets)
            return state
        most = F.least(F.col("size") - F.col("own"), F.col("size_b") - F.col("own_b"))
        may = met.where((F.col("root") != F.col("root_b")) & (100 * most >= percent * (F.col("size") + F.col("size_b") - most)))
        links = cut(verify(may.select(F.col("node").alias("a"), "b").distinct(), sets, percent).where("linked").select("a", "b"))
        state, was = _joined(state, links), state
        nxt = cut(met.select("bucket", "node", "meets", "size", "own").join(state, "node"))
        if turn == 0 and not prune_first:
            mixed = _mixed(nxt)
            own = own_elements(cut(sets.join(mixed.select("node"), "node", "left_semi")))
            fit = own.where(100 * (F.col("size") - F.col("own")) >= percent * F.col("size"))
            drop(nxt)
            nxt = cut(mixed.drop("size", "own").join(fit, "node"))
            drop(mixed)
        drop_with_shuffles(left, met, links, *([was] if state is not was else []))
        left = nxt
    mixed = _mixed(left)
    if not mixed.isEmpty():
        links = cut(compare_blocks(mixed, sets, percent))
        state = _joined(state, links)
    drop_with_shuffles(left, mixed, sets)
    return state


def _joined(state: DataFrame, links: DataFrame) -> DataFrame:
    """state(node, root) after links(a, b)."""
    if links.isEmpty():
        return state
    between = links.join(state.toDF("a", "ra"), "a").join(state.toDF("b", "rb"), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return cut(relabel(state, components(between)))


def compare_blocks(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of each neighbourhood. left: bucket, node, root, size,
    own. A neighbourhood is what buckets connect, components being one node each; its members outside
    its largest component (asking) meet all its members (asked), a block of each at a time."""
    roots = left.select("bucket", "root").distinct()
    hub = roots.groupBy("bucket").agg(F.min("root").alias("a"))
    place = components(roots.join(hub, "bucket").select("a", F.col("root").alias("b"))).toDF("root", "hood")
    nodes = left.select("node", "root", "size", "own").distinct().join(place, "root")
    counts = nodes.groupBy("hood", "root").agg(F.count(F.lit(1)).alias("c"))
    hoods = counts.groupBy("hood").agg(F.sum("c").alias("all"), F.max(F.struct("c", "root")).alias("top")).select("hood", "all", F.col("top.root").alias("main"), F.col("top.c").alias("in_main"))
    nodes = cut(nodes.join(hoods, "hood").join(sets, "node"))
    asking_blocks, asked_blocks = F.ceil((F.col("all") - F.col("in_main")) / BLOCK), F.ceil(F.col("all") / BLOCK)
    asking = nodes.where("root <> main").withColumns({"x": F.pmod(F.xxhash64("node"), asking_blocks), "y": F.explode(F.sequence(F.lit(0).cast("long"), asked_blocks - 1)), "asks": F.lit(True)})
    asked = nodes.withColumns({"y": F.pmod(F.xxhash64("node"), asked_blocks), "x": F.explode(F.sequence(F.lit(0).cast("long"), asking_blocks - 1)), "asks": F.lit(False)})
    columns = ["hood", "x", "y", "asks", "node", "root", "size", "own", "elements"]
    both = asking.select(columns).unionByName(asked.select(columns))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "hood", "x", "y").sortWithinPartitions("hood", "x", "y", "asks")
    return dealt.mapInArrow(_compare(percent), "a binary, b binary").distinct()


def _compare(percent: int):
    """Streams block pairs: the asked come first, then each asking set is held against all of them."""

    def links(asked, root, size, own, elements):
        roots, sizes, owns, values, starts = asked
        both = np.minimum(size - own, sizes - owns)
        may = np.flatnonzero((100 * both >= percent * (size + sizes - both)) & (roots != root))
        if not len(may):
            return []
        a = np.frombuffer(elements, dtype=np.uint64)
        near = [values[starts[k] : starts[k + 1]] for k in may]
        flat = np.concatenate(near)
        at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
        shared = np.add.reduceat((a[at] == flat).astype(np.int64), np.r_[0, np.cumsum([len(x) for x in near])[:-1]])
        return may[100 * shared >= percent * (size + sizes[may] - shared)]

    def run(batches):
        key, rows, asked, names, out = None, [], None, [], []
        for batch in batches:
            for *place, asks, node, root, size, own, elements in zip(*(batch.column(k).to_pylist() for k in ("hood", "x", "y", "asks", "node", "root", "size", "own", "elements")), strict=True):
                if place != key:
                    key, rows, asked = place, [], None
                if not asks:
                    rows.append((node, root, size, own, np.frombuffer(elements, dtype=np.uint64)))
                    continue
                if asked is None and rows:
                    names = [r[0] for r in rows]
                    asked = (np.array([r[1] for r in rows], dtype=object), np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.concatenate([r[4] for r in rows]), np.r_[0, np.cumsum([len(r[4]) for r in rows])])
                if asked is not None:
                    seen = set()
                    for k in links(asked, root, size, own, elements):
                        if asked[0][k] not in seen:  # one link to a component is enough
                            seen.add(asked[0][k])
                            out.append((min(node, names[k]), max(node, names[k])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["a", "b"])
                out = []

    return run


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that still hold more than one component."""
    kept = members.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    return cut(members.join(kept, "bucket"))


def node_hash(node: str):
    """The first 8 bytes of a node as a long."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")


def node_hashes(nodes: pa.Array) -> np.ndarray:
    """The same in numpy: fixed-size keys of 16 bytes, the first 8 read big-endian."""
    raw = b"".join(x.as_py()[:8] for x in nodes)
    return np.frombuffer(raw, dtype=">u8").astype(np.uint64)

"""Which 64-bit keys have more than one owner, by packed arrays instead of a row for each key.

Tasks sort the keys they meet and cut them by their first bits into parts; a part of a task's keys is
one row, whose array Spark shuffles. For each part the arrays are merged, and the keys with two owners
or more are read off. Of a key that has several owners in one task already, two go to its part, so that
a key with any share of the rows weighs no more than others; the rest are spread evenly. Parts follow
``spark.sql.shuffle.partitions``, so their size is that of any partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix, unique

_HELD = 1 << 20  # keys that a task holds before it sends them

#: From Arrow batches to (whether the owners are asked for, keys, owners).
Source = Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[bool, np.ndarray, np.ndarray]]]


class Repeats:
    """A key's first ``bits`` bits are its part. Where only the keys are asked for, 44 more bits tell
    keys apart and 20 tell owners apart, others for each key: a key of two owners is missed once in a
    million times. Where their owners are asked for too, it is 32 and 32 bits. Keys or owners that
    agree in these bits seem to repeat; that costs a needless comparison later."""

    def __init__(self, rows: DataFrame):
        self.partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.bits = min(20, (4 * self.partitions - 1).bit_length())

    def key_of(self, keys: np.ndarray, owned: bool = False) -> np.ndarray:
        """Keys as find() reports them, all bits mixed."""
        return mix(keys >> np.uint64((32 if owned else 20) - self.bits)).view(np.int64)

    @staticmethod
    def owner_of(owners: np.ndarray) -> np.ndarray:
        """Owners as find() reports them."""
        return mix(owners & np.uint64(0xFFFFFFFF)).view(np.int64)

    def find(self, rows: DataFrame, source: Source) -> DataFrame:
        """value (long) and owner (boolean): every key with at least two owners, and the owners of
        such keys where they are asked for. A value may come several times."""
        packed = rows.mapInArrow(self._pack(source), "part int, owned boolean, known boolean, keys binary")
        dealt = packed.repartition(self.partitions, "part", "owned", "known").sortWithinPartitions("owned", "known", "part")
        return dealt.mapInArrow(self._merge(), "value long, owner boolean")

    def _pack(self, source: Source):
        def send(owned: bool, held: list[tuple[np.ndarray, np.ndarray]], turn: int) -> pa.RecordBatch:
            keys, owners = np.concatenate([k for k, _ in held]), np.concatenate([o for _, o in held])
            width, bits = np.uint64(32 if owned else 20), np.uint64(self.bits)
            part = (keys >> (np.uint64(64) - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            values = ((keys << bits) >> width << width | owners)[order]
            own, starts = np.unique(part[order], return_index=True)
            rows, known = [], []
            for k, mine in zip(own.tolist(), np.split(values, starts[1:]), strict=True):
                mine = unique(mine)
                third = _third(mine, width)
                rows.append((k, False, mine[~third].tobytes()))
                if owned:
                    known.append(mine[third] & np.uint64(0xFFFFFFFF))
            more = unique(np.concatenate(known)) if known else keys[:0]
            if len(more):
                rows.append((turn, True, more.tobytes()))
            cols = [pa.array([r[0] for r in rows], pa.int32()), pa.array([owned] * len(rows), pa.bool_()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "owned", "known", "keys"])

        def run(batches):
            held, n, turn = {False: [], True: []}, {False: 0, True: 0}, 0
            for owned, keys, owners in source(batches):
                turn += 1
                held[owned].append((keys, owners & np.uint64(0xFFFFFFFF) if owned else mix(keys ^ owners) & np.uint64(0xFFFFF)))
                n[owned] += len(keys)
                if n[owned] >= _HELD:
                    yield send(owned, held[owned], turn + int(keys[0] & np.uint64(0xFFFF)) if len(keys) else turn)
                    held[owned], n[owned] = [], 0
            for owned in (False, True):
                if n[owned]:
                    yield send(owned, held[owned], turn)

        return run

    def _merge(self):
        """Takes the rows of a part one after another. What several of them hold is merged as they
        come; of a key known to repeat, two owners stay to be met by later ones."""

        def found(owned: bool, part: int, values: np.ndarray):
            width = np.uint64(32 if owned else 20)
            key = values >> width
            again = np.r_[False, key[1:] == key[:-1]] | np.r_[key[1:] == key[:-1], False] if len(key) else np.zeros(0, bool)
            full = unique(key[again]) | np.uint64(part) << (np.uint64(64) - width)
            out = [(mix(full).view(np.int64), False)]
            if owned:
                out.append((self.owner_of(unique(values[again] & np.uint64(0xFFFFFFFF))), True))
            for values_, is_owner in out:
                yield pa.RecordBatch.from_arrays([pa.array(values_), pa.array(np.full(len(values_), is_owner))], names=["value", "owner"])

        def run(batches):
            place, held, n = None, [], 0
            for batch in batches:
                for *now, keys in zip(*(batch.column(k).to_pylist() for k in ("owned", "part", "known")), batch.column("keys"), strict=True):
                    values = np.frombuffer(keys.as_py(), dtype=np.uint64)
                    if now[2]:
                        yield pa.RecordBatch.from_arrays([pa.array(self.owner_of(values)), pa.array(np.full(len(values), True))], names=["value", "owner"])
                        continue
                    if now != place:
                        if held:
                            yield from found(*place[:2], unique(np.concatenate(held)))
                        place, held, n = now, [], 0
                    held.append(values)
                    n += len(values)
                    if n > 4 * _HELD:
                        merged = unique(np.concatenate(held))
                        yield from found(*place[:2], merged)
                        held, n = [merged[~_third(merged, np.uint64(32 if now[0] else 20))]], 0
            if held:
                yield from found(*place[:2], unique(np.concatenate(held)))

        return run


def _third(values: np.ndarray, width: np.uint64) -> np.ndarray:
    """Of sorted distinct entries, which are not among the first two of their key."""
    key = values >> width
    return np.r_[np.zeros(min(2, len(values)), bool), key[2:] == key[:-2]] if len(values) > 2 else np.zeros(len(values), bool)

"""Arrow batches in parts, for what Python does within tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

#: Bytes of the rows that are worked on at once. Spark's batches have 10,000 rows however long; what Python makes of
#: them takes many times their size.
PART_BYTES = 1 << 20


def in_parts(batches: Iterable[pa.RecordBatch], most: int = PART_BYTES, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in slices of at most ``most`` bytes and ``rows`` rows; a longer row is alone in one."""
    for batch in batches:
        left = [batch]
        while left:
            part = left.pop()
            if len(part) > 1 and (part.nbytes > most or len(part) > rows):
                half = len(part) // 2
                left += [part.slice(half), part.slice(0, half)]
            else:
                yield part

"""Periodic runs of words, found in grammar-compressed texts.

A run is a stretch of consecutive words with smallest period q, at least max(least_length, power * q)
words long, that no neighbouring word extends keeping the period. ``periodic_runs`` finds all runs of
every row, and the text without their repeats:

1. Word ids of a batch of texts are compressed by Re-Pair: again and again, a pair of neighbouring symbols
   that repeats in its text gives way to a new nonterminal. All texts of a batch take a round together, and
   a round replaces an occurrence where neither overlapping pair is more frequent.
2. Every run lies within the expansion of a nonterminal whose boundary (between its two symbols) it crosses.
   These crossing runs are computed once for each nonterminal, on its first occurrence, by ``crossing``.
3. They are translated to all positions where the nonterminal is derived. As nonterminals are made in the
   text itself, these are the occurrences that the round replaced.
4. What is left of a text is joined by a balanced tree of nonterminals that occur once, in the same way.
5. Intervals of one period that others hold are merged into these, and of equal intervals the smallest
   period stays. What is left are the maximal runs.

Crossing runs: one side of the boundary holds at least two periods, so a square of that period begins
just before the boundary or ends just after it. Squares of all periods of all boundaries of a round are
tested together, by their first words, then by prefix hashes modulo a prime; bisection over the same hashes
extends those that hold. Results are verified word by word; should a hash have collided, the batch is done
again with another base.

Time is in proportion to n log n words for a text, memory to a batch of texts (a text of more than BLOCK
bytes is a batch of its own). Defined results: a null or empty text, or one without a word, has no words, no
runs and an empty collapsed text; rows are independent, so repeated rows have repeated results; doc_id is
passed through as it is; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_sizes, table

LEAST_LENGTH = 6
POWER = 4
#: Bytes of text that are compressed together.
BLOCK = 1 << 20
#: Squares that are tested together.
TESTS = 1 << 20

_PRIME = np.uint64((1 << 61) - 1)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def mulmod(a: np.ndarray, b) -> np.ndarray:
    """Products modulo 2**61 - 1, of numbers below it: by halves of 31 bits."""
    au, al = a >> np.uint64(31), a & _LOW31
    bu, bl = b >> np.uint64(31), b & _LOW31
    mid = al * bu + au * bl
    out = au * bu * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & _LOW30) << np.uint64(31)) + al * bl
    out = (out >> np.uint64(61)) + (out & _PRIME)
    return np.where(out >= _PRIME, out - _PRIME, out)


class Hashes:
    """Hashes of all stretches of a sequence of ids, from their prefixes."""

    def __init__(self, ids: np.ndarray, seed: int):
        n = len(ids)
        rng = np.random.default_rng([n, seed])
        base = np.uint64(rng.integers(1 << 40, (1 << 61) - 2))
        self.power = np.ones(1, dtype=np.uint64)
        step = base
        while len(self.power) <= n:  # base ** len(power) is the last times the base
            self.power = np.r_[self.power, mulmod(self.power, step)]
            step = mulmod(np.array([step]), step)[0]
        own = mulmod(rng.integers(1, (1 << 61) - 2, size=int(ids.max()) + 1 if n else 0).astype(np.uint64)[ids], self.power[:n])
        high = np.cumsum(own >> np.uint64(31)) % _PRIME
        total = mulmod(high, np.uint64(1 << 31)) + np.cumsum(own & _LOW31) % _PRIME
        self.upto = np.r_[np.uint64(0), np.where(total >= _PRIME, total - _PRIME, total)]

    def same(self, at: np.ndarray, distance: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the stretches at ``at`` and ``at + distance`` are equal."""
        one = self.upto[at + length] + _PRIME - self.upto[at]
        other = self.upto[at + distance + length] + _PRIME - self.upto[at + distance]
        return mulmod(one % _PRIME, self.power[distance]) == other % _PRIME

    def reach(self, at: np.ndarray, distance: np.ndarray, most: np.ndarray, forward: bool) -> np.ndarray:
        """How many words from ``at`` on (or before it) equal those ``distance`` further on, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        for _ in range(int(most.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            yes = self.same(at if forward else at - mid, distance, mid)
            low, high = np.where(yes, mid, low), np.where(yes, high, mid - 1)
        return low


class Sequence:
    """The word ids of some texts, one after another; ``first[k]`` to ``first[k + 1]`` are those of text k.
    Ids of different texts differ."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, seed: int, least_length: int, power: int):
        self.ids, self.first, self.least_length, self.power = ids, first, least_length, power
        self.pairs = ids[:-1] << 32 | ids[1:] if len(ids) else ids
        self.hashes = Hashes(ids, seed)
        self.found: list[np.ndarray] = []  # rows of start, end, period

    def crossing(self, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs within start..end that cross the boundary before ``middle``, clipped to start..end: the
        number of the node, and rows of (start, end, period)."""
        long = np.flatnonzero(end - start >= self.least_length)
        nodes, runs = [np.zeros(0, np.int64)], [np.zeros((0, 3), np.int64)]
        most = (end - start)[long] // self.power
        for right in (True, False):
            side = (end - middle if right else middle - start)[long]
            tests = np.minimum(most, side // 2)
            upto = np.cumsum(tests)
            k = 0
            while k < len(long):
                j = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + TESTS, side="right")))
                node, q = np.repeat(long[k:j], tests[k:j]), _counted(tests[k:j])
                k = j
                before = middle[node] - 1
                # the pair across the boundary comes again one period on, or came one period before
                pair = self.pairs[before]
                yes = np.flatnonzero(pair == self.pairs[before + q if right else np.maximum(before - q, 0)])
                node, q, before = node[yes], q[yes], before[yes]
                at = before if right else before + 2 - 2 * q
                inside = (at >= start[node]) & (at + 2 * q <= end[node])
                node, q, at = node[inside], q[inside], at[inside]
                yes = self.hashes.same(at, q, q)
                node, q, at = node[yes], q[yes], at[yes]
                ahead = self.hashes.reach(at, q, end[node] - q - at, True)
                behind = self.hashes.reach(at, q, at - start[node], False)
                run = np.stack([at - behind, at + ahead + q, q], axis=1)
                size = run[:, 1] - run[:, 0]
                yes = (size >= self.least_length) & (size >= self.power * q)
                nodes.append(node[yes])
                runs.append(run[yes])
        return np.concatenate(nodes), np.concatenate(runs)

    def compress(self) -> tuple[np.ndarray, np.ndarray]:
        """Re-Pair over all texts; notes the runs of nonterminals at all their places. The positions of the
        symbols that are left, and their texts."""
        symbol = self.ids
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        place, next_symbol = np.arange(len(symbol)), int(symbol.max(initial=-1)) + 1
        done = [(place[:0], text[:0])]
        while len(symbol):
            end = np.r_[place[1:], 0]
            last = np.r_[text[1:] != text[:-1], True]
            end[last] = self.first[text[last] + 1]
            chosen, group = self._chosen(symbol, last, next_symbol)
            if len(chosen) == 0:
                done.append((place, text))
                break
            # one node for each nonterminal, computed on its first occurrence
            order = np.argsort(group, kind="stable")
            chosen, group = chosen[order], group[order]
            new = np.r_[True, group[1:] != group[:-1]]
            rule, heads = np.cumsum(new) - 1, chosen[new]
            node, runs = self.crossing(place[heads], place[heads + 1], end[heads + 1])
            if len(node):
                size = np.bincount(rule)
                copies = size[node]
                which = np.repeat(np.arange(len(node)), copies)
                occurrence = (np.cumsum(size) - size)[node][which] + _counted(copies) - 1
                moved = place[chosen[occurrence]] - place[heads[node[which]]]
                self.found.append(runs[which] + np.stack([moved, moved, np.zeros_like(moved)], axis=1))
            symbol = symbol.copy()
            symbol[chosen] = next_symbol + rule
            next_symbol += len(heads)
            keep = np.ones(len(symbol), dtype=bool)
            keep[chosen + 1] = False
            # texts in which nothing was replaced are done
            busy = np.zeros(len(self.first), dtype=bool)
            busy[text[chosen]] = True
            active = busy[text]
            done.append((place[~active], text[~active]))
            keep &= active
            symbol, place, text = symbol[keep], place[keep], text[keep]
        place, text = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place, kind="stable")
        return place[order], text[order]

    @staticmethod
    def _chosen(symbol: np.ndarray, last: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of pairs to replace in a round, and numbers of the pairs: repeated pairs that no more
        frequent one overlaps, if two or more occurrences are left."""
        none = np.zeros(0, np.int64)
        often = np.bincount(symbol, minlength=symbols)[symbol] > 1
        at = np.flatnonzero(often[:-1] & often[1:] & ~last[:-1])
        if len(at) == 0:
            return none, none
        key = symbol[at] << 32 | symbol[at + 1]
        order = np.argsort(key)
        new = np.r_[True, np.diff(key[order]) != 0]
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        count = np.bincount(group)
        often = count[group] > 1
        at, group = at[often], group[often]
        if len(at) == 0:
            return none, none
        # Frequency first, then a random number of the pair, so that a third of a stretch of equally frequent
        # pairs is replaced at once and the grammar stays flat; 0 where no repeated pair is.
        draw = np.random.default_rng(len(count)).permutation(len(count))
        weight = np.zeros(len(symbol) + 1, np.int64)
        weight[at] = count[group] * (len(count) + 1) + draw[group] + 1
        own, before, after = weight[at], weight[at - 1], weight[at + 1]  # weight[-1] is 0
        # of a stretch of equal pairs (one symbol over and over) every second is taken
        starts = own != before
        stretch = np.cumsum(starts) - 1
        odd = (at - at[starts][stretch]) & 1
        yes = (odd == 0) & (own >= before) & (own >= after)
        at, group = at[yes], group[yes]
        enough = np.bincount(group, minlength=len(count))[group] > 1 if len(group) else np.zeros(0, bool)
        return at[enough], group[enough]

    def join(self, place: np.ndarray, text: np.ndarray) -> None:
        """A balanced tree over what Re-Pair left of each text."""
        while len(place):
            first = np.searchsorted(text, np.arange(len(self.first)))
            size = np.diff(first)
            if size.max() < 2:
                return
            number = np.arange(len(place)) - first[text]
            left = np.flatnonzero((number % 2 == 0) & (number + 1 < size[text]))
            end = np.r_[place[1:], 0]
            last = np.r_[text[1:] != text[:-1], True]
            end[last] = self.first[text[last] + 1]
            _, runs = self.crossing(place[left], place[left + 1], end[left + 1])
            self.found.append(runs)
            keep = (number % 2 == 0) & (size[text] > 1)
            place, text = place[keep], text[keep]

    def runs(self) -> np.ndarray:
        """All maximal runs: rows of start, end, period, by start and then period."""
        self.join(*self.compress())
        found = np.concatenate([np.zeros((0, 3), np.int64), *self.found])
        # intervals of one period that another holds
        start, end, q = found[np.lexsort((-found[:, 1], found[:, 0], found[:, 2]))].T
        far = end + q * (len(self.ids) + 1)
        keep = far > np.r_[-1, np.maximum.accumulate(far)[:-1]] if len(far) else np.zeros(0, bool)
        start, end, q = start[keep], end[keep], q[keep]
        # of equal intervals the smallest period
        order = np.lexsort((q, end, start))
        start, end, q = start[order], end[order], q[order]
        same = np.r_[False, (start[1:] == start[:-1]) & (end[1:] == end[:-1])] if len(start) else np.zeros(0, bool)
        start, end, q = start[~same], end[~same], q[~same]
        order = np.lexsort((q, start))
        return np.stack([start[order], end[order], q[order]], axis=1)

    def verified(self, runs: np.ndarray) -> bool:
        """Whether every run has its period, word by word, and no neighbouring word extends it."""
        if len(runs) == 0:
            return True
        start, end, q = runs.T
        size = end - start - q
        at = np.repeat(start, size) + _counted(size) - 1
        text = np.searchsorted(self.first, start, side="right") - 1
        left, right = self.first[text], self.first[text + 1]
        more = (start > left) & (self.ids[np.maximum(start - 1, 0)] == self.ids[start - 1 + q])
        more |= (end < right) & (self.ids[np.minimum(end, len(self.ids) - 1)] == self.ids[end - q])
        return bool((self.ids[at] == self.ids[at + np.repeat(q, size)]).all() and not more.any())


def _counted(sizes: np.ndarray) -> np.ndarray:
    """1, 2, ... sizes[0], 1, 2, ... sizes[1] and so on."""
    upto = np.cumsum(sizes)
    return np.arange(1, (upto[-1] if len(sizes) else 0) + 1) - np.repeat(upto - sizes, sizes)


def text_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and where each text's begin. Space and the bytes 09 to 0D end a word."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
    values, offsets = lists.flatten(), lists.offsets.to_numpy()
    offsets = offsets - offsets[0]
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    return values.filter(pa.array(full)), np.r_[0, np.cumsum(full)][offsets]


def batch_runs(words: pa.Array, first: np.ndarray, least_length: int = LEAST_LENGTH, power: int = POWER) -> np.ndarray:
    """All runs of all texts of a batch: rows of start, end (places among all words), period."""
    if len(words) == 0:
        return np.zeros((0, 3), np.int64)
    numbers = words.dictionary_encode()
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    own = text * len(numbers.dictionary) + numbers.indices.to_numpy().astype(np.int64)
    order = np.argsort(own)
    ids = np.empty(len(own), np.int64)
    ids[order] = np.cumsum(np.r_[0, np.diff(own[order]) != 0])
    for seed in range(20):
        sequence = Sequence(ids, first.astype(np.int64), seed, least_length, power)
        runs = sequence.runs()
        if sequence.verified(runs):
            return runs
    raise RuntimeError("prefix hashes collide with 20 bases")


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _best(runs: list[tuple[int, int, int]]) -> int:
    """The run of the greatest length / period; of equal ones the first."""
    best = 0
    for k, (_, length, q) in enumerate(runs):
        if length * runs[best][2] > runs[best][1] * q:
            best = k
    return best


def periodic_runs(docs: DataFrame, *, least_length: int = LEAST_LENGTH, power: int = POWER) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), best (the number in runs of the
    one with the greatest length / period, from 0; null if none) and collapsed (the words that no run
    contains after its first period, joined by a space) of every row. ``power``: 4 or more, so that one side of
    a boundary holds two periods."""
    if power < 4:
        raise ValueError("power must be at least 4")

    def find(batches):
        for batch in in_sizes(batches, "text", BLOCK):
            words, first = text_words(batch.column("text"))
            runs = batch_runs(words, first, least_length, power)
            start, end, q = runs.T
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start + q, 1)
            np.add.at(change, end, -1)
            keep = np.cumsum(change)[:-1] == 0
            kept = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(keep)][first], words.filter(pa.array(keep)))
            text = np.searchsorted(first, start, side="right") - 1
            ends = np.searchsorted(text, np.arange(len(batch) + 1))
            fields = (start - first[text], end - start, q)
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], fields=list(_RUN)))
            rows = np.stack(fields, axis=1)
            best = [_best(rows[a:b].tolist()) if b > a else None for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), lists, pa.array(best, pa.int32()), pc.binary_join(kept, pa.scalar(" ", pa.large_string())).cast(pa.string())],
                names=["doc_id", "n_words", "runs", "best", "collapsed"],
            )

    schema = "n_words long, runs array<struct<start:long,length:long,period:long>>, best int, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text as op11 wants it: in a tenth of all rows, by the id's CRC, words from a place on repeat the
    first few of them. A null id counts as the text "null"."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")))
    g = F.floor(h / 10)

    def planted(w):
        n = F.size(w)
        a = (g % n).cast("int")
        rest = n - a
        p = (1 + F.floor(rest / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil(rest / p).cast("int")))
        return F.concat_ws(" ", F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), rest))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, planted(w))), F.lit(0))
    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(changed, text)).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.get("runs", F.col("best"))
    return periodic_runs(docs).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("runs[best].length * 1000 div runs[best].period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

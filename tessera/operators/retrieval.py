"""Lexical and dense retrieval as DataFrame operations: postings, BM25, blocked inner products,
fusion of ranked lists, aggregation to parents, ranking metrics."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import in_parts
from ..functions.text import tokens
from ..functions.vectors import SIZE, state_vector
from ..sources.tables import stored

K1, B = 1.2, 0.75


def tokenised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, words, dl (number of words, 1 at least)."""
    words = tokens(F.coalesce(F.col(text), F.lit("")))
    return docs.select(key, words.alias("words")).withColumn("dl", F.greatest(F.size("words"), F.lit(1)))


def corpus_stats(words: DataFrame) -> DataFrame:
    """One row: n, avgdl."""
    return words.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


#: (query, word) pairs that are broadcast at most; more are asked in groups. They come to the driver as Arrow
#: columns (about 150 MB for five million of ten letters) and go to the workers as two arrays and the words.
ASKED_PAIRS = 5_000_000
_CELLS = 1 << 18  # pairs of a posting and a query that asks its word, for memory


class Asked:
    """The words of a set of queries, small enough to be broadcast."""

    def __init__(self, pairs: pa.Table):
        """pairs: columns of query id and word, distinct."""
        ids, terms = pairs.column(0).to_numpy(), pairs.column(1)
        unique = pc.unique(terms)
        words = unique.take(pc.sort_indices(unique))
        self.ids, query = np.unique(ids, return_inverse=True)
        self.words = words.to_pylist()
        self.query = query.astype(np.int32)
        self.word = pc.index_in(terms, value_set=words).to_numpy(zero_copy_only=False).astype(np.int32) if len(terms) else np.zeros(0, np.int32)
        self.sizes = np.bincount(self.query, minlength=len(self.ids))


def asked_pairs(queries: DataFrame, qid: str) -> DataFrame:
    return queries.select(F.col(qid).cast("long").alias(qid), F.explode(F.array_distinct("words")).alias("term"))


def _count_words(asked):
    """For each text its asked words and how often it has them; the words of a unit are one list."""

    def run(batches):
        known = pa.array(asked.value.words, pa.string())
        for batch in in_parts(batches):
            units = batch.column("units")
            lists = units.flatten()
            first = units.offsets.to_numpy() - units.offsets[0].as_py()
            unit_ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            number = pc.index_in(lists.flatten(), value_set=known)
            hit = np.flatnonzero(number.is_valid().to_numpy(zero_copy_only=False))
            unit = np.searchsorted(unit_ends, hit, side="right") - 1
            code, tf = np.unique(unit * np.int64(max(1, len(known))) + number.drop_null().to_numpy().astype(np.int64), return_counts=True)
            unit, word = code // max(1, len(known)), code % max(1, len(known))
            ends = np.searchsorted(unit, first).astype(np.int32)
            dl = np.maximum(1, np.diff(unit_ends)).astype(np.int32)
            lists_of = lambda v, e: pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v.astype(np.int32)))
            own = np.repeat(np.arange(len(first) - 1), np.diff(first))[unit] if len(unit) else unit
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), lists_of(dl[first[0] : first[-1]], first - first[0]), lists_of(unit - first[own] if len(unit) else unit, ends), lists_of(word, ends), lists_of(tf, ends)],
                names=["key", "dl", "unit", "word", "tf"],
            )

    return run


class _Best:
    """The best k texts of each query so far, by score, then key. At most queries x k rows are held beside those
    that came since the last thinning, and these are let in only if they reach the query's k-th score."""

    def __init__(self, n_queries: int, k: int):
        self.k, self.most = k, max(1 << 16, n_queries * k)
        self.bound = np.zeros(n_queries)
        self.held: list[tuple[np.ndarray, ...]] = []  # query, key, unit, score, units met
        self.n = 0
        self.open: list[tuple[np.ndarray, ...]] = []  # units of rows that go on: row, query, unit, score

    def add_units(self, row, unit, query, score, base, key) -> None:
        """Scored units; a row is ranked by its best one. The last row may go on."""
        self.open.append((row, query, unit, score))
        self._rows(base, key, row[-1] if len(row) else None)

    def _rows(self, base, key, going_on) -> None:
        row, query, unit, score = (np.concatenate(x) for x in zip(*self.open, strict=True))
        self.base, self.key = base, key
        whole = row != going_on
        self.open = [tuple(x[~whole] for x in (row, query, unit, score))]
        self._rank(row[whole], query[whole], unit[whole], score[whole])

    def end_rows(self) -> None:
        if self.open:
            self._rank(*(np.concatenate(x) for x in zip(*self.open, strict=True)))
            self.open = []

    def _rank(self, row, query, unit, score) -> None:
        if not len(row):
            return
        if len(self.base) - 1 == self.base[-1]:  # a unit a row
            met = np.ones(len(row), np.int64)
        else:
            order = np.lexsort((unit, -score, query, row))
            row, query, unit, score = row[order], query[order], unit[order], score[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (query[1:] != query[:-1])])
            met = np.add.reduceat((score > 0).astype(np.int64), first)
            row, query, unit, score = row[first], query[first], unit[first], score[first]
        good = (score > 0) & (score >= self.bound[query])
        if good.any():
            row = row[good]
            self.held.append((query[good], self.key[row], unit[good] - self.base[row], score[good], met[good]))
            self.n += len(row)
            if self.n > 2 * self.most:
                self._thin()

    def _thin(self) -> None:
        query, key, unit, score, met = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((key, -score, query))
        sorted_query = query[order]
        first = np.flatnonzero(np.r_[True, sorted_query[1:] != sorted_query[:-1]])
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
        last, kept = order[place == self.k - 1], order[place < self.k]
        self.bound[query[last]] = score[last]
        self.held = [tuple(x[kept] for x in (query, key, unit, score, met))]
        self.n = len(kept)

    def all(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0), np.zeros(0, np.int64))
        self._thin()
        return self.held[0]


def _score(asked, idf: np.ndarray, avgdl: float, k: int, k1: float, b: float, measures: tuple[str, ...]):
    """The best k texts of a task for each query and measure, by score, then key."""

    def run(batches):
        a = asked.value
        n_queries, n_words = len(a.ids), max(1, len(a.words))
        order = np.argsort(a.word, kind="stable")
        by_word, starts = a.query[order], np.searchsorted(a.word[order], np.arange(n_words + 1))
        best = {name: _Best(n_queries, k) for name in measures}
        for batch in in_parts(batches) if n_queries else ():
            key = batch.column("key").to_numpy()
            flat = {c: batch.column(c).flatten().to_numpy() for c in ("dl", "unit", "word", "tf")}
            base = np.r_[0, np.cumsum(pc.list_value_length(batch.column("dl")).to_numpy())]
            row = np.repeat(np.arange(len(key)), pc.list_value_length(batch.column("word")).to_numpy())
            unit, tf = base[:-1][row] + flat["unit"], flat["tf"]
            part = idf[flat["word"]] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * flat["dl"][unit] / avgdl)) if len(tf) else np.zeros(0)
            counts = np.diff(starts)[flat["word"]]
            upto = np.cumsum(counts)
            at = 0
            while at < len(tf):  # whole rows, or units of a row that alone has too many
                end = _stretch(row, unit, upto, at)
                # Every posting goes to the queries that ask its word.
                n = counts[at:end]
                of = np.repeat(np.arange(at, end), n)
                query = by_word[np.repeat(starts[:-1][flat["word"][at:end]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(of))]
                cell = (unit[of] - unit[at]).astype(np.int64) * n_queries + query
                cells, inverse = _numbered(cell, (int(unit[end - 1]) - int(unit[at]) + 1) * n_queries)
                own, asking = cells // n_queries + unit[at], cells % n_queries
                for name in measures:
                    if name == "bm25":
                        s = np.round(np.bincount(inverse, weights=part[of], minlength=len(cells)), 6)
                    else:
                        s = np.round(np.bincount(inverse, minlength=len(cells)) / a.sizes[asking], 6)
                    best[name].add_units(np.searchsorted(base, own, side="right") - 1, own, asking, s, base, key)
                at = end
            for x in best.values():
                x.end_rows()
        for name, x in best.items():
            query, key, unit, score, met = x.all()
            cols = [pa.array([name] * len(query), pa.string()), pa.array(a.ids[query]), pa.array(key), pa.array(unit.astype(np.int32)), pa.array(score), pa.array(met - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=["list", "qid", "key", "k", "score", "collapsed"])

    return run


def _stretch(row: np.ndarray, unit: np.ndarray, upto: np.ndarray, at: int) -> int:
    """Where to stop so that about _CELLS pairs are handled: behind a row, or if the row at hand has more than
    that, behind a unit of it."""
    limit = (upto[at - 1] if at else 0) + _CELLS
    end = max(at + 1, int(np.searchsorted(upto, limit, side="right")))
    if end >= len(row):
        return len(row)
    behind_row = int(np.searchsorted(row, row[end - 1], side="left"))
    if row[end] != row[end - 1] and end > at:
        return end
    if behind_row > at:
        return behind_row
    behind_unit = int(np.searchsorted(unit, unit[end - 1], side="left"))
    return behind_unit if behind_unit > at else int(np.searchsorted(unit, unit[at], side="right"))


def _numbered(cell: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The different cells in rising order, and each one's number: by counting where they are dense, else by sorting."""
    if size > 4 * len(cell) + 1024:
        return np.unique(cell, return_inverse=True)
    has = np.zeros(size, dtype=bool)
    has[cell] = True
    return np.flatnonzero(has), (np.cumsum(has) - 1)[cell]


def ranked(texts: DataFrame, queries: DataFrame, key: str, qid: str, k: int, *, measures: tuple[str, ...] = ("bm25",), k1: float = K1, b: float = B) -> DataFrame:
    """The best k texts of each query by each measure: list, qid, key, k (the best unit), score,
    collapsed (how many more units of the text share a word with the query), rank.

    texts: key (long), units (array of arrays of words: a text's chunks, or the whole as one).
    queries: tokenised(). ``bm25`` scores units; ``coverage`` is the share of a query's words.

    Texts are split into words once. Counts are taken in the row, of asked words only, and kept as a
    table; the asked words with their weights are broadcast, as there are at most ASKED_PAIRS of
    them. A task scores the units that share a word with a query, keeps the best k texts of each query and passes
    on these alone, when it ends. More pairs than that are asked in groups of queries.
    """
    spark = texts.sparkSession
    pairs = stored(asked_pairs(queries, qid))
    n_pairs = pairs.count()
    groups = -(-n_pairs // ASKED_PAIRS) if n_pairs else 1
    found = None
    for g in range(groups):
        mine = pairs if groups == 1 else pairs.where(F.pmod(F.xxhash64(qid), F.lit(groups)) == g)
        asked = Asked(mine.toArrow())  # ASKED_PAIRS at most
        shared = spark.sparkContext.broadcast(asked)
        counted = stored(texts.select(F.col(key).cast("long").alias("key"), "units").mapInArrow(_count_words(shared), "key long, dl array<int>, unit array<int>, word array<int>, tf array<int>"))
        stats = counted.select(F.sum(F.size("dl")).alias("n"), (F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda x, y: x + y)) / F.sum(F.size("dl"))).alias("avgdl")).first()
        df = np.zeros(len(asked.words))
        for r in counted.select(F.explode("word").alias("word")).groupBy("word").count().toLocalIterator():  # asked words at most
            df[r[0]] = r[1]
        weight = np.log(1 + ((stats.n or 0) - df + 0.5) / (df + 0.5))
        scored = counted.mapInArrow(_score(shared, weight, stats.avgdl or 1.0, k, k1, b, measures), f"list string, qid long, key long, k int, score double, collapsed long")
        found = scored if found is None else found.unionByName(scored)
    best = F.row_number().over(Window.partitionBy("list", "qid").orderBy(F.desc("score"), "key"))
    top = stored(found.withColumn("rank", best).where(F.col("rank") <= k))
    return top.select("list", F.col("qid").alias(qid), F.col("key").alias(key), "k", "score", "collapsed", "rank")


#: Characters of all passages that are broadcast at once.
PASSAGE_CHARS = 1 << 26


def _holders(passages):
    def run(batches):
        every = passages.value
        finder = ahocorasick.Automaton()
        for k, text in enumerate(every):
            if text:
                finder.add_word(text, k)
        empty = [k for k, text in enumerate(every) if not text]
        if len(finder):
            finder.make_automaton()
        for batch in in_parts(batches):
            keys, at = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is not None:
                    held = {k for _, k in finder.iter(text)} if len(finder) else set()
                    keys += [key] * (len(held) + len(empty))
                    at += [*held, *empty]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(at, pa.int32())], names=["key", "passage"])

    return run


def _found(passages):
    """The numbers of the passages that some text of a task holds."""

    def run(batches):
        every = passages.value
        finder = ahocorasick.Automaton()
        for k, text in enumerate(every):
            if text:
                finder.add_word(text, k)
        if len(finder):
            finder.make_automaton()
        found, empty = set(), {k for k, text in enumerate(every) if not text}
        for batch in batches:
            for text in batch.column("text"):
                if text.is_valid and len(found) < len(every):  # once all are found, no text can tell more
                    found |= empty
                    if len(finder):
                        found.update(k for _, k in finder.iter(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], names=["passage"])

    return run


def _passage_groups(passages: DataFrame):
    """PASSAGE_CHARS characters of different passages at a time, each with its rows of a stored table."""
    size = passages.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = -(-size // PASSAGE_CHARS) if size else 1
    for g in range(groups):
        mine = passages if groups == 1 else passages.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g)
        every = [r[0] for r in mine.select("text").distinct().toLocalIterator()]  # about PASSAGE_CHARS characters
        yield mine, every, passages.sparkSession.createDataFrame([(k, t) for k, t in enumerate(every)], "passage int, text string")


def holders(texts: DataFrame, passages: DataFrame, key: str, qid: str) -> DataFrame:
    """qid, key of every text that holds a passage, of any length, as it stands. Texts are read once
    for each PASSAGE_CHARS characters of different passages, which are looked for all together."""
    spark, found = texts.sparkSession, None
    own = stored(passages.where(F.col("text").isNotNull()).select(F.col(qid).cast("long").alias(qid), F.col("text")))
    for mine, every, numbers in _passage_groups(own):
        named = numbers.join(mine, "text").select("passage", qid)
        hits = texts.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(_holders(spark.sparkContext.broadcast(every)), "key long, passage int")
        part = hits.join(named, "passage").select(qid, F.col("key").alias(key))
        found = part if found is None else found.unionByName(part)
    return found


def held(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """text: the different passages that some text holds. Each task tells once which ones it met, so that neither a
    text's copies nor a passage's make rows."""
    spark, found = texts.sparkSession, None
    for _, every, numbers in _passage_groups(stored(passages.where(F.col("text").isNotNull()).select("text").distinct())):
        hits = texts.select("text").mapInArrow(_found(spark.sparkContext.broadcast(every)), "passage int").distinct()
        part = hits.join(numbers, "passage").select("text")
        found = part if found is None else found.unionByName(part)
    return stored(found)


def top_k(scored: DataFrame, group: str, order: list, k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group in the given order, with their rank."""
    return scored.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= k)


def rrf(lists: list[DataFrame], qid: str, key: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (qid, key, rank, score); ties by the scores' sum."""
    parts = [x.select(qid, key, (1.0 / (k + F.col("rank"))).alias("f"), F.col("score").cast("double").alias("t")) for x in lists]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(qid, key).agg(F.round(F.sum("f"), 9).alias("fused"), F.round(F.sum("t"), 6).alias("tiebreak"))


def winsor_minmax(score: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi <= lo, 0.0).otherwise((F.least(F.greatest(score, lo), hi) - lo) / F.nullif(hi - lo, F.lit(0.0)))


def blocked_top_k(vectors: DataFrame, queries: DataFrame, k: int, *, block: int = 4096) -> DataFrame:
    """Inner products of every query with every vector, in pairs of blocks: q, id, score (rounded to
    six places), rank of the best k of each query, by score, then id. Each pair of blocks is one
    matrix product; its best k rows leave it, and all rows that tie with the last of them."""
    n, m = (F.greatest(F.lit(1).cast("long"), F.ceil(F.count(F.lit(1)) / block)) for _ in range(2))
    v = vectors.crossJoin(F.broadcast(queries.agg(m.alias("m")))).crossJoin(F.broadcast(vectors.agg(n.alias("n"))))  # one row each
    v = v.select("id", "v", F.pmod(F.xxhash64("id"), F.col("n")).alias("vb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("qb"))
    q = queries.crossJoin(F.broadcast(queries.agg(m.alias("m")))).crossJoin(F.broadcast(vectors.agg(n.alias("n"))))
    q = q.select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.pmod(F.xxhash64("id"), F.col("m")).alias("qb2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("vb2"))

    def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "id": [], "score": []})
        s = np.round(np.stack(b["qv"].to_numpy()).astype(np.float64) @ np.stack(a["v"].to_numpy()).astype(np.float64).T, 6)
        s[b["qid"].to_numpy()[:, None] == a["id"].to_numpy()[None, :]] = -np.inf
        last = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        r, c = np.nonzero((s >= last[:, None]) & np.isfinite(s))
        out = pd.DataFrame({"q": b["qid"].to_numpy()[r], "id": a["id"].to_numpy()[c], "score": s[r, c]})
        return out.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)

    pairs = v.groupBy("vb", "qb").cogroup(q.groupBy("vb2", "qb2")).applyInPandas(product, "q long, id long, score double")
    return top_k(pairs, "q", [F.desc("score"), "id"], k)


def metrics(ranked: DataFrame, gold: DataFrame, qid: str, key: str, k: int) -> DataFrame:
    """Per query with gold: hit, recall, mrr, ndcg at k. ranked: qid, key, rank."""
    n_gold = gold.groupBy(qid).agg(F.countDistinct(key).alias("n_gold"))
    hits = ranked.where(F.col("rank") <= k).join(gold.select(qid, key).distinct(), [qid, key])
    per = hits.groupBy(qid).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, r: a + 1 / F.log2(r + 1))
    return n_gold.join(per, qid, "left").select(
        qid, F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("hit"), F.coalesce(F.col("n") / F.col("n_gold"), F.lit(0.0)).alias("recall"),
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )


#: Numbers of query vectors that are broadcast at once (128 MB as doubles); more queries are asked in groups.
ASKED_NUMBERS = 1 << 24


def dense_ranked(texts: DataFrame, queries: DataFrame, key: str, qid: str, k: int, *, vector=state_vector, size: int = SIZE) -> DataFrame:
    """qid, key, score (cosine, six places), rank: the best k texts of each query by their vectors, exactly. texts
    and queries have a column text. Vectors are made where the texts are read and never leave the task, which
    holds the best k texts of each query; queries' vectors are broadcast. A text without a vector (null, empty)
    is like nothing and isn't ranked."""
    spark = texts.sparkSession
    asked = stored(queries.select(F.col(qid).cast("long").alias(qid), F.coalesce("text", F.lit("")).alias("text")))
    groups = max(1, -(-asked.count() * size // ASKED_NUMBERS))

    def search(shared):
        def run(batches):
            ids, vectors = shared.value
            best = _Best(len(ids), k)
            for part in in_parts(batches, rows=1_000) if len(ids) else ():
                own = part.column("key").to_numpy()
                score = np.round(np.stack([vector(x) for x in part.column("text").to_pylist()]) @ vectors.T, 6) if len(part) else np.zeros((0, len(ids)))
                row, query = np.nonzero((score > 0) & (score >= best.bound))
                best.base, best.key = np.arange(len(own) + 1), own
                best._rank(row, query, row, score[row, query])
            query, own, _, score, _ = best.all()
            yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(own), pa.array(score)], names=["qid", "key", "score"])

        return run

    found = None
    for g in range(groups):
        mine = asked if groups == 1 else asked.where(F.pmod(F.xxhash64(qid), F.lit(groups)) == g)
        rows = mine.toArrow()
        vectors = np.stack([vector(x) for x in rows.column("text").to_pylist()]) if len(rows) else np.zeros((0, size))
        shared = spark.sparkContext.broadcast((rows.column(qid).to_numpy(), vectors))
        part = texts.select(F.col(key).cast("long").alias("key"), "text").mapInArrow(search(shared), "qid long, key long, score double")
        found = part if found is None else found.unionByName(part)
    top = stored(top_k(found, "qid", [F.desc("score"), "key"], k))
    return top.select(F.col("qid").alias(qid), F.col("key").alias(key), "score", "rank")

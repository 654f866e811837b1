"""Language identification in two steps: the family first, then the language within it.

A text becomes counts of hashed character 1- to 3-grams, scaled to length 1. Linear support vector
machines are fitted on them, one for each pair of families, and one for each pair of languages in
a family. The family with the most won pairs is chosen, then the language with the most won pairs
in it; equal wins go to the larger sum of margins, then to the first name. How like the mean of its
language's texts a text is (fit) tells whether it is in that language at all.

Training takes at most ``per_language`` distinct labelled texts of each language, those with the
smallest hash, so the sample has a bound and depends neither on partitions nor on copies. Only they
reach the driver, as counts over whole texts, of which it holds those above zero. Prediction is a map
over all rows, whole texts included.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if
no labelled row exists. A null lang is not learned from. Repeated rows have equal results. Columns
other than doc_id, text and lang are ignored, and lang is read in training only.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, free_memory, in_parts, table

DIMENSIONS = 1 << 12
GRAMS = (1, 2, 3)
PER_LANGUAGE = 3_000
UNKNOWN = "und"
#: A text whose counts are less like its language's mean (cosine) isn't in that language, nor in any
#: other that was learned: texts of other scripts and random letters lie below 0.2, and of 3,358
#: held-out texts none does, the shortest of four letters included.
LEAST_FIT = 0.2
#: Families of common languages (ISO 639-1). A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "is", "lb", "nl", "nb", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "tt", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "si", "ur"),
    "semitic": ("am", "ar", "he", "mt"),
    "sinitic": ("zh",),
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}
_LETTER = regex.compile(r"\p{L}")
_BLOCK = 1 << 19  # characters handled together


def family(language: str) -> str:
    return _FAMILY_OF.get(language, language)


def counts(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """(n, dimensions) counts of hashed character n-grams, scaled to length 1. White space, digits
    and marks count as one space each."""
    out = np.zeros((len(texts), dimensions), dtype=np.float32)
    k = 0
    while k < len(texts):
        j, size = k, 0
        while j < len(texts) and (j == k or size + len(texts[j]) <= _BLOCK):
            size += len(texts[j])
            j += 1
        if j == k + 1 and size > _BLOCK:  # a very long text, piece by piece; pieces overlap by the longest gram less one
            step = _BLOCK - max(GRAMS)
            for at in range(0, size, step):
                _add(out[k : k + 1], [texts[k][at : at + step + max(GRAMS) - 1]], dimensions)
        else:
            _add(out[k:j], texts[k:j], dimensions)
        k = j
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


#: Of ASCII, letters stand for themselves in lower case, NUL ends a text, all else is a space.
_PLAIN = np.array([ord(chr(i).lower()) if chr(i).isalpha() else 32 * (i > 0) for i in range(128)], dtype=np.uint32)


def _add(out: np.ndarray, texts: list[str], dimensions: int) -> None:
    points = np.frombuffer("\0".join(texts).lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.flatnonzero(points == 0)
    if len(ends) != len(texts) - 1:  # NUL in a text
        for k, t in enumerate(texts):
            _add(out[k : k + 1], [t.replace("\0", " ")], dimensions)
        return
    points = np.where(points < 128, _PLAIN[np.minimum(points, 127)], points)
    base = np.repeat(np.arange(len(texts), dtype=np.int32) * np.int32(dimensions), np.diff(np.r_[-1, ends, len(points)]))[: len(points)]
    shift = np.uint32(33 - dimensions.bit_length())
    found, h = [], np.zeros(len(points), dtype=np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(points) < n:
            break
        with np.errstate(over="ignore"):
            h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :]
            if n in GRAMS:
                at = base[: len(h)] + (((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> shift).astype(np.int32)
                found.append(at[base[: len(h)] == base[n - 1 :]] if len(texts) > 1 else at)
    out += np.bincount(np.concatenate(found), minlength=out.size).reshape(out.shape)


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, *, c: float = 1.0, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """A linear support vector machine with hinge loss on the given rows of x, by dual coordinate
    descent. y is 1 or -1. The last weight is the bias."""
    w, bias, a = np.zeros(x.shape[1], dtype=np.float32), 0.0, np.zeros(len(rows), dtype=np.float32)
    square = np.array([np.square(x[k], dtype=np.float32).sum() + 1 for k in rows])
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            own = x[rows[i]].astype(np.float32, copy=False)
            g = y[i] * (own @ w + bias) - 1
            new = min(max(a[i] - g / square[i], 0.0), c)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w += step * own
                bias += step
                moved = max(moved, abs(new - a[i]))
                a[i] = new
        if moved < 1e-3:
            break
    return np.r_[w, np.float32(bias)]


class Counts:
    """Rows of counts in order of (lang, row_hash). Only counts above zero are held, as places and float16
    values; x[k] and x[[k, ...]] are dense, in float32."""

    def __init__(self, rows: Iterable[Row]):
        keys, places, values, first = [], bytearray(), bytearray(), [0]
        for r in rows:
            keys.append((r["lang"], r["row_hash"]))
            places += r["places"]
            values += r["counts"]
            first.append(len(places) // 2)
        self.order = sorted(range(len(keys)), key=keys.__getitem__)
        self.labels = np.array([keys[k][0] for k in self.order], dtype=object)
        self.places, self.values, self.first = np.frombuffer(places, np.uint16), np.frombuffer(values, np.float16), first
        self.shape = (len(keys), DIMENSIONS)

    def _fill(self, out: np.ndarray, k: int) -> np.ndarray:
        a, b = self.first[self.order[k]], self.first[self.order[k] + 1]
        out[self.places[a:b]] = self.values[a:b]
        return out

    def __getitem__(self, rows) -> np.ndarray:
        if np.ndim(rows) == 0:
            return self._fill(np.zeros(DIMENSIONS, dtype=np.float32), rows)
        out = np.zeros((len(rows), DIMENSIONS), dtype=np.float32)
        for own, k in zip(out, rows, strict=True):
            self._fill(own, k)
        return out


class Model:
    """Pairs of classes with a separating line each: families, and the languages of each family."""

    def __init__(self, languages: list[str]):
        self.languages = sorted(languages)
        self.families = {f: [x for x in self.languages if family(x) == f] for f in sorted({family(x) for x in self.languages})}
        self.lines: dict[tuple[str, str], np.ndarray] = {}
        self.means = np.zeros((len(self.languages), DIMENSIONS), dtype=np.float32)

    def groups(self) -> list[list[str]]:
        return [list(self.families), *self.families.values()]

    def fit(self, x: np.ndarray, labels: np.ndarray) -> Model:
        for k, name in enumerate(self.languages):
            here = np.flatnonzero(labels == name)
            total = np.sum([x[here[at : at + 500]].astype(np.float32, copy=False).sum(axis=0) for at in range(0, len(here), 500)], axis=0)
            self.means[k] = total / np.linalg.norm(total)
        own = np.array([family(x) for x in labels])
        for kind, names in [(own, list(self.families)), *((labels, group) for group in self.families.values())]:
            for i, a in enumerate(names):
                for b in names[i + 1 :]:
                    here = np.flatnonzero((kind == a) | (kind == b))
                    self.lines[a, b] = svm(x, here, np.where(kind[here] == a, 1, -1).astype(np.float32))
        return self

    def choose(self, x: np.ndarray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Place of the chosen name, and its smallest margin against another."""
        wins = np.zeros((len(x), len(names)))
        least = np.full((len(x), len(names)), np.inf)
        for i, a in enumerate(names):
            for j in range(i + 1, len(names)):
                w = self.lines[a, names[j]]
                m = x @ w[:-1] + w[-1]
                wins[:, i] += (m >= 0) + np.tanh(m) / (4 * len(names))
                wins[:, j] += (m < 0) - np.tanh(m) / (4 * len(names))
                least[:, i], least[:, j] = np.minimum(least[:, i], m), np.minimum(least[:, j], -m)
        best = wins.argmax(axis=1)
        return best, least[np.arange(len(x)), best]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and fit of each text."""
        names = np.array([UNKNOWN] * len(texts), dtype=object)
        score, fit = np.zeros(len(texts)), np.zeros(len(texts))
        place = {name: k for k, name in enumerate(self.languages)}
        own = [k for k, t in enumerate(texts) if t and self.languages and _LETTER.search(t)]
        for lo in range(0, len(own), 500):
            rows = np.array(own[lo : lo + 500])
            x = counts([texts[k] for k in rows])
            chosen, margin = self.choose(x, list(self.families))
            for f, (_, languages) in enumerate(self.families.items()):
                here = chosen == f
                if here.any():
                    best, inner = self.choose(x[here], languages)
                    names[rows[here]] = np.array(languages, dtype=object)[best]
                    score[rows[here]] = 1 / (1 + np.exp(-2 * np.clip(np.minimum(margin[here], inner), -20, 20)))
            fit[rows] = np.einsum("ij,ij->i", x, self.means[[place[k] for k in names[rows]]])
        return list(names), score, fit


def held_out(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _least_hashes(most: int):
    """The ``most`` smallest distinct hashes of each language among a task's rows."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            lang, h = batch.column("lang").dictionary_encode(), batch.column("row_hash").to_numpy()
            of = lang.indices.to_numpy()
            for k, name in enumerate(lang.dictionary.to_pylist()):
                held[name] = np.unique(np.concatenate([held.get(name, h[:0]), h[of == k]]))[:most]
        for name, h in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h)], names=["lang", "row_hash"])

    return run


def _count_rows(batches):
    for batch in in_parts(batches, 1_000):
        x = counts(batch.column("text").to_pylist()).astype(np.float16)
        places = [np.flatnonzero(r).astype(np.uint16) for r in x]
        own = [pa.array([p.tobytes() for p in places], pa.binary()), pa.array([r[p].tobytes() for r, p in zip(x, places, strict=True)], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("row_hash"), *own], names=["lang", "row_hash", "places", "counts"])


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, row_hash and text: of each lang the distinct texts with the smallest hashes."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.col("text"), F.xxhash64("text").alias("row_hash"))
    least = labelled.select("lang", "row_hash").mapInArrow(_least_hashes(per_language), "lang string, row_hash long").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("row_hash"))
    taken = least.withColumn("place", place).where(F.col("place") <= per_language).drop("place")
    return labelled.join(F.broadcast(taken), ["lang", "row_hash"]).dropDuplicates(["lang", "row_hash"])  # per_language keys a language


def train(docs: DataFrame, *, per_language: int = PER_LANGUAGE) -> Model:
    """A model of docs(text, lang). At most ``per_language`` distinct texts of each lang are used."""
    counted = cut(sample(docs, per_language).select("lang", "row_hash", "text").mapInArrow(_count_rows, "lang string, row_hash long, places binary, counts binary"))
    x = Counts(counted.toLocalIterator())  # per_language rows a language
    model = Model(list(dict.fromkeys(x.labels)))
    if len(x.labels):
        model.fit(x, x.labels)
    del x
    free_memory()
    return model


def _predict(model):
    def run(batches):
        for batch in in_parts(batches, 1_000):
            names, score, fit = model.value.predict(batch.column("text").to_pylist())
            cols = [batch.column(n) for n in batch.schema.names if n != "text"]
            kept = [n for n in batch.schema.names if n != "text"]
            found = [pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(np.clip(fit, 0, 1), pa.float64())]
            yield pa.RecordBatch.from_arrays([*cols, *found], names=[*kept, "lang_pred", "score", "fit"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score and fit (0 to 1: how like its language's mean a text is) of
    every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a line has DIMENSIONS numbers; lines grow with languages, not rows
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return own.mapInArrow(_predict(shared), "doc_id long, held_out boolean, lang_pred string, score double, fit double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(~held_out(F.col("doc_id")))))


def known_only(docs: DataFrame, model: Model, *, wanted: tuple[str, ...] | None = None, least_fit: float = LEAST_FIT) -> DataFrame:
    """The rows of docs whose predicted language is one of ``wanted`` (None: any that was learned) and whose text
    is in it, as far as the fit tells: at least ``least_fit``. Rows without a letter go, and all rows where nothing
    was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in in_parts(batches, 1_000):
            names, _, fit = shared.value.predict(batch.column("text").to_pylist())
            yield batch.filter(pa.array([n != UNKNOWN and (wanted is None or n in wanted) and f >= least_fit for n, f in zip(names, fit, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

"""Secret scans: base patterns, and multipart credential linking.

``link_secrets`` finds the parts of credentials in every whole text:

* strong parts, always reported: ``assign`` (a keyword, then a value of 8 characters or more),
  ``access`` (an access key id) and ``hex`` (32 hex digits or more);
* weak parts: ``ident`` (a user or client name), ``token`` (a long mixed string without a keyword)
  and ``endpoint`` (an address of a service).

A weak part by itself means nothing. It is reported only if a complementary part lies within
``window`` characters in the same scope (text between blank lines): identifiers and endpoints
complement secrets, secrets complement both. The parts are rows, and the interval join is one
ordered pass over the parts of a scope in each direction, which keeps the nearest complementary
part before and after, and so makes no pairs.

Defined results: null text counts as empty and has no spans; each repeated row has its own result;
a weak part that overlaps a strong part is left out; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import in_parts, table

#: In the order in which spans with equal starts are listed.
KINDS = ("assign", "access", "hex", "ident", "token", "endpoint")
STRONG = KINDS[:3]
WINDOW = 240

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}+")
_IDENT = re.compile(r"""(?i:\b(?:user(?:_?name)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+""", re.ASCII)
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}+")
_ENDPOINT = re.compile(r"""(?i:https?|ftp|ssh|jdbc:[a-z]+|mongodb|redis|postgres)://[^\s"'<>]{4,}+|(?i:\b(?:host|endpoint|server))["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}+(?::[0-9]+)?""", re.ASCII)
_BLANK = re.compile(r"\n[ \t\r]*\n")
_KEYWORDS = ("passw", "secret", "token", "api")
_IDENT_WORDS = ("user", "login", "account", "client", "access")


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _mixed(s: str) -> bool:
    kinds = sum(bool(re.search(p, s)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return kinds >= 2 and bool(re.search("[0-9]", s)) and _entropy(s) >= 3.5


def parts(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, scope) of all parts of a text, strong and weak."""
    low = text.lower()
    found = []
    if any(k in low for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    weak = [("token", m.start(), m.end()) for m in _TOKEN.finditer(text) if _mixed(m[0])]
    if "://" in text or "host" in low or "endpoint" in low or "server" in low:
        weak += [("endpoint", m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    if any(k in low for k in _IDENT_WORDS):
        weak += [("ident", m.start(), m.end()) for m in _IDENT.finditer(text)]
    if weak:
        covered: list[tuple[int, int]] = []  # apart, in order
        for s, e in sorted((s, e) for _, s, e in found):
            if covered and s < covered[-1][1]:
                covered[-1] = (covered[-1][0], max(e, covered[-1][1]))
            else:
                covered.append((s, e))
        for kind, s, e in sorted(weak, key=lambda w: (w[0] != "endpoint", w[1])):  # an address before the tokens in it
            at = bisect.bisect_left(covered, (s, e))
            if (at == 0 or covered[at - 1][1] <= s) and (at == len(covered) or e <= covered[at][0]):
                found.append((kind, s, e))
                covered.insert(at, (s, e))
    if not found:
        return []
    blanks = [m.start() for m in _BLANK.finditer(text)]
    return [(k, s, e, bisect.bisect_left(blanks, s)) for k, s, e in found]


_PART = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("scope", pa.int64())])


def _find(batches):
    for batch in in_parts(batches, 1_000):
        out = []
        for text in batch.column("text"):
            value = text.as_py()
            out.append([{"kind": KINDS.index(k), "start": s, "end": e, "scope": c} for k, s, e, c in parts(value)] if value else [])
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.list_(_PART))], names=[*names, "parts"])


def link_secrets(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """One row for each row of docs: doc_id, text_key (MD5 of the text), spans: array of (kind,
    start, end), ordered by start, then kind; kind is a place in KINDS."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.md5(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.monotonically_increasing_id().alias("row"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    found = rows.mapInArrow(_find, "doc_id long, text_key string, row long, parts array<struct<kind int, start long, end long, scope long>>")
    # All parts of a row meet in one task; a row was one value before, so no group outgrows its row.
    each = found.repartition("row").select("doc_id", "text_key", "row", F.explode_outer("parts").alias("p")).select("doc_id", "text_key", "row", "p.*")
    secret = F.col("kind").isin(KINDS.index("assign"), KINDS.index("hex"), KINDS.index("token"))
    before = Window.partitionBy("row", "scope").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row", "scope").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def near(other):
        back = F.col("start") - F.max(F.when(other, F.col("end"))).over(before) <= window
        ahead = F.min(F.when(other, F.col("start"))).over(after) - F.col("end") <= window
        return F.coalesce(back, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    linked = each.withColumn("shown", (F.col("kind") < len(STRONG)) | F.when(secret, near(~secret)).otherwise(near(secret)))
    span = F.struct("start", "kind", "end")
    return (
        linked.groupBy("row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.array_sort(F.collect_list(F.when(F.col("shown"), span))).alias("spans"))
        .select("doc_id", "text_key", F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    )


def _joined(spans):
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"])), ",")


def digest(spans: DataFrame) -> DataFrame:
    """Counts and digest of the strong spans, and all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        *map(count, STRONG),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < len(STRONG))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(link_secrets(table(spark, sf_dir, "documents")))


_FOUND = "_spans_of_secrets"


def _masked(batches):
    for batch in in_parts(batches, 1_000):
        names = batch.schema.names
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column(_FOUND).to_pylist(), strict=True):
            if spans:
                out, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
                    if s["end"] > at:
                        out += [text[at : max(at, s["start"])], f"<{KINDS[s['kind']]}>" if s["start"] >= at else ""]
                        at = s["end"]
                text = "".join([*out, text[at:]])
            texts.append(text)
        keep = [n for n in names if n not in ("text", _FOUND, "n_chars")]
        cols = {n: batch.column(n) for n in keep} | {"text": pa.array(texts, pa.string())}
        if "n_chars" in names:
            cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        order = [n for n in names if n != _FOUND]
        yield pa.RecordBatch.from_arrays([cols[n] for n in order], names=order)


def redact(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """docs with a mark of its kind in place of each reported span, and n_chars to match."""
    spans = link_secrets(docs, window=window).where(F.size("spans") > 0).dropDuplicates(["doc_id", "text_key"])
    found = spans.withColumnRenamed("spans", _FOUND).alias("found")
    on = F.col("docs.doc_id").cast("long").eqNullSafe(F.col("found.doc_id")) & (F.md5(F.coalesce("docs.text", F.lit(""))) == F.col("found.text_key"))
    joined = docs.alias("docs").join(found, on, "left").select("docs.*", f"found.{_FOUND}")
    return joined.mapInArrow(_masked, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))

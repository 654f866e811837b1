"""BPE encoding and decoding with tree concatenation of long text.

``encode_documents`` gives, for every whole text, the ids that the tokenizers library gives for
the given vocabulary file, and the text that its decode() gives for them.

* A text of at most ``leaf`` characters is cut at plain white space, which no token of the vocabulary
  spans, so that a word's ids don't depend on its neighbours. Arrow splits a batch of texts and
  numbers its different words; only these are looked up in a bounded table of words met before, and
  the library encodes those it lacks. Ids and decoded words are gathered by number.
* A longer text is cut into halves, at any place, again and again. The leaves are rows of their own,
  which Spark deals to all tasks and which are encoded in parallel. Then neighbours are joined two by
  two: a window around the join, which grows on both sides up to white space, is encoded again, and
  from there on both sides agree with the whole. A side that has no white space becomes part of the
  next window.
* A run of more than ``leaf`` characters without white space has no such place. It is normalised and
  split into pretokens; a pretoken of more than ``leaf`` symbols is cut into halves of symbols. A
  window around a join of these grows until its first and last tokens are tokens of the left and
  right side; then the concatenation is the encoding of the whole.

Defined results: null text counts as empty; an empty text has no ids and decodes to an empty text;
repeated rows give repeated results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_sizes, table

LEAF = 16_384
#: Bytes of texts encoded together.
_PART = 1 << 20
#: Words whose ids a worker keeps; the table is emptied when it is full.
KEPT_WORDS = 400_000
#: Tokens of a window's edge that must be tokens of that side.
AGREE = 4

_PLAIN_SPACE = str.maketrans("\n\t\r", "   ")
_MARKS = ".,;:!?&%#*"


class Coder:
    """The vocabulary file's encoder, for words, and its merges, for leaves."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = dict(model["vocab"])
        self.tokens = {i: t for t, i in self.ids.items()}
        for special in spec.get("added_tokens") or []:
            self.tokens[special["id"]] = special["content"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.special = [s["content"] for s in spec.get("added_tokens") or []]
        splits = [s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        self.pretokens = regex.compile(splits[0]["pattern"]["Regex"])
        self.bytes = _byte_symbols()
        self.spelt = pa.array([(self.tokens[i] + " ").encode("utf-8") if i in self.tokens else None for i in range(max(self.tokens, default=-1) + 1)], pa.large_binary())
        self.words: dict[str, bytes] = {"": b""}

    def known(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian, 4 bytes each) of every word. A-Z are lowered and marks after a letter cut off first: both are encoded alike either way, and
        fewer words have to be known."""
        own = [self._core(w) for w in words]
        new = [w for w in {x for pair in own for x in pair} if w not in self.words]
        if len(self.words) + len(new) > KEPT_WORDS:
            self.words = {"": b""}
            new = list({x for pair in own for x in pair})
        for w, e in zip(new, self.lib.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.words[w] = pack(e.ids)
        return [self.words[core] + self.words[marks] if marks else self.words[core] for core, marks in own]

    @staticmethod
    def _core(word: str) -> tuple[str, str]:
        if "<" in word:  # may hold the name of a special token
            return word, ""
        if word.isascii():
            word = word.lower()
        core = word.rstrip(_MARKS)
        # Lowering may end a letter in a mark (U+0130 does), which would join the marks cut off.
        return (core, word[len(core) :]) if core[-1:].lower()[-1:].isalpha() else (word, "")

    def ids_of(self, words: list[str]) -> bytes:
        return b"".join(self.known(words))

    def decode(self, ids) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))

    def symbols(self, pretoken: str) -> list[str]:
        return [self.bytes[b] for b in pretoken.encode("utf-8")]

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges the pair of the lowest rank, the leftmost first, until none is left."""
        n, ranks = len(symbols), self.ranks
        parts: list[str | None] = list(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if parts[i] is not None else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (r := ranks.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p is not None]

    def atoms(self, tokens: list[str]) -> list[str]:
        """The symbols that tokens were merged from."""
        out: list[str] = []
        for t in tokens:
            if self.suffix and t.endswith(self.suffix) and len(t) > len(self.suffix):
                body = t[: -len(self.suffix)]
                out += [*body[:-1], body[-1] + self.suffix]
            else:
                out += t
        return out

    def join(self, a: list[str], b: list[str]) -> list[str]:
        """The tokens of the concatenated text of two encoded neighbours."""
        width = 2 * AGREE
        while True:
            i, j = max(0, len(a) - width), min(len(b), width)
            window = self.merge(self.atoms(a[i:] + b[:j]))
            if (i == 0 or window[:AGREE] == a[i : i + AGREE]) and (j == len(b) or window[-AGREE:] == b[j - AGREE : j]):
                return a[:i] + window + b[j:]
            width *= 2


def tree(leaves: list, join: Callable):
    """Joins neighbours two by two until one is left."""
    while len(leaves) > 1:
        leaves = [join(leaves[k], leaves[k + 1]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
    return leaves[0]


def _byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, others for the
    characters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def pack(ids) -> bytes:
    return np.fromiter(ids, dtype="<u4").tobytes()


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _short(path: str, digest: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        c = coder(path)
        for batch in in_sizes(batches, "text", _PART):
            words = pc.split_pattern(pc.replace_substring_regex(batch.column("text"), r"[\t\n\r]", " "), " ")
            numbered = words.values.dictionary_encode()
            known = pa.array(c.known(numbered.dictionary.to_pylist()), pa.large_binary())
            at, ids = _gathered(known, numbered.indices)
            place, spelt = _gathered(c.spelt, pa.array(np.frombuffer(ids, "<u4", count=at[-1] // 4)))
            ends = at[words.offsets.to_numpy()]  # of each text's ids
            yield _out(batch.column("doc_id"), _slices(ids, ends), [x[:-1] for x in _slices(spelt, place[ends // 4])], digest)

    return run


def _gathered(values: pa.Array, numbers: pa.Array) -> tuple[np.ndarray, memoryview]:
    """The values of these numbers, one after another: where each starts and the last ends, and their bytes."""
    if not len(numbers):
        return np.zeros(1, np.int64), memoryview(b"")
    _, offsets, data = values.take(numbers).buffers()
    return np.frombuffer(offsets, dtype=np.int64, count=len(numbers) + 1), memoryview(data) if data is not None else memoryview(b"")


def _slices(whole: memoryview, ends: np.ndarray) -> list[memoryview]:
    return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _out(rows, ids, decoded, digest: bool, first: str = "doc_id") -> pa.RecordBatch:
    """rows: what tells rows apart; ids and decoded: bytes."""
    if digest:
        cols = [
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([rows, *cols], names=[first, "n_tokens", "ids_sha256", "decoded_sha256"])
    cols = [pa.array([bytes(x) for x in ids], pa.binary()), pa.array([bytes(x).decode("utf-8") for x in decoded], pa.string())]
    return pa.RecordBatch.from_arrays([rows, *cols], names=[first, "ids", "decoded"])


_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"
_FULL = "ids binary, decoded string"


def halves(whole, leaf: int):
    """A text or list of symbols in halves of halves, none longer than leaf."""
    if len(whole) <= leaf:
        return [whole]
    mid = len(whole) // 2
    return halves(whole[:mid], leaf) + halves(whole[mid:], leaf)


_PIECE = "row_key string, piece long, run long, plain boolean, payload string"


def _pieces(path: str, leaf: int):
    """Rows of a long text: the leaves of stretches of words as they are (plain), and those of the
    pretokens of long runs, as symbols with spaces between. Leaves of one run make one tree."""

    def parts(c: Coder, text: str):
        number, at = 0, 0
        special = "(" + "|".join(map(regex.escape, c.special)) + ")" if c.special else "(?!)()"
        for found in [*regex.finditer(r"[^ \t\n\r]{%d,}" % (leaf + 1), text), None]:
            stretch = text[at : found.start() if found else len(text)]
            for one in halves(stretch, leaf) if stretch else ():
                yield number, True, one
            number += 1
            if found is None:
                return
            at = found.end()
            for k, piece in enumerate(regex.split(special, found[0])):
                if k % 2:
                    yield number, True, piece
                    number += 1
                    continue
                for m in c.pretokens.finditer(c.lib.normalizer.normalize_str(piece)) if piece else ():
                    symbols = c.symbols(m[0])
                    if symbols:
                        symbols[-1] += c.suffix
                        for one in halves(symbols, leaf):
                            yield number, False, " ".join(one)
                        number += 1

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _PIECE.split(", ")])

    def run(batches):
        c = coder(path)
        for batch in batches:
            out, held = [], 0
            for key, text in zip(batch.column("row_key").to_pylist(), batch.column("text"), strict=True):
                for n, (number, plain, payload) in enumerate(parts(c, text.as_py())):
                    out.append((key, n, number, plain, payload))
                    held += len(payload)
                    if held > 1 << 22:
                        yield rows(out)
                        out, held = [], 0
            if out:
                yield rows(out)

    return run


_LEAF = "row_key string, piece long, run long, plain boolean, spaced boolean, head string, ids binary, tail string"


def _leaves(path: str):
    """Each leaf by itself. A plain one: the ids of the words between its first and last white space,
    and what stands before and after these. Symbols: their merged tokens, as head."""

    def run(batches):
        c = coder(path)
        for batch in batches:
            spaced, heads, ids, tails = [], [], [], []
            for plain, payload in zip(batch.column("plain").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if plain:
                    head, *words = payload.translate(_PLAIN_SPACE).split(" ")
                    heads.append(head)
                    tails.append(words.pop() if words else "")
                    spaced.append(head != payload)
                    ids.append(c.ids_of(words))
                else:
                    heads.append(" ".join(c.merge(payload.split(" "))))
                    tails.append("")
                    spaced.append(False)
                    ids.append(b"")
            own = [pa.array(spaced, pa.bool_()), pa.array(heads, pa.string()), pa.array(ids, pa.binary()), pa.array(tails, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row_key", "piece", "run", "plain")), *own], names=[x.split()[0] for x in _LEAF.split(", ")])

    return run


#: (has white space, text up to it, ids of the words behind it, text after the last white space)
Stretch = tuple[bool, str, bytes, str]


def join_text(c: Coder, a: Stretch, b: Stretch) -> Stretch:
    """Two encoded neighbours as one: the window between a's last and b's first white space is encoded
    again; a side without white space goes into the window of the next join."""
    if not a[0]:
        return (b[0], a[1] + b[1], b[2], b[3])
    if not b[0]:
        return (True, a[1], a[2], a[3] + b[1])
    return (True, a[1], a[2] + c.ids_of([a[3] + b[1]]) + b[2], b[3])


def _concatenate(path: str, digest: bool):
    """Rows of a text, in order of their pieces: joins the leaves of each run."""

    def run(batches):
        c = coder(path)
        key, number, plain, leaves, ids = None, None, True, [], []

        def end_run():
            if leaves and plain:
                spaced, head, inner, tail = tree(leaves, lambda a, b: join_text(c, a, b))
                ids.append(c.ids_of([head]) + inner + c.ids_of([tail]))
            elif leaves:
                ids.append(pack(c.ids[t] for t in tree([x[1].split(" ") for x in leaves], c.join)))
            leaves.clear()

        def end_text():
            end_run()
            packed = b"".join(ids)
            ids.clear()
            return _out(pa.array([key], pa.string()), [packed], [c.decode(np.frombuffer(packed, "<u4").tolist()).encode("utf-8")], digest, "row_key")

        for batch in batches:
            names = ("row_key", "run", "plain", "spaced", "head", "ids", "tail")
            for k, n, p, *leaf in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
                if k != key:
                    if key is not None:
                        yield end_text()
                    key, number, plain = k, n, p
                elif n != number:
                    end_run()
                    number, plain = n, p
                leaves.append(tuple(leaf))
        if key is not None:
            yield end_text()

    return run


def encode_documents(docs: DataFrame, path: str, *, leaf: int = LEAF, digest: bool = False) -> DataFrame:
    """doc_id and the ids (packed, 4 bytes each, little-endian) and the decoded text of every row;
    with ``digest`` their counts and SHA-256 instead."""
    schema = _DIGEST if digest else _FULL
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.length("text") > leaf
    short = own.where(~is_long).mapInArrow(_short(path, digest), f"doc_id long, {schema}")
    # Equal long texts are encoded once: their key is their hash, and equal pieces meet before they are encoded.
    long = own.where(is_long).withColumn("row_key", F.sha2("text", 256))
    pieces = long.select("row_key", "text").mapInArrow(_pieces(path, leaf), _PIECE)
    once = pieces.groupBy("row_key", "piece").agg(F.any_value(F.struct("run", "plain", "payload")).alias("p")).select("row_key", "piece", "p.*")
    encoded = once.mapInArrow(_leaves(path), _LEAF)
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = encoded.repartition(parallel, "row_key").sortWithinPartitions("row_key", "piece")
    done = joined.mapInArrow(_concatenate(path, digest), f"row_key string, {schema}")
    return short.unionByName(long.select("doc_id", "row_key").join(done, "row_key").drop("row_key"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)

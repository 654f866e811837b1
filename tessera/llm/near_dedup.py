"""MinHash near-dedup of documents: five-word shingles, Jaccard similarity of 0.75 or more.

A text's words are what stands between spaces and the bytes 09 to 0D, with A-Z in lower case. Its
set holds all its five-word shingles; with fewer words, the whole sequence.

Defined results: a text that is null or has no word has an empty set and is linked with nothing;
its component_id is its own doc_id. A null doc_id never becomes the id of a component that has
another; a row with a null doc_id is kept only where its component has no other id. Repeated rows
have equal results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .minhash import BANDS, ROWS, band_keys, busy_buckets, link_classes, list_array, node_hash, sketch
from .shared import build_bitmap, cut, in_parts, table
from .words import Words, distinct, shingles

PERCENT = 75
_PART = 500  # texts handled together, for memory


def _sets(column: pa.Array):
    """The distinct shingles of texts, where each text's start, and digests of the sets."""
    words = Words(column)
    values, first = distinct(*shingles(words), len(words))
    nodes = [hashlib.md5(values[s:e].tobytes()).digest() if e > s else None for s, e in zip(first[:-1], first[1:], strict=True)]
    return values, first, nodes


def _sketches(bands: int, rows: int):
    def run(batches):
        for batch in in_parts(batches, _PART):
            values, first, nodes = _sets(batch.column("text"))
            keys = band_keys(sketch(values, first, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(nodes, pa.binary()),
                    list_array(keys.reshape(-1), np.arange(len(nodes) + 1) * bands),
                ],
                names=["doc_id", "n_shingles", "node", "keys"],
            )

    return run


def _elements(near):
    def run(batches):
        for batch in in_parts(batches, _PART):
            values, first, nodes = _sets(batch.column("text"))
            own = [k for k, x in enumerate(nodes) if x is not None]
            if not own:
                continue
            h = np.array([int.from_bytes(nodes[k][:8], "big") for k in own], dtype=np.uint64)
            own = [k for k, hit in zip(own, near.value.has(h), strict=True) if hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[k] for k in own], pa.binary()), pa.array([values[first[k] : first[k + 1]].tobytes() for k in own], pa.binary())],
                names=["node", "elements"],
            )

    return run


def near_components(docs: DataFrame, *, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sketched = cut(own.mapInArrow(_sketches(bands, rows), "doc_id long, n_shingles long, node binary, keys array<long>"))
    classes = sketched.where("node IS NOT NULL").groupBy("node").agg(F.any_value("keys").alias("keys"))
    members = cut(busy_buckets(classes.select("node", F.explode("keys").alias("bucket"))))
    nodes = members.select("node").distinct()
    near = docs.sparkSession.sparkContext.broadcast(build_bitmap(nodes.select(node_hash("node").alias("h")), "h"))  # 4 MB, whatever the input
    found = own.select("text").mapInArrow(_elements(near), "node binary, elements binary").groupBy("node").agg(F.any_value("elements").alias("elements"))
    sets = cut(found.join(nodes, "node", "left_semi"))
    roots = link_classes(members, sets, percent=percent)
    thin = sketched.select("doc_id", "n_shingles", "node")
    classes = thin.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    rooted = classes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("least_id"))
    named = rooted.join(least, "root").select("node", "least_id")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    placed = thin.join(named, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return placed.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))

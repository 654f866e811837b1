"""Five corpus stages in a row, each written as Parquet and read again by the next.

1. language ID: texts whose predicted language isn't wanted (``WANTED``: English, the language of the
   benchmark and of the vocabulary) go, and so do those that aren't in the language predicted for them.
2. near-dedup: of each group of near copies, one row with the smallest id stays.
3. decontamination: documents that hold a benchmark passage go.
4. secrets: reported spans give way to marks of their kind.
5. BPE: the texts that are left, as token ids and decoded text.

Defined results: null, empty and wordless texts have no language and go with the first stage; where
no row has a language label, all do. A null doc_id counts as larger than others when a component's
first row is looked for; rows are told apart by id and text, so no row goes or stays because another
has its id. Of rows equal in both one stays. An empty table gives an empty result. Stages read doc_id,
text and lang only; other columns, whatever their names, pass all stages but the last, n_chars with
the length of a masked text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language, near_dedup, secrets
from tessera.llm.shared import cut

#: Languages whose documents go on.
WANTED = ("en",)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_only(docs, language.train(docs), wanted=WANTED)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by id and text: components are those of texts, by their hash, and one row
    of the first id and text of a component stays. Texts without a word are in no component."""
    has_word = F.coalesce(F.col("text").rlike(r"[^\x09-\x0d ]"), F.lit(False))
    texts, key = docs.where(has_word).alias("docs"), F.xxhash64("docs.text")
    thin = texts.select("docs.doc_id", key.alias("text_key"))
    places = near_dedup.near_components(texts.select(key.alias("doc_id"), "docs.text")).select(F.col("doc_id").alias("text_key"), "component_id").distinct()
    least = thin.groupBy("text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("id"))
    first = least.join(places, "text_key").groupBy("component_id").agg(F.min(F.struct("id", "text_key")).alias("f")).select(F.col("f.id.doc_id").alias("doc_id"), F.col("f.text_key").alias("text_key"))
    # Rows equal in id and text differ in other columns at most; any of them stays for all.
    kept = texts.join(first.alias("first"), (key == F.col("first.text_key")) & F.col("docs.doc_id").eqNullSafe(F.col("first.doc_id")), "left_semi")
    one = kept.dropDuplicates(["doc_id", "text"])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(docs.where(~has_word))


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_only(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontamination", decontaminate_documents),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs

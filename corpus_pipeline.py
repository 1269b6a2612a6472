"""From raw documents to packed training sequences: quality, near-duplicates, repeated passages, leaks, packing.

Every stage works on all rows it is given and, but for the last, returns their columns as they were, whatever those are called.
Null and empty texts have no words; null ids are kept like any; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, packing, quality, simhash, substrings
from plumbline.llm.common import remove, shared_dir
from plumbline.llm.queries import tokenizer_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the hard limits or are anomalies go: null, empty and very short texts among them.  Repeated rows are
    judged alike.  Without labels only the hard limits hold."""
    return quality.keep(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id; a null id counts as larger than any.  Texts without
    words are copies of each other, and so are rows that repeat an id and text."""
    return simhash.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that start anywhere else are cut out; a document of which nothing is left goes.  A text without words has
    nothing to lose, and stays.  Rows that repeat a text of over 34 words lose it, each of them."""
    before, removed, digest = ("_" * 24 + x for x in ("before", "removed", "digest"))  # names of no other column
    cleaned = substrings.remove_repeats(docs, names=(before, removed, digest))
    changed = F.col(removed) > 0
    left = cleaned.where(~changed | (F.col(removed) < F.col(before)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; items without words match nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, sources mixed in every window; a null source is one of its own, a text without words the end
    token alone, and repeated rows are packed as often as they occur."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("passages", drop_repeated_passages),
    ("leaks", drop_leaks),
    ("packing", pack),
]

#: Fingerprints, forests and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    before = None
    for i, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            remove(spark, before)
        before = at
    return docs

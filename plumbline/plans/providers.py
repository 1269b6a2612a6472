"""What models supply: labels of text pairs, vectors of answers, generated answers.

A provider is a function over Arrow batches; it is asked only for what a table doesn't hold already, and its
results are meant to be appended to that table.  Nothing here loads a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import entailment_label
from plumbline.operators.pairs import missing_pairs
from plumbline.sources.answers import append_cache, read_cache

Labeller = Callable[[list[str], list[str], list[str]], list[tuple[int, float]]]
Generator = Callable[[list[list[dict]], int], list[list[str]]]


def label_missing(sets: DataFrame, cache: DataFrame, labeller: Labeller, batch: int = 64, where: Column | None = None) -> DataFrame:
    """New cache rows: each distinct pair without a label is asked once, as ``labeller(questions, texts1, texts2)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                own = b.slice(i, batch)
                found = labeller(*(own.column(c).to_pylist() for c in ("question", "text1", "text2")))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("question", "text1", "text2")), pa.array([int(x) for x, _ in found], pa.int8()), pa.array([float(y) for _, y in found])], ["question", "text1", "text2", "label", "confidence"])

    asked = missing_pairs(sets, cache)
    return (asked if where is None else asked.where(where)).mapInArrow(run, "question string, text1 string, text2 string, label tinyint, confidence double")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def cache_for(sets: DataFrame, path: str, labeller: Labeller | None = None, steps: int = 1) -> DataFrame:
    """The label cache at ``path``.  One that exists is used as it is, so that a pair it lacks is an error; one that does
    not is built by asking for every pair, in ``steps`` portions, each saved before the next is asked for."""
    spark = sets.sparkSession
    if not _exists(spark, path):
        if labeller is None:
            raise FileNotFoundError(path)
        none = spark.createDataFrame([], "question string, text1 string, text2 string, label tinyint, confidence double")
        for k in range(steps):
            rows = label_missing(sets, none, labeller, where=F.pmod(F.xxhash64("question", "text1", "text2"), F.lit(steps)) == k)
            append_cache(rows, path)
    return read_cache(spark, path)


def labels_from_replies(replies: DataFrame) -> DataFrame:
    """``(question, text1, text2, reply)`` -> cache rows with confidence 1."""
    return replies.select("question", "text1", "text2", entailment_label(F.col("reply")).cast("tinyint").alias("label"), F.lit(1.0).alias("confidence"))


def generate(prompts: DataFrame, generator: Generator, repeat: int = 10, batch: int = 16) -> DataFrame:
    """``prompts(qid, question, messages)`` -> answer sets of ``repeat`` answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, batch):
                own = b.slice(i, batch)
                answers = generator(own.column("messages").to_pylist(), repeat)
                yield pa.RecordBatch.from_arrays([own.column("qid"), own.column("question"), pa.array(answers, pa.list_(pa.string()))], ["qid", "question", "answers"])

    return prompts.select("qid", "question", "messages").mapInArrow(run, f"qid {prompts.schema['qid'].dataType.simpleString()}, question string, answers array<string>")


def encode(sets: DataFrame, encoder: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """``(qid, vectors)`` of the answers of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers = b.column("answers").to_pylist()
            flat = encoder([t for own in answers for t in own])
            ends, out = 0, []
            for own in answers:
                out.append([[float(x) for x in v] for v in flat[ends : ends + len(own)]])
                ends += len(own)
            yield pa.RecordBatch.from_arrays([b.column("qid"), pa.array(out, pa.list_(pa.list_(pa.float32())))], ["qid", "vectors"])

    return sets.select("qid", "answers").mapInArrow(run, f"qid {sets.schema['qid'].dataType.simpleString()}, vectors array<array<float>>")

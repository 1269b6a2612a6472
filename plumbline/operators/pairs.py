"""Answer sets, their pairs, and the labels of the pairs.

An answer set is a row ``(qid, question, answers)``.  Labels come from a cache table
``(question, text1, text2, label, confidence)``; label 0 is contradiction, 1 neutral, 2 entailment.  A set has
few answers (about ten), so its pairs are handled in its own row: one grouping by qid after the lookup, and
every score after that is a projection over two small matrices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import let

#: What identical texts count as, and what a missing label does where misses are allowed.
SAME = (2, 0.999)
MISSING = (0, 0.0)


def answer_sets(rows: DataFrame, qid: str, text: str, order: list[str], most: int | None = None, question: Column | None = None) -> DataFrame:
    """Collect one row per answer into ``(qid, question, answers)``, ordered, the first ``most`` of each."""
    rows = rows.select(F.col(qid).alias("qid"), F.col(text).cast("string").alias("t"), F.struct(*order).alias("o"))
    if most is not None:
        rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("o"))).where(F.col("k") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("o", F.coalesce("t", F.lit("")).alias("t"))))
    sets = rows.groupBy("qid").agg(F.transform(ordered, lambda x: x["t"]).alias("answers"))
    return sets.select("qid", (question if question is not None else F.lit("")).alias("question"), "answers")


def flatten(sets: DataFrame) -> DataFrame:
    """One row per answer: ``(qid, ordinal, answer)``."""
    return sets.select("qid", F.posexplode("answers").alias("ordinal", "answer"))


def text_pairs(sets: DataFrame) -> DataFrame:
    """Distinct ordered pairs of different texts of each set: ``(qid, question, text1, text2)``."""
    distinct = F.array_distinct("answers")
    one = sets.select("qid", "question", distinct.alias("d"), F.explode(distinct).alias("text1"))
    return one.select("qid", "question", "text1", F.explode(F.filter("d", lambda x: x != F.col("text1"))).alias("text2"))


def _texts() -> Column:
    return F.array_compact(F.array_distinct("answers"))


def _placed_pairs(sets: DataFrame) -> DataFrame:
    """``text_pairs`` with both texts' places among the set's distinct texts: ``(qid, question, text1, text2, i, j)``."""
    one = sets.select("qid", "question", _texts().alias("d")).select("*", F.posexplode("d").alias("i", "text1"))
    return one.select("qid", "question", "text1", "i", F.posexplode("d").alias("j", "text2")).where("i <> j")


def missing_pairs(sets: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct ``(question, text1, text2)`` without a label: what a provider is asked for."""
    keys = ["question", "text1", "text2"]
    return text_pairs(sets).select(*keys).distinct().join(cache.select(*keys), keys, "left_anti")


def label_matrices(sets: DataFrame, cache: DataFrame, strict_cache: bool = True) -> DataFrame:
    """``(qid, question, answers, labels, confidences)``: for answers i and j the label and confidence of i against j.

    Identical texts need no entry.  A pair without one raises an error, or counts as ``MISSING`` if not ``strict_cache``.
    """
    keys = ["question", "text1", "text2"]
    known = cache.select(*keys, F.col("label").cast("int").alias("label"), F.col("confidence").cast("double").alias("confidence"))
    found = _placed_pairs(sets).join(known, keys, "left")
    if strict_cache:
        found = found.withColumn("label", F.when(F.col("label").isNull(), F.raise_error(F.concat(F.lit("no label for: "), F.col("text1"), F.lit(" / "), F.col("text2"))).cast("int")).otherwise(F.col("label")))
    else:
        found = found.withColumns({"label": F.coalesce("label", F.lit(MISSING[0])), "confidence": F.coalesce("confidence", F.lit(MISSING[1]))})
    # Sorted by both places, a set's entries are its distinct texts' matrix without the diagonal: cells are found by place.
    entries = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "j", "label", "confidence"))).alias("e"))
    texts = _texts()
    placed = sets.join(entries, "qid", "left").select("*", F.size(texts).alias("n"), let(texts, lambda d: F.transform("answers", lambda a: (F.array_position(d, a) - 1).cast("int"))).alias("at"))
    whole = F.coalesce(F.size("e"), F.lit(0)) == F.col("n") * (F.col("n") - 1)
    placed = placed.withColumn("e", F.when(whole, F.col("e")).otherwise(F.raise_error(F.concat(F.lit("several labels of one pair, or sets of one qid: "), F.col("qid").cast("string")))))

    def matrix(field: str, same: float, kind: str) -> Column:
        def cell(values: Column, i: Column, j: Column) -> Column:
            return F.when(i == j, F.lit(same).cast(kind)).otherwise(F.get(values, i * (F.col("n") - 1) + j - F.when(j > i, 1).otherwise(0)))

        return let(F.col("e")[field].cast(f"array<{kind}>"), lambda v: F.transform("at", lambda i: F.transform("at", lambda j: cell(v, i, j))))

    return placed.select("qid", "question", "answers", matrix("label", SAME[0], "int").alias("labels"), matrix("confidence", SAME[1], "double").alias("confidences"))


def size(matrix: Column | str) -> Column:
    return F.size(matrix)


def indices(n: Column) -> Column:
    """0 .. n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def at(matrix: Column, i: Column, j: Column) -> Column:
    return F.get(F.get(matrix, i), j)


def build(n: Column, cell) -> Column:
    """The n x n matrix of ``cell(i, j)``."""
    return F.transform(indices(n), lambda i: F.transform(indices(n), lambda j: cell(i, j)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return let(values, lambda v: F.when(F.size(v) > 0, total(v) / F.size(v)))

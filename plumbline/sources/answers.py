"""Answer sets and label caches: JSON or Parquet in, JSON or Parquet out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.documents import read_elements, write_document
from plumbline.sources.schemas import NLI_CACHE


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, question, answers, story_id, turn_id, ordinal)`` of answer-set files.

    A single answer may be a bare string instead of an array, and ``question_id`` may stand for ``qid``; ``ordinal``
    is the place in the file, which decides between rows that repeat a question.
    """
    rows = read_elements(spark, path, "answers").select("ordinal", F.from_json("element", "qid string, question_id string, question string, answers variant, story_id string, turn_id int").alias("a"))
    kind = F.schema_of_variant("a.answers")
    many = F.try_variant_get("a.answers", "$", "array<string>")
    one = F.array(F.try_variant_get("a.answers", "$", "string"))
    answers = F.when(kind.startswith("ARRAY"), many).when(F.col("a.answers").isNotNull() & (kind != "VOID"), one).otherwise(F.array().cast("array<string>"))
    return rows.select(F.coalesce("a.qid", "a.question_id").alias("qid"), "a.question", answers.alias("answers"), "a.story_id", "a.turn_id", "ordinal")


def write_answers(sets: DataFrame, path: str, arguments: dict[str, object] | None = None) -> None:
    """Answer sets as one document, in the order of ``ordinal`` where there is one, with the arguments under the key that readers of
    the format expect."""
    options = json.dumps({k: str(v) for k, v in (arguments or {}).items()}, ensure_ascii=False)
    order = ["ordinal"] if "ordinal" in sets.columns else None
    element = F.to_json(F.struct(*[c for c in ("qid", "question", "answers", "story_id", "turn_id") if c in sets.columns])).alias("element")
    write_document(sets.select(element, *(order or [])), path, f'{{"generaion_args": {options}, "answers": [', "]}", order)


def write_scores(scores: DataFrame, path: str) -> None:
    """Score rows as one list document, in the order of qid."""
    write_document(scores.select("qid", F.to_json(F.struct(*scores.columns)).alias("element")), path, order=["qid"])


def write_qa_report(report: DataFrame, quality: DataFrame, path: str) -> None:
    """One document: the report's averages, and under ``per_question_accuracy`` each question's quality (see ``per_question``)."""
    head = report.select(F.to_json(F.struct(*report.columns)).alias("j")).first()["j"]  # one row
    value = F.to_json("quality") if quality.schema["quality"].dataType.typeName() == "struct" else F.col("quality").cast("string")
    element = F.concat(F.regexp_extract(F.to_json(F.struct(F.col("qid").cast("string").alias("q"))), r'(?s)^\{"q":(.*)\}$', 1), F.lit(": "), value)
    write_document(quality.select("qid", element.alias("element")), path, head.rstrip()[:-1] + ', "per_question_accuracy": {', "}}", ["qid"])


def write_uq_report(ranking: DataFrame, path: str, single: bool = False) -> None:
    """One document of a ranking report (a row a column and measure).  With ``single`` the one score's measures have plain names."""
    name = F.when(F.col("metric") == "matched", F.lit("Number of matched questions")).otherwise(F.upper("metric") if single else F.concat_ws("_", "uq_column", "metric"))
    rows = ranking.groupBy(name.alias("name")).agg(F.max("value").alias("value"))
    element = F.concat(F.lit('"'), "name", F.lit('": '), F.when(F.col("name") == "Number of matched questions", F.col("value").cast("long").cast("string")).otherwise(F.coalesce(F.col("value").cast("string"), F.lit("null"))))
    write_document(rows.select("name", element.alias("element")), path, "{", "}", ["name"])


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The label cache; of entries that repeat a key the largest label stands, so that the result is defined."""
    rows = spark.read.schema(NLI_CACHE).parquet(path)
    keys = ["question", "text1", "text2"]
    return rows.groupBy(*keys).agg(F.max(F.struct("label", "confidence")).alias("v")).select(*keys, "v.*")


def append_cache(rows: DataFrame, path: str) -> None:
    """Append new labels; keys are made unique on reading."""
    rows.select("question", "text1", "text2", F.col("label").cast("tinyint"), F.col("confidence").cast("double")).write.mode("append").parquet(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Score or report rows as JSON lines, UTF-8 as they are."""
    rows.write.mode("overwrite").json(path)

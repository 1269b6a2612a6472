"""Gold references of the known data sets as ``(qid, question, context, refs)`` or ``(qid, question, gold)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.numeric import gold_answer
from plumbline.functions.text import normalize_answer, remove_extra_spaces
from plumbline.sources import schemas
from plumbline.sources.documents import read_elements



def _elements(spark: SparkSession, path: str | list[str], key: str | None, schema: str) -> DataFrame:
    return read_elements(spark, path, key).select(F.from_json("element", schema).alias("q")).select("q.*")


def _normal(refs: Column) -> Column:
    return F.transform(refs, normalize_answer)


def trivia(spark: SparkSession, path: str) -> DataFrame:
    """Aliases as they are, human answers normalised."""
    q = _elements(spark, path, "Data", schemas.TRIVIA)
    refs = F.array_distinct(F.concat(F.coalesce("Answer.NormalizedAliases", F.array()), _normal(F.coalesce("Answer.HumanAnswers", F.array()))))
    return q.select(F.col("QuestionId").alias("qid"), F.col("Question").alias("question"), F.lit("").alias("context"), refs.alias("refs"))


def coqa(spark: SparkSession, path: str) -> DataFrame:
    """One row per turn; the first answer of the same turn is gold; ``qid`` is story/turn."""
    stories = _elements(spark, path, "data", schemas.COQA)
    turns = stories.select("id", "story", "answers", F.explode("questions").alias("q"))
    gold = F.get(F.filter("answers", lambda a: a["turn_id"] == F.col("q.turn_id")), F.lit(0))
    refs = F.array_distinct(_normal(F.array_compact(F.array(gold["input_text"], gold["span_text"]))))
    return turns.select(F.concat_ws("/", "id", F.col("q.turn_id").cast("string")).alias("qid"), F.col("q.input_text").alias("question"), F.col("story").alias("context"), refs.alias("refs"))


def squad(spark: SparkSession, path: str) -> DataFrame:
    """Questions without an answer are left out."""
    p = _elements(spark, path, "data", schemas.SQUAD).select(F.explode("paragraphs").alias("p"))
    q = p.select("p.context", F.explode("p.qas").alias("q")).where(F.size("q.answers") > 0)
    return q.select(F.col("q.id").alias("qid"), F.col("q.question").alias("question"), "context", F.array_distinct(_normal(F.col("q.answers.text"))).alias("refs"))


def bioasq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union of several files; exact answers are strings, lists, or lists of lists."""
    q = _elements(spark, paths, "questions", schemas.BIOASQ)
    exact = F.col("exact_answer")
    deep, flat, one = F.flatten(F.try_variant_get(exact, "$", "array<array<string>>")), F.try_variant_get(exact, "$", "array<string>"), F.try_variant_get(exact, "$", "string")
    items = F.try_variant_get(exact, "$", "array<variant>")
    mixed = F.flatten(F.transform(items, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string")))))
    kind = F.coalesce(F.schema_of_variant(exact), F.lit("VOID"))
    found = F.when(kind.startswith("ARRAY"), F.coalesce(mixed, deep, flat)).when(kind != "VOID", F.array(one)).otherwise(F.array().cast("array<string>"))
    refs = _normal(F.array_distinct(F.array_compact(F.concat(F.coalesce("ideal_answer", F.array().cast("array<string>")), F.coalesce(found, F.array().cast("array<string>"))))))
    return q.select(F.col("id").alias("qid"), F.col("body").alias("question"), F.lit("").alias("context"), refs.alias("refs"))


def natural_questions(df: DataFrame) -> DataFrame:
    """Rows of the columnar format to ``(qid, question, context, refs, long_answers, candidates)``.

    Text is joined from the tokens that are no markup; a long answer that starts at -1 is null; short answers that
    are not empty, normalised and distinct, are the references; rows without any are left out.
    """
    tokens = F.arrays_zip(F.col("document.tokens.token").alias("token"), F.col("document.tokens.is_html").alias("is_html"))

    def span(start: Column, end: Column) -> Column:
        part = F.slice(tokens, start + 1, F.greatest(end - start, F.lit(0)))
        return remove_extra_spaces(F.array_join(F.transform(F.filter(part, lambda x: ~x["is_html"]), lambda x: x["token"]), " "))

    long_answers = F.transform("annotations.long_answer", lambda a: F.when(a["start_token"] != -1, span(a["start_token"], a["end_token"])))
    candidates = F.transform(
        F.arrays_zip(F.col("long_answer_candidates.start_token").alias("s"), F.col("long_answer_candidates.end_token").alias("e"), F.col("long_answer_candidates.top_level").alias("t")),
        lambda c: F.struct(span(c["s"], c["e"]).alias("text"), c["t"].alias("top_level")),
    )
    short = F.filter(F.flatten(F.transform("annotations.short_answers", lambda a: a["text"])), lambda r: r.isNotNull() & (r != ""))
    whole = remove_extra_spaces(F.array_join(F.transform(F.filter(tokens, lambda x: ~x["is_html"]), lambda x: x["token"]), " "))
    rows = df.select(F.col("id").alias("qid"), F.col("question.text").alias("question"), whole.alias("context"), F.array_distinct(_normal(short)).alias("refs"), long_answers.alias("long_answers"), candidates.alias("candidates"))
    return rows.where(F.size("refs") > 0)


def svamp(spark: SparkSession, path: str) -> DataFrame:
    df = _elements(spark, path, None, schemas.SVAMP)
    return df.select(F.col("ID").alias("qid"), F.concat_ws("\n", "Body", "Question").alias("question"), F.col("Answer").cast("double").alias("gold"))


def gsm8k(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``df(question, answer[, idx])`` with a stored row number: the explicit ``idx`` is the id where there is one."""
    qid = F.coalesce(F.col("idx").cast("string"), F.col(ordinal).cast("string")) if "idx" in df.columns else F.col(ordinal).cast("string")
    return df.select(qid.alias("qid"), "question", gold_answer(F.col("answer")).alias("gold"))


#: Input and reference columns of the summary data sets.
SUMMARIES = {"xsum": ("document", "summary"), "aeslc": ("email_body", "subject_line"), "cnn_dailymail": ("article", "highlights"), "multi_news": ("document", "summary")}


def summaries(df: DataFrame, dataset: str, ordinal: str = "ordinal") -> DataFrame:
    """The id is the row's own where there is one, else its stored number."""
    source, target = SUMMARIES[dataset]
    qid = F.coalesce(F.col("id").cast("string"), F.col(ordinal).cast("string")) if "id" in df.columns and dataset != "multi_news" else F.col(ordinal).cast("string")
    return df.select(qid.alias("qid"), F.col(source).alias("question"), F.lit("").alias("context"), F.array(target).alias("refs"))


def translations(df: DataFrame, subset: str = "cs-en", ordinal: str = "ordinal") -> DataFrame:
    """``df(translation struct<...>)``; ``subset`` is source-target."""
    if "-" not in subset:
        raise ValueError(f"not a language pair: {subset}")
    source, target = subset.split("-", 1)
    return df.select(F.col(ordinal).cast("string").alias("qid"), F.col("translation")[source].alias("question"), F.lit("").alias("context"), F.array(F.col("translation")[target]).alias("refs"))


def with_ordinal(df: DataFrame, order: list[str]) -> DataFrame:
    """Number the rows from 0 in a stated order, at ingest, without gathering them in one task: a running count over
    range partitions, offset by the sizes of those before."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    numbered = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = numbered.groupBy("_part").count()
    starts = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_start"))  # one row a partition
    return numbered.join(starts, "_part").withColumn("ordinal", F.col("_start") + F.col("_at") - 1).drop("_part", "_at", "_start")

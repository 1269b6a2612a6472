"""Answer quality by data set, and how well scores rank it: one plan for three families of measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import joins, ranking, reports
from plumbline.plans.score import KERNEL_NAMES

TEXT = ("triviaqa", "coqa", "squad", "bioasq", "nq")
NUMBER = ("svamp", "gsm8k")
GENERATION = ("xsum", "aeslc", "cnn_dailymail", "multi_news", "wmt19")
DATASETS = (*TEXT, *NUMBER, *GENERATION)


def family(dataset: str) -> str:
    name = {"trivia": "triviaqa"}.get(dataset, dataset)
    for kind, names in (("text", TEXT), ("number", NUMBER), ("generation", GENERATION)):
        if name in names or kind == "generation" and name.startswith("wmt19"):
            return kind
    raise ValueError(f"unknown data set {dataset}; known: {', '.join(DATASETS)}")


def is_conservative(model: str) -> bool:
    """Whether a model's worked answers are read conservatively, by its name."""
    return any(name in model.lower() for name in ("gpt4o", "gpt-4o"))


def quality(gold: DataFrame, answers: DataFrame, dataset: str, conservative: bool | None = None, model: str = "") -> DataFrame:
    """Quality of each question that has both gold and answers; the last answer set of a question counts.  ``conservative``
    follows from the model's name where it is not given."""
    conservative = is_conservative(model) if conservative is None else conservative
    kind = family(dataset)
    rows = joins.last_answers(gold, answers.select("qid", "answers", "ordinal"))
    if kind == "text":
        return reports.text_quality(rows)
    if kind == "number":
        return reports.numeric_quality(rows, worked=dataset == "gsm8k", conservative=conservative)
    return reports.generation_quality(rows)


def report(found: DataFrame, dataset: str, gold: DataFrame | None = None, direction: str | None = None) -> DataFrame:
    """Averages over all questions; of translations, with their ``gold(qid, refs)``, also BLEU over the corpus and the direction,
    which the data set's name may end with."""
    if family(dataset) != "generation":
        return reports.qa_report(found)
    out = reports.generation_report(found)
    if not dataset.startswith("wmt19") or gold is None:
        return out
    named = dataset.removeprefix("wmt19").lstrip("_-")
    normal = gold.select("qid", F.array(T.normalize_answer(F.get("refs", F.lit(0)))).alias("refs"))
    pairs = found.select("qid", "prediction").join(normal, "qid")
    both = out.withColumn("_one", F.lit(1)).join(reports.corpus_bleu(pairs).withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each
    return both.withColumn("translation_direction", F.lit(direction or named or "cs-en"))


#: The fields of the consistency triplet, which are confidences.
CONSISTENCY = ("exact_match", "bert_score", "cosine_sim")


def long_scores(scores: DataFrame, method: str = "", columns: list[str] | None = None, confidence: bool = False, wanted: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Scores as ``(qid, uq_column, uq)``, and which columns are reported.

    Given ``columns`` are taken as they are.  Else the method decides: the consistency triplet's fields turned round, the kernel
    method's whole map, the fields of a graph method that begin with U or C, and of others one score, looked
    for under ``wanted`` and then under the usual names.  Without a method the form of the table decides.
    """
    spark, kinds = scores.sparkSession, dict(scores.dtypes)
    if _is_map(scores, method, columns):
        long = scores.where("entropies is not null").select("qid", F.explode("entropies").alias("uq_column", "uq"))
        return long, long.select("uq_column").distinct()
    if columns is None:
        graph = ranking.score_columns(scores)
        triplet = [c for c in CONSISTENCY if c in kinds]
        if method == "consistency_triplet" or not method and len(triplet) == len(CONSISTENCY):
            columns, confidence = triplet, True
        elif "gwc" in method or not method and graph:
            columns = graph
        else:
            name = wanted or method or "uq"
            methods = tuple(m for m in ranking.CANDIDATES if m in method)
            one = scores.select("qid", ranking.resolve_score(scores.drop("ordinal"), name, methods).alias(name))
            return ranking.unpivot(one, [name]), spark.createDataFrame([(name,)], "uq_column string")
    return ranking.unpivot(scores, columns, confidence), spark.createDataFrame([(c,) for c in columns], "uq_column string")


def _is_map(scores: DataFrame, method: str, columns: list[str] | None) -> bool:
    return columns is None and (method == "kle" or not method and dict(scores.dtypes).get("entropies", "").startswith("map"))


def rank_scores(
    found: DataFrame, scores: DataFrame, dataset: str, columns: list[str] | None = None, confidence: bool = False, method: str = "", wanted: str | None = None, decimals: int | None = None
) -> DataFrame:
    """The ranking report of the scores (see ``long_scores``): PRR for generation, AUROC else.  ``decimals``: the scores of the kernel
    method's map are rounded to so many first."""
    continuous = family(dataset) == "generation"
    q = found.select("qid", (F.col("rouge_l") if continuous else F.col("accuracy").cast("double")).alias("quality"))
    if "ordinal" in scores.columns:
        scores = joins.first_scores(q.select("qid"), scores)
    if _is_map(scores, method, columns):
        return ranking.evaluate_maps(scores, "entropies", q, continuous, KERNEL_NAMES, decimals)
    long, asked = long_scores(scores, method, columns, confidence, wanted)
    return ranking.evaluate_long(long, q, continuous, asked)


def explode_entropies(kernel: DataFrame) -> DataFrame:
    """The kernel method's map as ``(qid, uq_column, uq)``."""
    return long_scores(kernel, "kle")[0]


def run(gold: DataFrame, answers: DataFrame, dataset: str, scores: DataFrame | None = None, columns: list[str] | None = None, task: str = "both", method: str = "", direction: str | None = None, decimals: int | None = None, **options) -> dict[str, DataFrame]:
    """``task`` is qa, uq or both; returns the quality by question, its report, and the ranking report."""
    if task not in ("qa", "uq", "both"):
        raise ValueError(task)
    found = quality(gold, answers, dataset, **options)
    out = {"quality": found}
    if task != "uq":
        out["report"] = report(found, dataset, gold, direction)
    if task != "qa":
        out["ranking"] = rank_scores(found, scores, dataset, columns, method=method, decimals=decimals)
    return out

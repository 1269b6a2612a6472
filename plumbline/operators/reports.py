"""Answer quality by question, and reports over all questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import numeric as N
from plumbline.functions import text as T
from plumbline.operators.votes import numeric_majority, prediction


def text_quality(df: DataFrame) -> DataFrame:
    """``df(qid, answers, refs)`` -> ``(qid, prediction, exact_match, f1, rouge_l, accuracy)``, each the best over the references."""
    rows = df.select("qid", prediction(F.col("answers")).alias("prediction"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    p, refs = F.col("prediction"), F.col("refs")
    em = T.best(refs, lambda r: T.exact_match(p, r).cast("double")).cast("int")
    return rows.select("qid", "prediction", em.alias("exact_match"), T.best(refs, lambda r: T.token_f1(p, r)).alias("f1"), T.best(refs, lambda r: T.rouge_l(p, r)).alias("rouge_l"), em.alias("accuracy"))


def numeric_quality(df: DataFrame, worked: bool, tolerance: float | None = None, conservative: bool = False) -> DataFrame:
    """``df(qid, answers, gold)`` -> ``(qid, prediction, accuracy)``; ``worked`` answers end in a final answer, others are numbers."""
    read = (lambda a: N.final_answer(a, conservative)) if worked else (lambda a: N.to_number(a))
    rows = df.select("qid", numeric_majority(F.transform("answers", read)).alias("prediction"), "gold")
    right = N.close_enough(F.col("prediction"), F.col("gold"), tolerance if tolerance is not None else 1e-6 if worked else 0.1)
    return rows.select("qid", "prediction", right.alias("accuracy"))


def generation_quality(df: DataFrame) -> DataFrame:
    """``df(qid, answers, refs)`` -> ``(qid, prediction, rouge_1, rouge_2, rouge_l, bleu)`` in percent, best over the references
    that are not empty; questions without any are left out."""
    rows = df.select("qid", prediction(F.col("answers")).alias("prediction"), F.filter("refs", lambda r: r.isNotNull() & (r != "")).alias("refs")).where(F.size("refs") > 0)
    p, refs = F.col("prediction"), F.col("refs")
    return rows.select(
        "qid", "prediction", *[(100 * T.best(refs, measure)).alias(name) for name, measure in (("rouge_1", lambda r: T.rouge_n(p, r, 1)), ("rouge_2", lambda r: T.rouge_n(p, r, 2)), ("rouge_l", lambda r: T.rouge_l(p, r)))], (100 * T.sentence_bleu(p, refs)).alias("bleu")
    )


def qa_report(quality: DataFrame) -> DataFrame:
    """Averages in percent over all questions, zeros for none.  What a numeric task does not measure equals its accuracy."""
    names = [c if c in quality.columns else "accuracy" for c in ("exact_match", "f1", "accuracy", "rouge_l")]
    out = [F.coalesce(100 * F.avg(c), F.lit(0.0)).alias(f"average_{c2}") for c, c2 in zip(names, ("exact_match", "f1", "accuracy", "rougel"), strict=True)]
    return quality.agg(*out, F.count(F.lit(1)).alias("number_of_questions"))


def generation_report(quality: DataFrame) -> DataFrame:
    return quality.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"average_{c}") for c in ("rouge_1", "rouge_2", "rouge_l", "bleu")], F.count(F.lit(1)).alias("number_of_questions"))


def corpus_bleu(df: DataFrame) -> DataFrame:
    """``df(prediction, refs)`` -> one row ``corpus_bleu`` in percent: counts pooled over all rows, empty references included."""
    a, refs = T.split_words(F.col("prediction")), F.transform("refs", T.split_words)
    counts = [T.clipped(a, refs, n).alias(f"h{n}") for n in (1, 2, 3, 4)] + [F.greatest(F.size(a) - n + 1, F.lit(0)).alias(f"t{n}") for n in (1, 2, 3, 4)]
    sums = df.select(*counts, F.size(a).alias("c"), F.coalesce(T.closest_length(a, refs), F.lit(0)).alias("r")).agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("h1", "h2", "h3", "h4", "t1", "t2", "t3", "t4", "c", "r")])
    return sums.select((100 * T.bleu_of([F.col(f"h{n}") for n in (1, 2, 3, 4)], [F.col(f"t{n}") for n in (1, 2, 3, 4)], F.col("c"), F.col("r"))).alias("corpus_bleu"))


def per_question(quality: DataFrame) -> DataFrame:
    """The map from question to quality, one row a question, as two columns: ``qid`` and a struct or number."""
    rest = [c for c in quality.columns if c not in ("qid", "prediction")]
    return quality.select("qid", F.col("accuracy").alias("quality") if "accuracy" in rest else F.struct(*rest).alias("quality"))

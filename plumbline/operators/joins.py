"""Joins of gold references, answers, qualities and scores by question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _one(df: DataFrame, key: str, ordinal: str, last: bool) -> DataFrame:
    pick = (F.max_by if last else F.min_by)(F.struct(*[c for c in df.columns if c != key]), F.col(ordinal))
    return df.groupBy(key).agg(pick.alias("_row")).select(key, "_row.*")


def last_answers(gold: DataFrame, answers: DataFrame, key: str = "qid", ordinal: str = "ordinal") -> DataFrame:
    """Inner join; of several answer sets of a question the last counts.  Questions without answers drop out."""
    return gold.join(_one(answers, key, ordinal, True).drop(ordinal), key)


def first_scores(quality: DataFrame, scores: DataFrame, key: str = "qid", ordinal: str = "ordinal") -> DataFrame:
    """Inner join; of several scores of a question the first counts."""
    return quality.join(_one(scores, key, ordinal, False).drop(ordinal), key)

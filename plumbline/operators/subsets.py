"""Confident failures: bad answers whose uncertainty is among the lowest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranking import exact_percentile
from plumbline.operators.stored import stored


def _judged(df: DataFrame, continuous: bool, uq_share: float, bad_share: float, by: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    """Rows with their group's thresholds, whether they are bad, and whether they are selected."""
    df = stored(df.select(*by, "qid", "uq", "quality").withColumn("_one", F.lit(1)))
    group = ("_one", *by)
    cuts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    for column, share, name in (("uq", uq_share, "uq_threshold"), ("quality", bad_share, "quality_threshold")):
        cuts = cuts.join(exact_percentile(df, column, share, group, name), list(group), "left")
    bad = (F.col("quality") <= F.col("quality_threshold")) if continuous else (F.col("quality") == 0)
    rows = df.join(cuts, list(group)).withColumn("is_bad", bad)
    return rows.withColumn("is_selected", F.col("is_bad") & (F.col("uq") <= F.col("uq_threshold"))), group


def confident_failures(df: DataFrame, continuous: bool = False, uq_share: float = 0.2, bad_share: float = 0.25, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``df(by, qid, uq, quality)`` -> one row a group, ``total, bad, uq_threshold, quality_threshold, selected, ratio``, and the
    selected questions as rows ``(by, qid)``.

    Bad is quality 0, or for continuous quality a value in its lowest quarter; selected are bad rows whose
    uncertainty is in the lowest fifth of all.  Thresholds are exact percentiles and inclusive; the two values are
    joined back by group.
    """
    rows, group = _judged(df, continuous, uq_share, bad_share, by)
    n_bad, n_low = F.count_if("is_bad"), F.count_if("is_selected")
    counts = rows.groupBy(*group, "total", "uq_threshold", "quality_threshold").agg(n_bad.alias("bad"), n_low.alias("selected"), F.round(F.when(n_bad > 0, n_low / n_bad), 4).alias("ratio"))
    return counts.drop("_one"), rows.where("is_selected").select(*by, "qid")


def with_ids(counts: DataFrame, selected: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The published form, for a file a group: the counts with an array ``qids`` of all its selected questions."""
    ids = selected.groupBy(F.lit(1).alias("_one"), *by).agg(F.array_sort(F.collect_list(F.col("qid").cast("string"))).alias("qids"))
    joined = counts.withColumn("_one", F.lit(1)).join(ids, ["_one", *by], "left").drop("_one")
    return joined.withColumn("qids", F.coalesce("qids", F.array().cast("array<string>")))

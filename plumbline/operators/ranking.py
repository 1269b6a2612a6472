"""How well an uncertainty ranks quality: area under ROC and accuracy-coverage curves, rejection score.

Input is long: ``(uq_column, qid, uq, quality)``; all columns are ranked in one pass, partitioned by ``uq_column``
(and whatever else ``by`` names), with ties broken by qid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import curves
from plumbline.operators.stored import stored


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType | T.BooleanType)


def numeric_value(df: DataFrame, name: str) -> Column:
    """A score column as a double: an array or matrix of numbers counts as their mean; what is empty, ragged, holds a null or is
    no number (texts in arrays, maps, structs, dates) as NaN.  A text counts if it spells a number."""
    kind, nan = df.schema[name].dataType, F.lit(float("nan"))
    if isinstance(kind, T.ArrayType):
        values, whole = F.col(name), F.lit(True)
        if isinstance(kind.elementType, T.ArrayType):
            kind = kind.elementType
            sizes = F.transform(values, F.size)
            values, whole = F.flatten(values), F.array_max(sizes) == F.array_min(sizes)
        if not _is_number(kind.elementType):
            return nan
        values = F.transform(values, lambda x: x.cast("double"))
        mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)
        return F.coalesce(F.when(whole & (F.size(values) > 0), mean), nan)
    if _is_number(kind) or isinstance(kind, T.StringType):
        return F.coalesce(F.col(name).try_cast("double"), nan)
    return nan


#: Where a score is looked for, by kind of method and then in general, and fields that are never scores.
CANDIDATES = {"luq": ["luq_pair", "luq"], "snne": ["snne"], "semantic_density": ["semantic_density_uncertainty", "semantic_density"]}
GENERAL = ["discrete_semantic_uncertainty", "cluster_assignment_entropy", "entropy"]
NO_SCORES = {
    "qid", "question_id", "semantic_ids", "answers", "predictions", "luq_pair_per_response", "snne_similarity", "snne_variant", "snne_temperature", "snne_self_similarity",
    "luq_bidirectional", "luq_include_neutral", "semantic_density_per_response", "semantic_density_unique_responses", "semantic_density_unique_frequencies", "semantic_density_mean_per_response",
}


def resolve_score(df: DataFrame, wanted: str, methods: tuple[str, ...] = ()) -> Column:
    """The wanted score where it is a number, else the method's usual names, the general ones, and the first numeric field."""
    order = [wanted, *(c for m in CANDIDATES if m in methods for c in CANDIDATES[m]), *GENERAL, *(c for c in df.columns if c not in NO_SCORES)]
    found = [numeric_value(df, c) for c in dict.fromkeys(order) if c in df.columns]
    return F.coalesce(*[F.when(~F.isnan(v), v) for v in found]) if found else F.lit(None).cast("double")


def unpivot(df: DataFrame, columns: list[str], invert: bool = False) -> DataFrame:
    """Wide scores to ``(qid, uq_column, uq)``; ``invert`` turns confidences into uncertainties (1 - x)."""
    values = [F.struct(F.lit(c).alias("uq_column"), (1 - numeric_value(df, c) if invert else numeric_value(df, c)).alias("uq")) for c in columns]
    return df.select("qid", F.explode(F.array(*values)).alias("v")).select("qid", "v.*")


def _ranged(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The rows dealt to ranges of ``order``, stored, with the number ``b`` of the range each is in; ties of the leading columns
    are parted by the later ones, so no value's rows need to share a task."""
    return stored(rows.repartitionByRange(*order).withColumn("b", F.spark_partition_id()))


def _before(rows: DataFrame, by: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """Totals of all ranges before each range: one row a group and range."""
    order = Window.partitionBy(*by).orderBy("b")
    totals = rows.groupBy(*by, "b").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    return totals.select(*by, "b", *[(F.sum(k).over(order) - F.col(k)).alias(f"{k}_before") for k in sums])


def _running(rows: DataFrame, by: tuple[str, ...], order: tuple[str, ...], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running totals ``<name>_upto`` over ``order``, this row included: inside ranges, which are tasks of their own, and
    over the ranges' totals."""
    inside = Window.partitionBy(*by, "b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(inside).alias(f"{k}_local") for k, c in sums.items()])
    joined = local.join(_before(rows, by, sums), [*by, "b"])
    return joined.select(*[F.col(c) for c in rows.columns], *[(F.col(f"{k}_before") + F.col(f"{k}_local")).alias(f"{k}_upto") for k in sums])


def _auroc(ranged: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Pairs that a good row wins, from counts of each distinct uncertainty."""
    good = (F.col("quality").cast("int") == 1).cast("long")
    ties = ranged.groupBy(*by, "uq").agg(F.min("b").alias("b"), F.sum(good).alias("p"), F.sum(1 - good).alias("q"))
    rows = _running(ties, by, ("uq",), {"q": F.col("q")})
    p, q = F.sum("p"), F.sum("q")
    lost = F.sum(F.col("p") * (F.col("q_upto") - F.col("q") / 2))  # to bad rows of less uncertainty, ties at half
    return rows.groupBy(*by).agg(F.when((p > 0) & (q > 0), 1 - lost / (p * q)).alias("auroc"))


def rank(df: DataFrame, by: tuple[str, ...] = ("uq_column",)) -> DataFrame:
    """``by, matched, auroc, auarc, prr``: rows without a score are left out.

    ``auroc`` compares the negated uncertainty with quality 1 (as integers), ties at half, null for one class.
    ``auarc`` is the trapezoid area under the running mean of quality over coverage 0 to 1, null for one row.
    ``prr`` is the mean of the running means of min-max normalised quality; where the least and the largest quality are
    equal, but for a relative 1e-5 and an absolute 1e-8, it is 0.5.

    The input is computed once and stored as a narrow table; running sums take two levels, so that one score column of
    any length is not sorted by one task, nor the rows of one hot uncertainty.
    """
    df = df.where(F.col("uq").isNotNull() & ~F.isnan("uq") & F.col("quality").isNotNull()).select(*by, "qid", "uq", F.col("quality").cast("double").alias("quality"))
    ranged = _ranged(stored(df), (*by, "uq", "qid"))
    rows = _running(ranged, by, ("uq", "qid"), {"k": F.lit(1), "s": F.col("quality")})
    rows = rows.select(*by, "quality", F.col("k_upto").alias("k"), (F.col("s_upto") / F.col("k_upto")).alias("m"))
    n, low, high, mean = F.count(F.lit(1)), F.min("quality"), F.max("quality"), F.avg("m")
    curves = rows.groupBy(*by).agg(
        n.alias("matched"),
        F.when(n > 1, (F.sum("m") - (F.min_by("m", "k") + F.max_by("m", "k")) / 2) / (n - 1)).alias("auarc"),
        F.when(F.abs(low - high) > 1e-8 + 1e-5 * F.abs(high), (mean - low) / (high - low)).otherwise(0.5).alias("prr"),
    )
    return curves.join(_auroc(ranged, by), list(by)).select(*by, "matched", "auroc", "auarc", "prr")


def exact_percentile(df: DataFrame, column: str, share: float, by: tuple[str, ...], name: str) -> DataFrame:
    """``by, name``: the linearly interpolated percentile, from counts of distinct values and two-level running counts."""
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("uq"))
    counts = _ranged(rows.groupBy(*by, "uq").agg(F.count(F.lit(1)).alias("n")), (*by, "uq"))
    total = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    h = F.lit(share) * (F.col("total") - 1)
    at = lambda place: F.max(F.when((F.col("n_upto") - F.col("n") <= place) & (place < F.col("n_upto")), F.col("uq")))
    found = _running(counts, by, ("uq",), {"n": F.col("n")}).join(total, list(by)).groupBy(*by, "total").agg(at(F.floor(h)).alias("low"), at(F.ceil(h)).alias("high"))
    return found.select(*by, (F.col("low") + (F.col("high") - F.col("low")) * (h - F.floor(h))).alias(name))


def score_columns(df: DataFrame, prefixes: tuple[str, ...] = ("u_", "c_", "U", "C")) -> list[str]:
    """Score columns by how their names begin, as graph methods name theirs."""
    return [c for c in df.columns if c.startswith(prefixes)]


def evaluate(scores: DataFrame, quality: DataFrame, columns: list[str], invert: bool = False, continuous: bool = False) -> DataFrame:
    """Long report ``(uq_column, metric, value)`` of wide scores: matched questions, AUARC, and PRR for continuous quality or AUROC
    else.  A column that no question with quality has a score in counts 0 matches, and its measures are null."""
    asked = scores.sparkSession.createDataFrame([(c,) for c in columns], "uq_column string")
    return evaluate_long(unpivot(scores, columns, invert), quality, continuous, asked)


def evaluate_long(long: DataFrame, quality: DataFrame, continuous: bool = False, asked: DataFrame | None = None) -> DataFrame:
    """As ``evaluate``, of ``long(qid, uq_column, uq)``; ``asked(uq_column)`` names what is reported in any case."""
    ranked = rank(long.join(quality.select("qid", "quality"), "qid"))
    if asked is not None:
        ranked = asked.join(ranked, "uq_column", "left").fillna({"matched": 0})
    return _measures(ranked, continuous)


def evaluate_maps(scores: DataFrame, column: str, quality: DataFrame, continuous: bool = False, usual: list[str] | None = None, decimals: int | None = None) -> DataFrame:
    """As ``evaluate_long``, of every key of a column of maps (see ``curves.rank_maps``)."""
    return _measures(curves.rank_maps(scores, column, quality.select("qid", "quality"), usual or [], decimals), continuous)


def _measures(ranked: DataFrame, continuous: bool) -> DataFrame:
    main = "prr" if continuous else "auroc"
    cell = lambda m: F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
    return ranked.select("uq_column", F.explode(F.array(cell("matched"), cell(main), cell("auarc"))).alias("x")).select("uq_column", "x.*")


def binary_quality(rouge_l: Column, threshold: float = 50.0) -> Column:
    return (rouge_l >= threshold).cast("int")

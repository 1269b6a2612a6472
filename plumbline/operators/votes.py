"""One prediction from several answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, normalize_answer


def majority(answers: Column, normalize=normalize_answer) -> Column:
    """The most common normalised answer; on any tie for the top, or where that is empty, the first one, normalised; empty
    text for none."""

    def counted(own: Column) -> Column:
        counts = F.transform(F.array_distinct(own), lambda a: F.struct(F.size(F.filter(own, lambda x: x == a)).alias("n"), a.alias("a")))
        return F.struct(own.alias("own"), counts.alias("counts"))

    def chosen(c: Column) -> Column:
        most = F.array_max(F.transform(c["counts"], lambda x: x["n"]))
        tied = let(most, lambda n: F.filter(c["counts"], lambda x: x["n"] == n))
        return let(tied, lambda t: F.when((F.size(t) == 1) & (F.get(t, F.lit(0))["a"] != ""), F.get(t, F.lit(0))["a"]).otherwise(F.get(c["own"], F.lit(0))))

    return F.coalesce(let(let(F.transform(answers, normalize), counted), chosen), F.lit(""))


#: What a question's answers stand for when its quality is measured.
prediction = majority


def numeric_majority(numbers: Column) -> Column:
    """The most common of an array of doubles rounded (half to even) to six places, nulls left out; the first seen on a
    tie; null for none."""

    def of(own: Column) -> Column:
        return F.aggregate(
            F.array_distinct(own),
            F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("v")),
            lambda best, v: let(F.size(F.filter(own, lambda x: x == v)), lambda n: F.when(n > best["n"], F.struct(n.alias("n"), v.alias("v"))).otherwise(best)),
            lambda best: best["v"],
        )

    return let(F.transform(F.array_compact(numbers), lambda x: F.bround(x, 6)), of)

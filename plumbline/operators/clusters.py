"""Semantic clusters of the answers of a set, and their entropy.  Inputs are columns of ``pairs.label_matrices``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.operators.pairs import at, build, indices, let, total


def equivalent(labels: Column, strict: bool = False) -> Column:
    """Boolean matrix.  Strict: both directions entail.  Else: no direction contradicts, and not both are neutral."""

    def cell(m: Column, i: Column, j: Column) -> Column:
        a, b = at(m, i, j), at(m, j, i)
        return (a == 2) & (b == 2) if strict else (a != 0) & (b != 0) & ~((a == 1) & (b == 1))

    return let(labels, lambda m: build(F.size(m), lambda i, j: cell(m, i, j)))


def semantic_ids(labels: Column, strict: bool = False) -> Column:
    """Greedy clusters in answer order.  An answer without a cluster leads a new one, and every later answer that is
    equivalent to it joins, even from an earlier cluster: the last leader wins."""
    return let(equivalent(labels, strict), _greedy)


def _greedy(same: Column) -> Column:
    n = F.size(same)
    start = F.struct(F.array_repeat(F.lit(-1), n).alias("ids"), F.lit(0).alias("next"))

    def lead(state: Column, i: Column) -> Column:
        taken = F.transform(state["ids"], lambda old, j: F.when((j == i) | ((j > i) & at(same, i, j)), state["next"]).otherwise(old))
        free = F.get(state["ids"], i) == -1
        return F.struct(F.when(free, taken).otherwise(state["ids"]).alias("ids"), F.when(free, state["next"] + 1).otherwise(state["next"]).alias("next"))

    return F.aggregate(indices(n), start, lead, lambda s: s["ids"])


def cluster_entropy(ids: Column) -> Column:
    """Natural-log entropy of the clusters' shares; null for no answers."""

    def of(ids: Column) -> Column:
        n = F.size(ids)
        shares = F.transform(F.array_distinct(ids), lambda c: F.size(F.filter(ids, lambda x: x == c)) / n)
        return F.when(n > 0, 0.0 - total(F.transform(shares, lambda p: p * F.log(p))))

    return let(ids, of)

"""Weighted graphs on the answers of a set, and scores that need no eigenvalues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.operators.pairs import at, build, let, total

EPSILON = 1e-10


def label_weights(labels: Column) -> Column:
    """Mean of both directions' labels, halved: 1 where both entail.  The diagonal is looked up like any cell."""
    return let(labels, lambda m: build(F.size(m), lambda i, j: (at(m, i, j) + at(m, j, i)) / 4.0))


def degrees(weights: Column) -> Column:
    return F.transform(weights, total)


def laplacian(weights: Column) -> Column:
    """I - D^-1/2 W D^-1/2, with a small constant added to the degrees."""

    def of(w: Column, d: Column) -> Column:
        return build(F.size(w), lambda i, j: F.when(i == j, 1.0).otherwise(0.0) - at(w, i, j) / F.sqrt((F.get(d, i) + EPSILON) * (F.get(d, j) + EPSILON)))

    return let(weights, lambda w: let(degrees(w), lambda d: of(w, d)))


def u_deg(weights: Column) -> Column:
    return let(weights, lambda w: F.when(F.size(w) > 0, 1.0 - total(degrees(w)) / (F.size(w) * F.size(w))))


def c_deg(weights: Column) -> Column:
    return let(weights, lambda w: F.transform(degrees(w), lambda d: d / F.size(w)))


def complete_edges(labels: Column) -> Column:
    """The unweighted graph: every pair has an edge, whatever its labels."""
    return build(F.size(labels), lambda i, j: F.when(i == j, 0.0).otherwise(1.0))


def label_edges(labels: Column) -> Column:
    """For each direction 1 for entailment and 1/2 for neutral; 0 is no edge."""
    worth = lambda x: F.when(x == 2, 1.0).when(x == 1, 0.5).otherwise(0.0)
    return let(labels, lambda m: build(F.size(m), lambda i, j: F.when(i == j, 0.0).otherwise(worth(at(m, i, j)) + worth(at(m, j, i)))))


def confidence_edges(confidences: Column) -> Column:
    """The sum of both directions' confidences, whatever their labels."""
    return let(confidences, lambda m: build(F.size(m), lambda i, j: F.when(i == j, 0.0).otherwise(at(m, i, j) + at(m, j, i))))

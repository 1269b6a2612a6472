"""Scores from pairwise labels: nearest-neighbour entailment, semantic density, neighbour contrast, consistency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.pairs import at, build, let, mean, total

#: Fixed values of the contrast scores.
EPSILON = 1e-8
VARIANTS = ("full", "only_num", "only_denom", "num_minus_denom")


def _inputs(answers: Column, labels: Column, confidences: Column | None = None) -> Column:
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(as_column(answers).alias("a"), as_column(labels).alias("l"), as_column(labels if confidences is None else confidences).alias("c"))


# --- nearest-neighbour entailment ------------------------------------------------------------------------------


def entailment_similarity(labels: Column, strict: bool = False, neutral: bool = False, both: bool = False) -> Column:
    """1 where i entails j; 1/2 for neutral if ``neutral`` and not ``strict``; the mean of the directions if ``both``."""
    half = 0.5 if neutral and not strict else 0.0
    one = lambda x: F.when(x == 2, 1.0).when(x == 1, half).otherwise(0.0)
    cell = lambda m, i, j: (one(at(m, i, j)) + one(at(m, j, i))) / 2 if both else one(at(m, i, j))
    return let(labels, lambda m: build(F.size(m), lambda i, j: F.when(i == j, 0.0).otherwise(cell(m, i, j))))


def per_response(similarity: Column) -> Column:
    """1 less the best similarity to another answer, which is at least 0; so 1 for a single answer."""
    best = lambda row, i: F.array_max(F.transform(row, lambda x, j: F.when(i == j, 0.0).otherwise(F.greatest(x, F.lit(0.0)))))
    return F.transform(similarity, lambda row, i: 1.0 - best(row, i))


def pair_score(similarity: Column) -> Column:
    return mean(per_response(similarity))


def continuous_similarity(answers: Column, labels: Column, confidences: Column, both: bool = True) -> Column:
    """Confidence for entailment, half of it for neutral; 1 for identical texts; the mean of the directions, or the
    direction of the earlier answer for both."""

    def of(m: Column) -> Column:
        a, l, c = m["a"], m["l"], m["c"]
        one = lambda i, j: F.when(at(l, i, j) == 2, at(c, i, j)).when(at(l, i, j) == 1, at(c, i, j) / 2).otherwise(0.0)
        value = lambda i, j: (one(i, j) + one(j, i)) / 2 if both else one(F.least(i, j), F.greatest(i, j))
        return build(F.size(a), lambda i, j: F.when(F.get(a, i) == F.get(a, j), 1.0).otherwise(value(i, j)))

    return let(_inputs(answers, labels, confidences), of)


# --- semantic density ------------------------------------------------------------------------------------------


def unique_answers(answers: Column) -> Column:
    return F.array_distinct(answers)


def frequencies(answers: Column) -> Column:
    return let(answers, lambda a: F.transform(F.array_distinct(a), lambda t: F.size(F.filter(a, lambda x: x == t)) / F.size(a)))


def _kernel(answers: Column, near) -> Column:
    """Over the first places of the distinct answers: 1 on the diagonal, ``near(i, j)`` elsewhere."""
    places = F.transform(F.array_distinct(answers), lambda t: (F.array_position(answers, t) - 1).cast("int"))
    return let(places, lambda p: F.transform(p, lambda i: F.transform(p, lambda j: F.when(i == j, 1.0).otherwise(near(i, j)))))


def discrete_kernel(answers: Column, labels: Column, strict: bool = False) -> Column:
    """Over the distinct answers: 1 less the larger distance of both directions (0 entailment, 1/2 neutral, 1 contradiction;
    strict: all but entailment is 1)."""
    mid = 1.0 if strict else 0.5
    far = lambda x: F.when(x == 2, 0.0).when(x == 1, mid).otherwise(1.0)
    near = lambda l, i, j: F.greatest(F.lit(0.0), 1.0 - F.greatest(far(at(l, i, j)), far(at(l, j, i))))
    return let(_inputs(answers, labels), lambda m: _kernel(m["a"], lambda i, j: near(m["l"], i, j)))


def continuous_kernel(answers: Column, labels: Column, confidences: Column) -> Column:
    """Over the distinct answers: 1 less the expected distance, with what the label's confidence leaves split evenly among
    the other two labels; both directions averaged."""

    def near(m: Column, i: Column, j: Column) -> Column:
        label, t = at(m["l"], i, j), at(m["c"], i, j)
        o = (1.0 - t) / 2
        return 1.0 - F.when(label == 2, 1.5 * o).when(label == 1, o + t / 2).otherwise(t + o / 2)

    return let(_inputs(answers, labels, confidences), lambda m: _kernel(m["a"], lambda i, j: (near(m, i, j) + near(m, j, i)) / 2))


def constant_kernel(answers: Column, value: float = 0.75) -> Column:
    """What the continuous kernel is when no label is found at all: one value off the diagonal."""
    return let(answers, lambda a: _kernel(a, lambda i, j: F.lit(value)))


def density_per_answer(answers: Column, kernel: Column) -> Column:
    return let(frequencies(answers), lambda f: F.transform(kernel, lambda row: total(F.zip_with(row, f, lambda k, p: k * p))))


def density(answers: Column, kernel: Column) -> Column:
    """Frequency-weighted mean of the density at each distinct answer; 0 without answers."""
    return F.when(F.size(answers) == 0, 0.0).otherwise(total(F.zip_with(density_per_answer(answers, kernel), frequencies(answers), lambda d, p: d * p)))


# --- neighbour contrast ----------------------------------------------------------------------------------------


def lexical_matrix(answers: Column) -> Column:
    """ROUGE-L of space-normalised answers, 1 on the diagonal.  Each unordered pair of texts is compared once."""
    words = F.transform(answers, lambda a: T.split_words(T.normalize_spaces(a)))
    compared = lambda w, i, j: F.when(j > i, let(F.struct(F.get(w, i).alias("a"), F.get(w, j).alias("b")), lambda x: T.words_alike(x["a"], x["b"])))
    upper = let(words, lambda w: build(F.size(w), lambda i, j: compared(w, i, j)))
    return let(upper, lambda u: build(F.size(u), lambda i, j: F.when(i == j, 1.0).otherwise(at(u, F.least(i, j), F.greatest(i, j)))))


def _log_sum(values: Column) -> Column:
    """ln of the sum of exponentials of the values that are not null; minus infinity for none."""
    return let(F.array_compact(values), lambda v: F.when(F.size(v) > 0, F.log(total(F.transform(v, F.exp)))).otherwise(F.lit(float("-inf"))))


def contrast(similarity: Column, ids: Column, variant: str = "full", temperature: float = 1.0, exclude_self: bool = False) -> Column:
    """Neighbour contrast over semantic clusters: ``num`` gathers an answer's own cluster, ``den`` all answers."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")

    def loss(row: Column, i: Column, ids: Column) -> Column:
        scaled = F.transform(row, lambda s, j: F.when((j == i) & F.lit(exclude_self), F.lit(None).cast("double")).otherwise(s / temperature))
        own = _log_sum(F.transform(scaled, lambda s, j: F.when(F.get(ids, j) == F.get(ids, i), s)))
        num = let(own, lambda x: F.when(x == float("-inf"), F.log(F.lit(EPSILON))).otherwise(x))
        den = _log_sum(scaled)
        if variant == "only_num":
            return num
        if variant == "only_denom":
            return den
        if variant == "full":
            return num - den
        return F.log(2 * F.exp(num) - F.exp(den) + F.exp(F.lit(1.0 / temperature)) * F.size(ids))

    return let(ids, lambda own: F.when(F.size(own) == 0, 0.0).otherwise(0.0 - mean(F.transform(similarity, lambda row, i: loss(row, i, own)))))


def continuous_contrast(similarity: Column, variant: str = "full", temperature: float = 1.0, exclude_self: bool = True) -> Column:
    """Neighbour contrast with each similarity as the probability of the same cluster.  ``num_minus_denom`` is the constant
    -ln(epsilon), as the numerator never exceeds the denominator."""
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")

    def loss(row: Column, i: Column) -> Column:
        scaled = F.transform(row, lambda s, j: F.when((j == i) & F.lit(exclude_self), F.lit(None).cast("double")).otherwise(s / temperature))
        clip = lambda s: F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
        num = _log_sum(F.transform(scaled, lambda s: s + F.log(clip(s) + EPSILON)))
        den = _log_sum(F.transform(scaled, lambda s: s + F.log(F.lit(1.0 + EPSILON))))
        if variant == "only_num":
            return num
        if variant == "only_denom":
            return den
        if variant == "full":
            return num - den
        return F.log(F.greatest(F.exp(num) - F.exp(den), F.lit(EPSILON)))

    return let(similarity, lambda m: F.when(F.size(m) == 0, 0.0).otherwise(0.0 - mean(F.transform(m, loss))))


# --- consistency -----------------------------------------------------------------------------------------------


def cosine_consistency(vectors: Column) -> Column:
    """Mean of (cosine + 1) / 2 of the first vector with each later one; 1 for a single vector, 0 for none."""
    dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
    norm = lambda a: F.sqrt(dot(a, a))
    first = F.get(vectors, F.lit(0))
    later = F.slice(vectors, 2, F.greatest(F.size(vectors) - 1, F.lit(0)))
    near = F.transform(later, lambda v: (dot(first, v) / F.greatest(norm(first) * norm(v), F.lit(1e-12)) + 1) / 2)
    return F.when(F.size(vectors) == 0, 0.0).when(F.size(vectors) == 1, 1.0).otherwise(mean(near))

"""All uncertainty scores of answer sets, by method name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import exact_match_confidence
from plumbline.operators import clusters, graph, pairs, spectral
from plumbline.operators import scores as S

A, L, C = "answers", "labels", "confidences"


def _per_row(value: Callable[..., dict]) -> Callable[..., DataFrame]:
    def method(m: DataFrame, **options) -> DataFrame:
        return m.select("qid", *[c.alias(k) for k, c in value(**options).items()])

    return method


def as_bool(value: object) -> bool:
    """A flag as its text says: "true" in any case, nothing else; what is no text by its truth."""
    return value.lower() == "true" if isinstance(value, str) else bool(value)


def entropy(strict: bool = False) -> dict:
    return {"discrete_semantic_uncertainty": clusters.cluster_entropy(clusters.semantic_ids(L, strict))}


def discrete_graph(m: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Spectral scores and degrees from one pass: the matrix stays in the row."""
    w = m.select("qid", graph.label_weights(L).alias("weights"))
    return _graph(w, threshold)


def continuous_graph(m: DataFrame, threshold: float = 0.9) -> DataFrame:
    return _graph(m.select("qid", S.continuous_similarity(A, L, C, True).alias("weights")), threshold, keep=True)


def _graph(w: DataFrame, threshold: float, keep: bool = False) -> DataFrame:
    found = spectral.graph_scores(w, threshold, keep=("weights",))  # the matrix comes along, so nothing is computed or joined twice
    extra = [graph.u_deg(F.col("weights")).alias("u_deg"), graph.c_deg(F.col("weights")).alias("c_deg")]
    if keep:
        extra += [F.col("weights").alias("similarity_matrix"), graph.laplacian(F.col("weights")).alias("laplacian")]
    return found.select("qid", "u_eigv", "u_ecc", "c_ecc", *extra)


#: The graphs' columns and the prefixes of their entropies' names; all names in the order of the map.
_GRAPHS = {"g0": "", "g1": "weighted_", "g2": "weighted_deberta_"}
KERNEL_NAMES = ["cluster_assignment_entropy", *(prefix + name for prefix in _GRAPHS.values() for name in spectral.entropy_names())]


def kernel(m: DataFrame, strict: bool = True) -> DataFrame:
    """193 entropies: of the clusters, and 64 of each of three graphs."""
    g = m.select("qid", clusters.semantic_ids(L, strict).alias("semantic_ids"), graph.complete_edges(L).alias("g0"), graph.label_edges(L).alias("g1"), graph.confidence_edges(C).alias("g2"))
    g = g.withColumn("cluster_assignment_entropy", clusters.cluster_entropy(F.col("semantic_ids")))
    return spectral.kernel_scores(g, _GRAPHS, keep=("semantic_ids",), first=("cluster_assignment_entropy",))


def pair_entailment(strict: bool = False, neutral: bool = False, both: bool = False) -> dict:
    strict, neutral, both = as_bool(strict), as_bool(neutral), as_bool(both)
    each = S.per_response(S.entailment_similarity(L, strict, neutral, both))
    return {"luq_pair": pairs.mean(each), "luq_pair_per_response": each, "luq_bidirectional": F.lit(both), "luq_include_neutral": F.lit(neutral)}


def continuous_pair_entailment(both: bool = False) -> dict:
    both = as_bool(both)
    s = S.continuous_similarity(A, L, C, both)
    each = S.per_response(s)
    return {"semantic_similarity_matrix": s, "semantic_density": 1 - pairs.mean(each), "semantic_density_uncertainty": pairs.mean(each), "luq_pair": pairs.mean(each), "luq_pair_per_response": each, "luq_bidirectional": F.lit(both)}


def _density(kernel_: Column) -> dict:
    d, each = S.density(A, kernel_), S.density_per_answer(A, kernel_)
    return {
        "semantic_density": d, "semantic_density_uncertainty": 1 - d, "semantic_density_per_response": each, "semantic_density_unique_responses": S.unique_answers(A),
        "semantic_density_unique_frequencies": S.frequencies(A), "semantic_density_mean_per_response": pairs.mean(each),
    }


def discrete_density(strict: bool = False) -> dict:
    return _density(S.discrete_kernel(A, L, strict))


def continuous_density(compat: bool = False) -> dict:
    """``compat``: as if no label were known, which makes the kernel 0.75 off the diagonal."""
    return _density(S.constant_kernel(A) if compat else S.continuous_kernel(A, L, C))


def neighbour_contrast(variant: str = "full", temperature: float = 1.0, exclude_self: bool = False, strict: bool = False) -> dict:
    ids = clusters.semantic_ids(L, strict)
    return {"semantic_ids": ids, "snne": S.contrast(S.lexical_matrix(A), ids, variant, temperature, exclude_self), "snne_variant": F.lit(variant), "snne_temperature": F.lit(temperature)}


def continuous_contrast(variant: str = "full", temperature: float = 1.0, exclude_self: bool = True, both: bool = True) -> dict:
    s = S.continuous_similarity(A, L, C, both)
    v = S.continuous_contrast(s, variant, temperature, exclude_self)
    return {"semantic_similarity_matrix": s, "continuous_snne": v, "snne": v, "continuous_snne_variant": F.lit(variant), "continuous_snne_temperature": F.lit(temperature)}


METHODS: dict[str, Callable[..., DataFrame]] = {
    "discrete_semantic_uncertainty": _per_row(entropy),
    "discrete_semantic_entropy": _per_row(entropy),
    "discrete_gwc": discrete_graph,
    "continuous_gwc": continuous_graph,
    "kle": kernel,
    "discrete_luq_pair": _per_row(pair_entailment),
    "continuous_luq": _per_row(continuous_pair_entailment),
    "discrete_semantic_density": _per_row(discrete_density),
    "continuous_semantic_density": _per_row(continuous_density),
    "discrete_snne": _per_row(neighbour_contrast),
    "continuous_snne": _per_row(continuous_contrast),
}


def score(sets: DataFrame, cache: DataFrame | None, method: str, strict_cache: bool = True, **options) -> DataFrame:
    """Scores of every answer set by a named method; see ``METHODS``.  ``consistency_triplet`` needs no labels but two encoders'
    vectors, as the options ``first`` and ``second``."""
    if method == "consistency_triplet":
        return consistency_triplet(sets, **options)
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join([*METHODS, 'consistency_triplet'])}")
    return METHODS[method](pairs.label_matrices(sets, cache, strict_cache), **options)


def consistency_triplet(sets: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """``(qid, exact_match, bert_score, cosine_sim)`` from two encoders' vectors ``(qid, vectors)``."""
    a, b = (v.select("qid", F.col("vectors").alias(n)) for v, n in ((first, "v1"), (second, "v2")))
    return sets.join(a, "qid").join(b, "qid").select("qid", exact_match_confidence(A).alias("exact_match"), S.cosine_consistency(F.col("v1")).alias("bert_score"), S.cosine_consistency(F.col("v2")).alias("cosine_sim"))

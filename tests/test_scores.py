"""Golden values of FIXTURES.md, closed forms, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import clusters, graph, pairs, ranking, spectral, subsets
from plumbline.plans import score

ANSWERS = ["Paris", "Paris, France", "Lyon", "Paris"]
LABELS = [[2, 1, 0, 2], [2, 2, 0, 2], [0, 1, 2, 0], [2, 1, 0, 2]]


@pytest.fixture(scope="module")
def toy(spark):
    sets = spark.createDataFrame([(1, "q", ANSWERS)], "qid int, question string, answers array<string>")
    rows = {("q", ANSWERS[i], ANSWERS[j], LABELS[i][j], 0.9) for i in range(4) for j in range(4) if ANSWERS[i] != ANSWERS[j]}
    return sets, spark.createDataFrame(sorted(rows), "question string, text1 string, text2 string, label int, confidence double")


def one(df, *names):
    r = df.first()
    return r[names[0]] if len(names) == 1 else [r[n] for n in names]


def close(got, want, at=1e-6):
    assert np.allclose(np.array(got, float), np.array(want, float), atol=at), got


def test_matrices(toy):
    m = pairs.label_matrices(*toy).first()
    assert m["labels"] == LABELS
    assert m["confidences"][0][3] == 0.999 and m["confidences"][0][1] == 0.9


def test_cache_miss(spark, toy):
    empty = toy[1].limit(0)
    with pytest.raises(Exception, match="no label for"):
        pairs.label_matrices(toy[0], empty).collect()
    assert pairs.label_matrices(toy[0], empty, strict_cache=False).first()["labels"][0] == [2, 0, 0, 2]
    assert pairs.missing_pairs(*toy).count() == 0
    assert pairs.missing_pairs(toy[0], empty).count() == 6


def test_clusters(spark, toy):
    m = pairs.label_matrices(*toy)
    assert one(m.select(clusters.semantic_ids(F.col("labels")).alias("x")), "x") == [0, 0, 1, 0]
    assert one(m.select(clusters.semantic_ids(F.col("labels"), True).alias("x")), "x") == [0, 1, 2, 0]
    close(one(score.score(*toy, "discrete_semantic_entropy"), "discrete_semantic_uncertainty"), 0.5623351446)
    close(one(score.score(*toy, "discrete_semantic_entropy", strict=True), "discrete_semantic_uncertainty"), 1.0397207708)
    late = [[2, 0, 2], [0, 2, 2], [2, 2, 2]]
    assert spark.createDataFrame([(late,)], "l array<array<int>>").select(clusters.semantic_ids(F.col("l")).alias("x")).first()["x"] == [0, 1, 1]


def test_graph(toy):
    r = score.score(*toy, "discrete_gwc").first()
    close([r["u_eigv"], r["u_deg"], r["u_ecc"]], [1.8909090908, 0.40625, 1.0])
    close(r["c_deg"], [0.6875, 0.6875, 0.3125, 0.6875])
    r = score.score(*toy, "continuous_gwc").first()
    close([r["u_eigv"], r["u_deg"], r["u_ecc"]], [1.9523395944, 0.428125, 1.0])
    close(r["similarity_matrix"][0], [1, 0.675, 0, 1])
    w = np.array([[1, 0.75, 0, 1], [0.75, 1, 0.25, 0.75], [0, 0.25, 1, 0], [1, 0.75, 0, 1]])
    close(np.linalg.eigvalsh(spectral.normalized_laplacian(w)), [0, 0.20945, 0.899641, 1], 1e-5)
    m = pairs.label_matrices(*toy)
    close(one(m.select(graph.laplacian(graph.label_weights(F.col("labels"))).alias("x")), "x"), spectral.normalized_laplacian(w))


def test_kernels(toy):
    e = score.score(*toy, "kle").first()["entropies"]
    assert len(e) == 193
    names = ["heat{}_t=0.3_kernel_entropy_s", "heat{}_t=0.3_kernel_entropy", "matern{}_kappa=1.0_nu=1.0_kernel_entropy_s"]
    for prefix, plain, normal in (
        ("", [0.875245, 1.213347, 0.896241], [0.987821, 1.369411, 0.979595]),
        ("weighted_", [0.851805, 1.180852, 0.898690], [0.985646, 1.366395, 0.978202]),
        ("weighted_deberta_", [0.603173, 0.836175, 0.792999], [0.987814, 1.369402, 0.979591]),
    ):
        close([e[prefix + n.format("")] for n in names], plain)
        close([e[prefix + n.format("n")] for n in names], normal)


def test_pair_scores(toy):
    get = lambda **o: one(score.score(*toy, "discrete_luq_pair", **o), "luq_pair")
    close([get(), get(neutral=True), get(both=True)], [0.25, 0.125, 0.375])
    close(one(score.score(*toy, "continuous_luq"), "luq_pair"), 0.275)


def test_density(toy):
    r = score.score(*toy, "discrete_semantic_density").first()
    close(r["semantic_density"], 0.5)
    close(r["semantic_density_per_response"], [0.625, 0.5, 0.25])
    close(one(score.score(*toy, "continuous_semantic_density"), "semantic_density"), 0.6078125)
    f = np.array([0.5, 0.25, 0.25])
    close(one(score.score(*toy, "continuous_semantic_density", compat=True), "semantic_density"), f @ (np.full((3, 3), 0.75) + 0.25 * np.eye(3)) @ f)


def test_contrast(toy):
    for v, kept, left in (("full", 0.306180, 5.100281), ("only_num", -1.568859, 3.775253), ("only_denom", -1.875039, -1.325029), ("num_minus_denom", -2.655999, -2.439152)):
        close(one(score.score(*toy, "discrete_snne", variant=v), "snne"), kept)
        close(one(score.score(*toy, "discrete_snne", variant=v, exclude_self=True), "snne"), left)
    for v, want in (("full", 0.923763), ("only_num", -0.650979), ("only_denom", -1.574742), ("num_minus_denom", 18.420681)):
        close(one(score.score(*toy, "continuous_snne", variant=v), "snne"), want)
    with pytest.raises(ValueError):
        score.score(*toy, "discrete_snne", variant="other")
    with pytest.raises(ValueError):
        score.score(*toy, "other")


def test_empty_and_single(spark, toy):
    sets = spark.createDataFrame([(1, "q", []), (2, "q", ["a"]), (3, "q", ["a", "a", "a"])], "qid int, question string, answers array<string>")
    by = lambda method, name, **o: {r["qid"]: r[name] for r in score.score(sets, toy[1], method, **o).collect()}
    assert by("discrete_semantic_entropy", "discrete_semantic_uncertainty") == {1: None, 2: 0.0, 3: 0.0}
    assert by("discrete_luq_pair", "luq_pair") == {1: None, 2: 1.0, 3: 0.0}
    assert by("discrete_semantic_density", "semantic_density") == {1: 0.0, 2: 1.0, 3: 1.0}
    assert by("discrete_snne", "snne")[1] == 0.0
    assert by("discrete_gwc", "u_deg") == {1: None, 2: 0.0, 3: 0.0}
    got = by("discrete_gwc", "u_eigv")
    assert got[1] is None and got[2] == pytest.approx(1) and got[3] == pytest.approx(1)
    assert math.isnan(by("kle", "entropies")[2]["heat_t=0.1_kernel_entropy_s"])


def test_consistency(spark):
    sets = spark.createDataFrame([(1, "q", ["Paris", " paris", "Lyon"]), (2, "q", ["x"]), (3, "q", [])], "qid int, question string, answers array<string>")
    v = spark.createDataFrame([(1, [[1.0, 0.0], [1.0, 0.0], [0.0, 1.0]]), (2, [[1.0, 2.0]]), (3, [])], "qid int, vectors array<array<float>>")
    got = {r["qid"]: r for r in score.consistency_triplet(sets, v, v).collect()}
    assert (got[1]["exact_match"], got[1]["bert_score"]) == (0.5, 0.75)
    assert (got[2]["exact_match"], got[2]["cosine_sim"]) == (1.0, 1.0)
    assert (got[3]["exact_match"], got[3]["cosine_sim"]) == (0.0, 0.0)


def ranked(spark, uq, quality):
    rows = [("u", i, u, q) for i, (u, q) in enumerate(zip(uq, quality, strict=True))]
    return ranking.rank(spark.createDataFrame(rows, "uq_column string, qid int, uq double, quality double")).first()


def test_ranking(spark):
    r = ranked(spark, [0.1, 0.2, 0.2, 0.5, 0.9], [1.0, 0.0, 1.0, 1.0, 0.0])
    close([r["auroc"], r["auarc"], r["prr"]], [0.75, 0.6791667, 0.7033333])
    r = ranked(spark, [0.1, None, float("nan"), 0.3], [1.0, 0.0, 0.0, 1.0])
    assert r["matched"] == 2 and r["auroc"] is None and r["prr"] == 0.5
    assert ranked(spark, [0.5], [1.0])["auarc"] is None


def test_auroc_is_symmetric(spark):
    rng = np.random.default_rng(1)
    uq, q = rng.integers(0, 6, 50).astype(float).tolist(), rng.integers(0, 2, 50).astype(float).tolist()
    assert ranked(spark, uq, q)["auroc"] + ranked(spark, [-u for u in uq], q)["auroc"] == pytest.approx(1)


def test_confident_failures(spark):
    rows = [(f"q{i}", float(i), float(i % 2)) for i in range(10)]
    r = subsets.with_ids(*subsets.confident_failures(spark.createDataFrame(rows, "qid string, uq double, quality double"))).first()
    assert (r["total"], r["bad"], r["selected"], r["ratio"], r["qids"]) == (10, 5, 1, 0.2, ["q0"])
    assert r["uq_threshold"] == pytest.approx(1.8)


def test_resolve(spark):
    df = spark.createDataFrame([(1, "x", [1.0, 3.0], 7.0), (2, "4.5", [], 8.0)], "qid int, wanted string, luq_pair array<double>, other double")
    got = {r["qid"]: r["v"] for r in df.select("qid", ranking.resolve_score(df, "wanted", ("luq",)).alias("v")).collect()}
    assert got == {1: 2.0, 2: 4.5}
    got = {r["qid"]: r["v"] for r in df.select("qid", ranking.resolve_score(df, "absent", ("luq",)).alias("v")).collect()}
    assert got == {1: 2.0, 2: 4.5}


def test_permutation_keeps_graph_scores():
    rng = np.random.default_rng(2)
    w = rng.random((1, 6, 6))
    w = (w + w.transpose(0, 2, 1)) / 2
    p = rng.permutation(6)
    for a, b in zip(spectral.eigen_scores(w)[:2], spectral.eigen_scores(w[:, p][:, :, p])[:2], strict=True):
        close(a, b, 1e-9)


def test_spectral_scores_row_by_row(spark, sf):
    """Every score of a whole table, recomputed one matrix at a time."""
    from plumbline.operators import graph, pairs, spectral
    from plumbline.plans.queries import GRADED, labels, set_a

    m = pairs.label_matrices(set_a(spark, sf), labels(spark, GRADED)).select("qid", "labels", "confidences")
    g = m.select("qid", graph.label_weights(F.col("labels")).alias("weights"), graph.label_edges(F.col("labels")).alias("g1"), graph.confidence_edges(F.col("confidences")).alias("g2"))
    scores = {r["qid"]: r for r in spectral.graph_scores(g.select("qid", "weights")).collect()}
    kernels = {r["qid"]: r["entropies"] for r in spectral.kernel_scores(g.select("qid", "g1", "g2"), {"g1": "a_", "g2": "b_"}).collect()}

    def entropy(kernel):
        n = len(kernel)
        d = np.array([[np.sqrt(kernel[i, i] * kernel[j, j]) for j in range(n)] for i in range(n)])
        return -sum(v * np.log(abs(v)) for v in np.linalg.eigvalsh(kernel / d / n) if abs(v) > 1e-8)

    rows = g.collect()
    for r in rows:
        w = np.array(r["weights"])
        n = len(w)
        assert np.allclose(w, w.T)
        deg = np.diag(1 / np.sqrt(w.sum(1) + 1e-10))
        values, vectors = np.linalg.eigh(np.eye(n) - deg @ w @ deg)
        assert scores[r["qid"]]["u_eigv"] == pytest.approx(sum(max(0, 1 - v) for v in values), abs=1e-6)
        kept = [vectors[:, k] for k in range(n) if values[k] > 0.9]
        away = sum(np.linalg.norm(v - v.mean()) ** 2 for v in kept)
        assert scores[r["qid"]]["u_ecc"] == pytest.approx(np.sqrt(away), abs=1e-6) and len(scores[r["qid"]]["c_ecc"]) == len(kept)
        if len(np.unique(values.round(6))) == n:
            assert np.allclose(sorted(scores[r["qid"]]["c_ecc"]), sorted(-np.linalg.norm(v - v.mean()) for v in kept), atol=1e-6)
        for name, prefix in (("g1", "a_"), ("g2", "b_")):
            w = np.array(r[name])
            deg = w.sum(1)
            plain = np.diag(deg) - w
            s = np.diag([1 / np.sqrt(x) if x > 0 else 0 for x in deg])
            for mark, lap in (("", plain), ("n", s @ plain @ s)):
                values, vectors = np.linalg.eigh(lap)
                for t in (0.1, 0.7):
                    want = entropy(vectors @ np.diag(np.exp(-t * values)) @ vectors.T)
                    assert kernels[r["qid"]][f"{prefix}heat{mark}_t={t}_kernel_entropy"] == pytest.approx(want, abs=1e-6)
                for kappa, nu in ((1.0, 1.0), (3.0, 2.0)):
                    want = entropy(vectors @ np.diag(np.maximum(2 * nu / kappa**2 + values, 1e-10) ** -nu) @ vectors.T)
                    assert kernels[r["qid"]][f"{prefix}matern{mark}_kappa={kappa}_nu={nu}_kernel_entropy"] == pytest.approx(want, abs=1e-6)
                    assert kernels[r["qid"]][f"{prefix}matern{mark}_kappa={kappa}_nu={nu}_kernel_entropy_s"] == pytest.approx(want / np.log(n), abs=1e-6) if n > 1 else True
    assert len(rows) > 100 and any(len(r["weights"]) < 10 for r in rows)


def test_ties_of_one_uncertainty_are_parted(spark):
    """A hot value's rows stand in several ranges, and the curves are those of one sorted list."""
    rng = np.random.default_rng(1)
    rows = [(int(i), "u", 0.0 if i % 3 else float(rng.integers(5)), float(rng.integers(2))) for i in rng.permutation(3000)]
    df = spark.createDataFrame(rows, "qid long, uq_column string, uq double, quality double").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges would be joined
    try:
        assert ranking._ranged(df, ("uq_column", "uq", "qid")).where("uq = 0").select("b").distinct().count() > 1
        got = ranking.rank(df).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranked = sorted(rows, key=lambda r: (r[2], r[0]))
    q = np.array([r[3] for r in ranked])
    means = np.cumsum(q) / np.arange(1, len(q) + 1)
    assert got["auarc"] == pytest.approx((means.sum() - (means[0] + means[-1]) / 2) / (len(q) - 1)) and got["prr"] == pytest.approx(means.mean())
    good, bad = ([r[2] for r in rows if r[3] == k] for k in (1.0, 0.0))
    assert got["auroc"] == pytest.approx(np.mean([(b > a) + 0.5 * (a == b) for a in good for b in bad]))


def test_graphs_are_decomposed_once(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    one = rng.random((7, 7)).round(2)
    one = np.triu(one, 1) + np.triu(one, 1).T
    orders = [rng.permutation(7) for _ in range(50)]
    w = np.stack([one[np.ix_(p, p)] for p in orders])
    want = np.stack(list(spectral.kernel_entropies(w).values()), 1)
    seen = []
    real = spectral.kernel_entropies
    monkeypatch.setattr(spectral, "kernel_entropies", lambda g: seen.append(len(g)) or real(g))
    spectral._known.clear()
    for _ in range(2):
        names, got = spectral.distinct_entropies(w)
        assert np.allclose(got, want, atol=1e-9) and names == list(real(w[:1]))
    assert seen == [1]


def test_matrices_come_along(spark):
    """Scores that need a matrix after the eigenvalues neither compute nor join it again, and Python holds few rows at once."""
    from plumbline.plans import score

    sets = spark.createDataFrame([(str(i), "q", ["a", "b", None, "a"][: i % 5]) for i in range(3000)], "qid string, question string, answers array<string>")
    cache = spark.createDataFrame([("q", "a", "b", 2, 0.5), ("q", "b", "a", 1, 0.5)], "question string, text1 string, text2 string, label int, confidence double")
    for method in ("discrete_gwc", "continuous_gwc", "kle"):
        plan = score.score(sets, cache, method)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == 2 and plan.count("MapInArrow") == 1
    got = {r["qid"]: r for r in score.score(sets.where("size(answers) <> 3 and size(answers) <> 4"), cache, "discrete_gwc").collect()}
    assert got["0"]["u_eigv"] is None and got["2"]["u_deg"] == pytest.approx(1 - (1 + 1 + 0.75 + 0.75) / 4) and len(got) == 1800
    twice = cache.union(cache)
    with pytest.raises(Exception, match="several labels"):
        score.score(sets, twice, "discrete_luq_pair").collect()

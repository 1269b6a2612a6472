"""The registered queries of the engine's own operators over the test tables, each with its DuckDB counterpart.

Bindings: an answer set is ten consecutive event types of a user, by time (set A; all events are in one), or a conversation's
assistant turns with its user turns as references (set C); labels between event types come from a small table that is asymmetric and
has neutrals, or are plain equality.  Results are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import numeric as N
from plumbline.functions import text as T
from plumbline.operators import clusters, graph, joins, pairs, ranking, reports, spectral, subsets, votes
from plumbline.operators import scores as S
from plumbline.plans import evaluate, prompts
from plumbline.plans import score as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TYPES = ["click", "error", "purchase", "signup", "view"]
A, L, C = "answers", "labels", "confidences"


def _graded(i: int, j: int) -> tuple[int, float]:
    return (2 * i + j + i * j) % 3, 0.5 + ((7 * i + 5 * j) % 10) / 20


GRADED = [(a, b, *_graded(i, j)) for (i, a), (j, b) in product(enumerate(TYPES), repeat=2) if a != b]
EXACT = [(a, b, 0, 0.9) for a, b in product(TYPES, repeat=2) if a != b]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded, and without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def set_a(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = _read(spark, sf, "events").withColumn("set", F.col("user_id") * 100_000 + F.floor(place / 10))
    return pairs.answer_sets(rows, "set", "event_type", ["ts", "event_id"], question=F.lit("type"))


def labels(spark: SparkSession, rows: list) -> DataFrame:
    return spark.createDataFrame([("type", *r) for r in rows], "question string, text1 string, text2 string, label int, confidence double")


def graded(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.label_matrices(set_a(spark, sf), labels(spark, GRADED))


def exact(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.label_matrices(set_a(spark, sf), labels(spark, EXACT))


def set_c(spark: SparkSession, sf: str) -> DataFrame:
    """``(qid, answers, refs, ordinal)``"""
    c = _read(spark, sf, "conversations")
    answers = pairs.answer_sets(c.where("role = 'assistant'"), "conv_id", "text", ["turn"])
    refs = pairs.answer_sets(c.where("role = 'user'"), "conv_id", "text", ["turn"]).select("qid", F.col("answers").alias("refs"))
    return answers.join(refs, "qid").select("qid", "answers", "refs", F.lit(0).alias("ordinal"))


def cells(df: DataFrame, matrix: Column, name: str) -> DataFrame:
    rows = df.select("qid", F.posexplode(matrix).alias("i", "row"))
    return rows.select("qid", "i", F.posexplode("row").alias("j", "x")).select("qid", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r6("x").alias(name))


def _values(rows: list) -> str:
    return ", ".join(f"('{a}','{b}',{l},{c}::DOUBLE)" for a, b, l, c in rows)


def with_pairs(rows: list, more: str, recursive: bool = False) -> str:
    return f"""WITH {'RECURSIVE ' if recursive else ''}a AS (SELECT user_id * 100000 + k // 10 AS qid, t, k % 10 AS i FROM (SELECT user_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)),
nli(t1, t2, l, c) AS (VALUES {_values(rows)}),
p AS (SELECT x.qid, x.i, y.i AS j, x.t AS ti, y.t AS tj, CASE WHEN x.t = y.t THEN 2 ELSE f.l END AS l, CASE WHEN x.t = y.t THEN 2 ELSE g.l END AS r,
 CASE WHEN x.t = y.t THEN 0.999 ELSE f.c END AS c, CASE WHEN x.t = y.t THEN 0.999 ELSE g.c END AS rc
 FROM a x JOIN a y ON x.qid = y.qid LEFT JOIN nli f ON f.t1 = x.t AND f.t2 = y.t LEFT JOIN nli g ON g.t1 = y.t AND g.t2 = x.t),
m AS (SELECT qid, count(*) AS n FROM a GROUP BY qid){more}"""


# --- clusters --------------------------------------------------------------------------------------------------

_STEPS = """,
e AS (SELECT qid, i, list(j) AS js FROM p WHERE j > i AND ({same}) GROUP BY qid, i),
s(qid, n, k, ids, nxt) AS (
 SELECT qid, n, 0::BIGINT, list_transform(range(n), lambda z: -1::BIGINT), 0::BIGINT FROM m
 UNION ALL
 SELECT s.qid, s.n, s.k + 1, CASE WHEN s.ids[s.k + 1] = -1 THEN list_transform(range(s.n), lambda z: CASE WHEN z = s.k OR list_contains(coalesce(e.js, []), z) THEN s.nxt ELSE s.ids[z + 1] END) ELSE s.ids END,
  CASE WHEN s.ids[s.k + 1] = -1 THEN s.nxt + 1 ELSE s.nxt END
 FROM s LEFT JOIN e ON e.qid = s.qid AND e.i = s.k WHERE s.k < s.n),
ids AS (SELECT qid, n, ids FROM s WHERE k = n)"""
LOOSE, STRICT = "l <> 0 AND r <> 0 AND NOT (l = 1 AND r = 1)", "l = 2 AND r = 2"
_ENTROPY = " SELECT qid, round(-sum(q * ln(q)), 6) + 0.0 AS entropy FROM (SELECT qid, count(*) / any_value(n)::DOUBLE AS q FROM (SELECT qid, n, unnest(ids) AS c FROM ids) GROUP BY qid, c) GROUP BY qid"


@query(
    "dse_entropy",
    with_pairs(EXACT, " SELECT qid, round(-sum(q * ln(q)), 6) + 0.0 AS entropy FROM (SELECT a.qid, t, count(*) / any_value(n)::DOUBLE AS q FROM a JOIN m USING (qid) GROUP BY a.qid, t) GROUP BY qid"),
)
def dse_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return exact(spark, sf).select("qid", r6(clusters.cluster_entropy(clusters.semantic_ids(L))).alias("entropy"))


def _entropy(strict: bool) -> Query:
    return lambda spark, sf: graded(spark, sf).select("qid", r6(clusters.cluster_entropy(clusters.semantic_ids(L, strict))).alias("entropy"))


query("dse_graded_entropy", with_pairs(GRADED, _STEPS.format(same=LOOSE) + _ENTROPY, True))(_entropy(False))
query("dse_strict_entropy", with_pairs(GRADED, _STEPS.format(same=STRICT) + _ENTROPY, True))(_entropy(True))


@query("semantic_ids", with_pairs(GRADED, _STEPS.format(same=LOOSE) + " SELECT qid, array_to_string(ids, ',') AS ids FROM ids", True))
def semantic_ids(spark: SparkSession, sf: str) -> DataFrame:
    return graded(spark, sf).select("qid", F.array_join(F.transform(clusters.semantic_ids(L), lambda x: x.cast("string")), ",").alias("ids"))


@query("answer_flatten", with_pairs(GRADED, " SELECT qid, i AS ordinal, t AS answer FROM a"))
def answer_flatten(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.flatten(set_a(spark, sf)).select("qid", F.col("ordinal").cast("long").alias("ordinal"), "answer")


@query("missing_pairs", with_pairs(GRADED, " SELECT DISTINCT 'type' AS question, ti AS text1, tj AS text2 FROM p WHERE ti <> tj AND NOT (ti = 'click' OR tj = 'view')"))
def missing_pairs(spark: SparkSession, sf: str) -> DataFrame:
    known = labels(spark, [r for r in GRADED if r[0] == "click" or r[1] == "view"])
    return pairs.missing_pairs(set_a(spark, sf), known)


# --- graphs ----------------------------------------------------------------------------------------------------

_W = ",\nw AS (SELECT qid, i, j, (l + r) / 4.0 AS w FROM p),\nd AS (SELECT qid, i, sum(w) AS d FROM w GROUP BY qid, i)"


@query("gwc_weights", with_pairs(GRADED, _W + " SELECT qid, i, j, round(w, 6)::DOUBLE AS w FROM w"))
def gwc_weights(spark: SparkSession, sf: str) -> DataFrame:
    return cells(graded(spark, sf), graph.label_weights(L), "w")


@query(
    "gwc_laplacian",
    with_pairs(GRADED, _W + " SELECT w.qid, w.i, w.j, round(CASE WHEN w.i = w.j THEN 1.0 ELSE 0.0 END - w / sqrt((x.d + 1e-10) * (y.d + 1e-10)), 6) + 0.0 AS x FROM w JOIN d x ON x.qid = w.qid AND x.i = w.i JOIN d y ON y.qid = w.qid AND y.i = w.j"),
)
def gwc_laplacian(spark: SparkSession, sf: str) -> DataFrame:
    return cells(graded(spark, sf), graph.laplacian(graph.label_weights(L)), "x")


@query("gwc_udeg", with_pairs(GRADED, _W + " SELECT qid, round(1 - sum(d) / (any_value(n) * any_value(n)), 6)::DOUBLE + 0.0 AS u_deg FROM d JOIN m USING (qid) GROUP BY qid"))
def gwc_udeg(spark: SparkSession, sf: str) -> DataFrame:
    return graded(spark, sf).select("qid", r6(graph.u_deg(graph.label_weights(L))).alias("u_deg"))


@query("gwc_cdeg", with_pairs(GRADED, _W + " SELECT qid, i, round(d / n, 6)::DOUBLE + 0.0 AS c_deg FROM d JOIN m USING (qid)"))
def gwc_cdeg(spark: SparkSession, sf: str) -> DataFrame:
    rows = graded(spark, sf).select("qid", F.posexplode(graph.c_deg(graph.label_weights(L))).alias("i", "c"))
    return rows.select("qid", F.col("i").cast("long").alias("i"), r6("c").alias("c_deg"))


@query("gwc_ueigv_exact", with_pairs(EXACT, " SELECT qid, round(count(DISTINCT t), 6)::DOUBLE AS u_eigv FROM a GROUP BY qid"))
def gwc_ueigv_exact(spark: SparkSession, sf: str) -> DataFrame:
    """With equality as entailment the graph is a union of cliques, whose score is how many there are."""
    return spectral.graph_scores(exact(spark, sf).select("qid", graph.label_weights(L).alias("weights"))).select("qid", F.round("u_eigv", 6).alias("u_eigv"))


@query("gwc_scores")
def gwc_scores(spark: SparkSession, sf: str) -> DataFrame:
    return P.score(set_a(spark, sf), labels(spark, GRADED), "discrete_gwc").select("qid", r6("u_eigv").alias("u_eigv"), r6("u_ecc").alias("u_ecc"), r6("u_deg").alias("u_deg"))


@query("cont_gwc_scores")
def cont_gwc_scores(spark: SparkSession, sf: str) -> DataFrame:
    return P.score(set_a(spark, sf), labels(spark, GRADED), "continuous_gwc").select("qid", r6("u_eigv").alias("u_eigv"), r6("u_ecc").alias("u_ecc"), r6("u_deg").alias("u_deg"))


_EDGE = lambda x: f"CASE {x} WHEN 2 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END"


@query("kle_edges", with_pairs(GRADED, f" SELECT qid, i, j, CASE WHEN i = j THEN 0.0 ELSE {_EDGE('l')} + {_EDGE('r')} END::DOUBLE AS label_edge, round(CASE WHEN i = j THEN 0.0 ELSE c + rc END, 6)::DOUBLE AS confidence_edge FROM p"))
def kle_edges(spark: SparkSession, sf: str) -> DataFrame:
    m = graded(spark, sf)
    return cells(m, graph.label_edges(L), "label_edge").join(cells(m, graph.confidence_edges(C), "confidence_edge"), ["qid", "i", "j"])


def _clique_entropy(t: float) -> str:
    d = f"((1 + (n - 1) * exp(-{t} * n)) / n)"
    big, small = f"(1 / ({d} * n))", f"(exp(-{t} * n) / ({d} * n))"
    return f"-({big} * ln({big}) + (n - 1) * CASE WHEN {small} > 1e-8 THEN {small} * ln({small}) ELSE 0 END)"


@query("kle_complete_graph", with_pairs(GRADED, f" SELECT qid, round({_clique_entropy(0.3)}, 6) + 0.0 AS heat, round({_clique_entropy(0.3)} / ln(n), 6) + 0.0 AS heat_scaled FROM m"))
def kle_complete_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The unweighted graph is complete, so its entropies follow from the number of answers alone."""
    g = graded(spark, sf).select("qid", graph.complete_edges(L).alias("g"))
    e = spectral.kernel_scores(g, {"g": ""})
    return e.select("qid", r6(F.col("entropies")["heat_t=0.3_kernel_entropy"]).alias("heat"), r6(F.col("entropies")["heat_t=0.3_kernel_entropy_s"]).alias("heat_scaled"))


@query("kle_entropies")
def kle_entropies(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.explode_entropies(P.score(set_a(spark, sf), labels(spark, GRADED), "kle"))
    return found.select("qid", "uq_column", r6("uq").alias("uq"))


# --- nearest-neighbour entailment and density ------------------------------------------------------------------


def _luq(name: str, worth: str, **options) -> None:
    sql = with_pairs(GRADED, f" SELECT qid, round(avg(1 - b), 6) + 0.0 AS luq FROM (SELECT qid, i, max(CASE WHEN i = j THEN 0.0 ELSE {worth} END) AS b FROM p GROUP BY qid, i) GROUP BY qid")
    query(name, sql)(lambda spark, sf: graded(spark, sf).select("qid", r6(S.pair_score(S.entailment_similarity(L, **options))).alias("luq")))


_E = lambda x, half: f"CASE {x} WHEN 2 THEN 1.0 WHEN 1 THEN {half} ELSE 0.0 END"
_luq("luq_pair", _E("l", "0.0"))
_luq("luq_pair_neutral", _E("l", "0.5"), neutral=True)
_luq("luq_pair_bidir", f"({_E('l', '0.0')} + {_E('r', '0.0')}) / 2", both=True)

_CONT = lambda l, c: f"CASE {l} WHEN 2 THEN {c} WHEN 1 THEN {c} / 2 ELSE 0.0 END"
_SIM = f",\nsim AS (SELECT qid, i, j, CASE WHEN ti = tj THEN 1.0 ELSE ({_CONT('l', 'c')} + {_CONT('r', 'rc')}) / 2 END AS s FROM p)"
_SIM1 = f",\nsim AS (SELECT qid, i, j, CASE WHEN ti = tj THEN 1.0 WHEN i < j THEN {_CONT('l', 'c')} ELSE {_CONT('r', 'rc')} END AS s FROM p)"


@query("cont_similarity", with_pairs(GRADED, _SIM + " SELECT qid, i, j, round(s, 6)::DOUBLE AS s FROM sim"))
def cont_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return cells(graded(spark, sf), S.continuous_similarity(A, L, C), "s")


@query("cont_luq", with_pairs(GRADED, _SIM1 + " SELECT qid, round(avg(1 - b), 6) + 0.0 AS luq FROM (SELECT qid, i, max(CASE WHEN i = j THEN 0.0 ELSE s END) AS b FROM sim GROUP BY qid, i) GROUP BY qid"))
def cont_luq(spark: SparkSession, sf: str) -> DataFrame:
    return P.score(set_a(spark, sf), labels(spark, GRADED), "continuous_luq").select("qid", r6("luq_pair").alias("luq"))


def _density_sql(k: str) -> str:
    # Densities are sums of products of short decimals, so halves of the sixth place occur; 1e-9 more rounds them alike.
    return with_pairs(
        GRADED,
        f",\nf AS (SELECT a.qid, t, count(*) / any_value(n)::DOUBLE AS f FROM a JOIN m USING (qid) GROUP BY a.qid, t),\n"
        f"u AS (SELECT DISTINCT qid, ti, tj, CASE WHEN ti = tj THEN 1.0 ELSE {k} END AS k FROM p)\n"
        " SELECT u.qid, round(sum(x.f * k * y.f) + 1e-9, 6) + 0.0 AS density, round(1 - sum(x.f * k * y.f) + 1e-9, 6) + 0.0 AS uncertainty FROM u JOIN f x ON x.qid = u.qid AND x.t = ti JOIN f y ON y.qid = u.qid AND y.t = tj GROUP BY u.qid",
    )


_FAR = lambda x, mid: f"CASE {x} WHEN 2 THEN 0.0 WHEN 1 THEN {mid} ELSE 1.0 END"
_NEAR = lambda l, c: f"(1 - CASE {l} WHEN 2 THEN 1.5 * (1 - {c}) / 2 WHEN 1 THEN (1 - {c}) / 2 + {c} / 2 ELSE {c} + (1 - {c}) / 4 END)"


def _density(name: str, sql: str, method: str, **options) -> None:
    query(name, _density_sql(sql))(
        lambda spark, sf: P.score(set_a(spark, sf), labels(spark, GRADED), method, **options).select("qid", r6(F.col("semantic_density") + 1e-9).alias("density"), r6(F.col("semantic_density_uncertainty") + 1e-9).alias("uncertainty"))
    )


_density("density_discrete", f"greatest(0, 1 - greatest({_FAR('l', 0.5)}, {_FAR('r', 0.5)}))", "discrete_semantic_density")
_density("density_discrete_strict", f"greatest(0, 1 - greatest({_FAR('l', 1.0)}, {_FAR('r', 1.0)}))", "discrete_semantic_density", strict=True)
_density("density_continuous", f"({_NEAR('l', 'c')} + {_NEAR('r', 'rc')}) / 2", "continuous_semantic_density")
_density("density_continuous_compat", "0.75", "continuous_semantic_density", compat=True)


@query("answer_frequencies", with_pairs(GRADED, " SELECT a.qid, t AS answer, round(count(*) / any_value(n)::DOUBLE, 6) AS f FROM a JOIN m USING (qid) GROUP BY a.qid, t"))
def answer_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    rows = set_a(spark, sf).select("qid", F.explode(F.arrays_zip(S.unique_answers(A).alias("t"), S.frequencies(A).alias("f"))).alias("x"))
    return rows.select("qid", F.col("x.t").alias("answer"), F.round("x.f", 6).alias("f"))


# --- neighbour contrast ----------------------------------------------------------------------------------------

_LOSS = {"full": "num - den", "only_num": "num", "only_denom": "den", "num_minus_denom": "ln(2 * exp(num) - exp(den) + exp(1.0) * n)"}
for _v, _e in _LOSS.items():
    query(
        f"snne_{_v}",
        with_pairs(
            GRADED,
            _STEPS.format(same=LOOSE)
            + f",\nc AS (SELECT qid, unnest(ids) AS c, unnest(range(n)) AS i FROM ids),\nx AS (SELECT p.qid, p.i, CASE WHEN ti = tj THEN 1.0 ELSE 0.0 END AS s, u.c = v.c AS own FROM p JOIN c u ON u.qid = p.qid AND u.i = p.i JOIN c v ON v.qid = p.qid AND v.i = p.j),\n"
            f"y AS (SELECT qid, i, ln(sum(exp(s)) FILTER (own)) AS num, ln(sum(exp(s))) AS den FROM x GROUP BY qid, i)\n SELECT y.qid, round(-avg({_e}), 6) + 0.0 AS snne FROM y JOIN m ON m.qid = y.qid GROUP BY y.qid",
            True,
        ),
    )(lambda spark, sf, v=_v: P.score(set_a(spark, sf), labels(spark, GRADED), "discrete_snne", variant=v).select("qid", r6("snne").alias("snne")))

# A single answer has no neighbours: its loss is infinite or no number (null in these queries), or that of the least difference.
_CLOSS = {"full": "num - den", "only_num": "num", "only_denom": "den", "num_minus_denom": "ln(greatest(exp(num) - exp(den), 1e-8))"}
for _v, _e in _CLOSS.items():
    query(
        f"cont_snne_{_v}",
        with_pairs(
            GRADED,
            _SIM + f",\ny AS (SELECT qid, i, ln(sum(exp(s + ln(least(greatest(s, 0), 1) + 1e-8)))) AS num, ln(sum(exp(s + ln(1 + 1e-8)))) AS den FROM sim WHERE i <> j GROUP BY qid, i)\n SELECT m.qid, round(-avg({_e}), 6) + 0.0 AS snne FROM m LEFT JOIN y ON y.qid = m.qid GROUP BY m.qid",
        ),
    )(lambda spark, sf, v=_v: P.score(set_a(spark, sf), labels(spark, GRADED), "continuous_snne", variant=v).select("qid", r6(F.when(F.abs("snne") < 1e300, F.col("snne"))).alias("snne")))


# --- texts -----------------------------------------------------------------------------------------------------

_PUNCT = T.PUNCTUATION.replace("'", "''")


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def _norm_words(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '{_PUNCT}', ' ', 'g'), '\\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the'))"


def _norm(x: str) -> str:
    return f"array_to_string({_norm_words(x)}, ' ')"


def _overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda z: z = g)), len(list_filter({b}, lambda z: z = g))))), 0)"


def _f1(same: str, a: str, b: str) -> str:
    return f"CASE WHEN {same} > 0 THEN 2.0 * {same} / (len({a}) + len({b})) ELSE 0.0 END"


def _grams(a: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({a}) - {n} + 2, 1)), lambda i: array_to_string({a}[i:i + {n - 1}], ' '))"


@query("normalize_answer", f"SELECT conv_id, turn, {_norm('text')} AS normal FROM conversations")
def normalize_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "conversations").select("conv_id", "turn", T.normalize_answer(F.col("text")).alias("normal"))


_SPACES = "text"
for _p, _t in T.SPACING:
    _SPACES = f"regexp_replace({_SPACES}, '{_p}', '{_t.replace('$', chr(92))}', 'g')"


@query("remove_extra_spaces", f"SELECT conv_id, turn, trim({_SPACES}) AS tidy FROM (SELECT conv_id, turn, replace(text, ',', ' ( , ) ') AS text FROM conversations)")
def remove_extra_spaces(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "conversations").withColumn("text", F.replace("text", F.lit(","), F.lit(" ( , ) ")))
    return rows.select("conv_id", "turn", T.remove_extra_spaces(F.col("text")).alias("tidy"))


_C = """WITH {r}s AS (SELECT x.conv_id AS qid, x.answers, y.refs FROM (SELECT conv_id, list(text ORDER BY turn) AS answers FROM conversations WHERE role = 'assistant' GROUP BY conv_id) x
JOIN (SELECT conv_id, list(text ORDER BY turn) AS refs FROM conversations WHERE role = 'user' GROUP BY conv_id) y ON x.conv_id = y.conv_id),
o AS (SELECT qid, unnest(answers) AS a, unnest(range(len(answers))) AS i, len(answers) AS n, answers FROM s),
v0 AS (SELECT qid, {na} AS a, count(*) AS c FROM o GROUP BY 1, 2),
v AS (SELECT qid, CASE WHEN count(*) FILTER (c = top) = 1 THEN max(a) FILTER (c = top) END AS mode FROM (SELECT *, max(c) OVER (PARTITION BY qid) AS top FROM v0) GROUP BY qid),
q AS (SELECT s.qid, coalesce(nullif(mode, ''), {first}) AS prediction, answers, refs FROM s JOIN v ON v.qid = s.qid),
b AS (SELECT qid, prediction, unnest(refs) AS ref, unnest(range(len(refs))) AS k FROM q)"""


def with_c(more: str, recursive: bool = False) -> str:
    return _C.format(na=_norm("a"), first=_norm("answers[1]"), r="RECURSIVE " if recursive else "") + more


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    return set_c(spark, sf).select("qid", votes.prediction(A).alias("prediction"), "refs")


@query("majority_vote", with_c(" SELECT qid, prediction FROM q"))
def majority_vote(spark: SparkSession, sf: str) -> DataFrame:
    return predicted(spark, sf).select("qid", "prediction")


def _best(name: str, sql: str, measure: Callable[[Column, Column], Column]) -> None:
    query(name, with_c(sql))(lambda spark, sf: predicted(spark, sf).select("qid", r6(T.best(F.col("refs"), lambda r: measure(F.col("prediction"), r).cast("double"))).alias(name)))


_best("exact_match", f" SELECT qid, max(contains({_norm('prediction')}, {_norm('ref')})::INT)::DOUBLE AS exact_match FROM b GROUP BY qid", T.exact_match)
_best("token_f1", f", w AS (SELECT qid, {_norm_words('prediction')} AS x, {_norm_words('ref')} AS y FROM b) SELECT qid, round(max({_f1(_overlap('x', 'y'), 'x', 'y')}), 6)::DOUBLE AS token_f1 FROM w GROUP BY qid", T.token_f1)
for _n in (1, 2):
    _best(
        f"rouge_{_n}",
        f", w AS (SELECT qid, {_words('prediction')} AS x, {_words('ref')} AS y FROM b), g AS (SELECT qid, {_grams('x', _n)} AS x, {_grams('y', _n)} AS y FROM w) SELECT qid, round(max({_f1(_overlap('x', 'y'), 'x', 'y')}), 6)::DOUBLE AS rouge_{_n} FROM g GROUP BY qid",
        lambda p, r, n=_n: T.rouge_n(p, r, n),
    )

# Longest common subsequence, a word of the prediction a step: row[j] = max(row[j], row[k - 1] + 1 for k <= j with y[k] equal).
_LCS = f""",
w AS (SELECT qid, k, {_words('prediction')} AS x, {_words('ref')} AS y FROM b),
t(qid, k, i, x, y, row) AS (
 SELECT qid, k, 1::BIGINT, x, y, list_transform(range(len(y) + 1), lambda z: 0::BIGINT) FROM w
 UNION ALL
 SELECT qid, k, i + 1, x, y, list_transform(range(len(y) + 1), lambda j: greatest(row[j + 1], coalesce(list_max(list_transform(list_filter(range(1, j + 1), lambda h: y[h] = x[i]), lambda h: row[h] + 1)), 0))) FROM t WHERE i <= len(x)),
z AS (SELECT qid, k, x, y, row[len(y) + 1] AS lcs FROM t WHERE i = len(x) + 1)"""
query("rouge_l", with_c(_LCS + f" SELECT qid, round(max({_f1('lcs', 'x', 'y')}), 6)::DOUBLE AS rouge_l FROM z GROUP BY qid", True))(
    lambda spark, sf: predicted(spark, sf).select("qid", r6(T.best(F.col("refs"), lambda r: T.rouge_l(F.col("prediction"), r))).alias("rouge_l"))
)

_BLEU_COUNTS = (
    f",\nw AS (SELECT qid, {_words('prediction')} AS x, list_transform(refs, lambda ref: {_words('ref')}) AS ys FROM q),\n"
    + "g AS (SELECT qid, x, ys, "
    + ", ".join(f"{_grams('x', n)} AS x{n}, list_transform(ys, lambda y: {_grams('y', n)}) AS y{n}" for n in (1, 2, 3, 4))
    + " FROM w),\nh AS (SELECT qid, len(x) AS c, list_sort(list_transform(ys, lambda y: [abs(len(y) - len(x)), len(y)]))[1][2] AS r, "
    + ", ".join(
        f"coalesce(list_sum(list_transform(list_distinct(x{n}), lambda u: least(len(list_filter(x{n}, lambda z: z = u)), list_max(list_transform(y{n}, lambda y: len(list_filter(y, lambda z: z = u))))))), 0) AS h{n}, len(x{n}) AS t{n}"
        for n in (1, 2, 3, 4)
    )
    + " FROM g)"
)
_BLEU = "CASE WHEN h1 = 0 OR c = 0 THEN 0.0 ELSE (CASE WHEN c > r THEN 1.0 ELSE exp(1 - r / c::DOUBLE) END) * exp(0.25 * (" + " + ".join(f"ln((CASE WHEN h{n} = 0 THEN 0.1 ELSE h{n} END) / greatest(t{n}, 1)::DOUBLE)" for n in (1, 2, 3, 4)) + ")) END"


@query("sentence_bleu", with_c(_BLEU_COUNTS + f" SELECT qid, round({_BLEU}, 6)::DOUBLE AS bleu FROM h"))
def sentence_bleu(spark: SparkSession, sf: str) -> DataFrame:
    return predicted(spark, sf).select("qid", r6(T.sentence_bleu(F.col("prediction"), F.col("refs"))).alias("bleu"))


_SUMS = ", ".join(f"sum({x}) AS {x}" for x in ("c", "r", "h1", "h2", "h3", "h4", "t1", "t2", "t3", "t4"))


@query("corpus_bleu", with_c(_BLEU_COUNTS + f" SELECT round(100 * {_BLEU}, 6)::DOUBLE AS corpus_bleu FROM (SELECT {_SUMS} FROM h)"))
def corpus_bleu(spark: SparkSession, sf: str) -> DataFrame:
    return reports.corpus_bleu(predicted(spark, sf)).select(r6("corpus_bleu").alias("corpus_bleu"))


_QUALITY = (
    _LCS
    + f",\ne AS (SELECT qid, max(contains({_norm('prediction')}, {_norm('ref')})::INT) AS em FROM b GROUP BY qid),\nf0 AS (SELECT qid, {_norm_words('prediction')} AS x, {_norm_words('ref')} AS y FROM b),\nf AS (SELECT qid, max({_f1(_overlap('x', 'y'), 'x', 'y')}) AS f1 FROM f0 GROUP BY qid),\n"
    f"l AS (SELECT qid, max({_f1('lcs', 'x', 'y')}) AS rl FROM z GROUP BY qid)"
)


@query(
    "qa_report",
    with_c(_QUALITY + " SELECT round(100 * avg(em), 6)::DOUBLE AS average_exact_match, round(100 * avg(f1), 6)::DOUBLE AS average_f1, round(100 * avg(em), 6)::DOUBLE AS average_accuracy, round(100 * avg(rl), 6)::DOUBLE AS average_rougel, count(*) AS number_of_questions FROM e JOIN f USING (qid) JOIN l USING (qid)", True),
)
def qa_report(spark: SparkSession, sf: str) -> DataFrame:
    c = set_c(spark, sf)
    found = evaluate.quality(c.select("qid", "refs"), c.select("qid", "answers", "ordinal"), "triviaqa")
    return evaluate.report(found, "triviaqa").select(*[r6(x).alias(x) for x in ("average_exact_match", "average_f1", "average_accuracy", "average_rougel")], "number_of_questions")


@query(
    "summary_report",
    with_c(
        _LCS.replace("\nw AS", "\nw AS")
        + f",\nl AS (SELECT qid, max({_f1('lcs', 'x', 'y')}) AS rl FROM z GROUP BY qid),\n"
        + ",\n".join(f"n{n} AS (SELECT qid, max({_f1(_overlap('x', 'y'), 'x', 'y')}) AS r{n} FROM (SELECT qid, {_grams('x', n)} AS x, {_grams('y', n)} AS y FROM w) GROUP BY qid)" for n in (1, 2))
        + _BLEU_COUNTS.replace("\nw AS", "\nw2 AS").replace("FROM w)", "FROM w2)")
        + f" SELECT round(100 * avg(r1), 6)::DOUBLE AS average_rouge_1, round(100 * avg(r2), 6)::DOUBLE AS average_rouge_2, round(100 * avg(rl), 6)::DOUBLE AS average_rouge_l, round(100 * avg({_BLEU}), 6)::DOUBLE AS average_bleu, count(*) AS number_of_questions FROM h JOIN l USING (qid) JOIN n1 USING (qid) JOIN n2 USING (qid)",
        True,
    ),
)
def summary_report(spark: SparkSession, sf: str) -> DataFrame:
    c = set_c(spark, sf)
    found = evaluate.quality(c.select("qid", "refs"), c.select("qid", "answers", "ordinal"), "xsum")
    return evaluate.report(found, "xsum").select(*[r6(x).alias(x) for x in ("average_rouge_1", "average_rouge_2", "average_rouge_l", "average_bleu")], "number_of_questions")


_TIDY = "array_to_string(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> ''), ' ')"
_PAIRS = f""",
o2 AS (SELECT qid, {_words(_TIDY.format(x="a"))} AS w, i FROM o),
w AS (SELECT x.qid, x.i * 1000 + y.i AS k, x.w AS x, y.w AS y FROM o2 x JOIN o2 y ON x.qid = y.qid AND x.i < y.i)""" + _LCS[_LCS.index(",\nt(qid") :]


@query(
    "lexical_rouge_l",
    with_c(
        _PAIRS
        + f",\nsim AS (SELECT qid, k // 1000 AS i, k % 1000 AS j, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 ELSE {_f1('lcs', 'x', 'y')} END AS s FROM z)\n"
        " SELECT qid, i, j, round(s, 6)::DOUBLE AS s FROM sim UNION ALL SELECT qid, j, i, round(s, 6)::DOUBLE FROM sim UNION ALL SELECT qid, i, i, 1.0::DOUBLE FROM o",
        True,
    ),
)
def lexical_rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    return cells(set_c(spark, sf), S.lexical_matrix(A), "s")


@query(
    "consistency_exact",
    with_pairs(GRADED, " SELECT qid, round(coalesce(avg(CASE WHEN i > 0 THEN (t = f)::INT END), 1), 6)::DOUBLE AS exact_match FROM (SELECT *, first_value(t) OVER (PARTITION BY qid ORDER BY i) AS f FROM a) GROUP BY qid"),
)
def consistency_exact(spark: SparkSession, sf: str) -> DataFrame:
    return set_a(spark, sf).select("qid", r6(T.exact_match_confidence(A)).alias("exact_match"))


@query(
    "consistency_cosine",
    "WITH e AS (SELECT label, vec_id, embedding AS v, first_value(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS f, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), "
    "d AS (SELECT label, k, (list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i]::DOUBLE * f[i]::DOUBLE)) / (sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(f, lambda x: x::DOUBLE * x::DOUBLE)))) + 1) / 2 AS c FROM e) "
    "SELECT label AS qid, round(coalesce(avg(c) FILTER (k > 1), 1), 6)::DOUBLE AS cosine FROM d GROUP BY label",
)
def consistency_cosine(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "embeddings")
    sets = rows.groupBy(F.col("label").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("v"))
    return sets.select("qid", r6(S.cosine_consistency(F.col("v"))).alias("cosine"))


@query("entailment_parse", "SELECT event_id, CASE WHEN contains(lower(t), 'entailment') THEN 2 WHEN contains(lower(t), 'neutral') THEN 1 WHEN contains(lower(t), 'contradiction') THEN 0 ELSE 1 END AS label FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'It is Entailment, not neutral' WHEN 'error' THEN 'NEUTRAL or contradiction' WHEN 'view' THEN 'contradiction.' ELSE event_type END AS t FROM events)")
def entailment_parse(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    reply = F.when(kind == "click", "It is Entailment, not neutral").when(kind == "error", "NEUTRAL or contradiction").when(kind == "view", "contradiction.").otherwise(kind)
    return _read(spark, sf, "events").select("event_id", T.entailment_label(reply).alias("label"))


@query("thinking_split", "SELECT event_id, CASE WHEN e % 3 = 0 THEN event_type ELSE '' END AS thinking, CASE e % 3 WHEN 0 THEN props WHEN 1 THEN '<think>' || event_type || props ELSE props END AS answer FROM (SELECT event_id, event_id AS e, event_type, props FROM events)")
def thinking_split(spark: SparkSession, sf: str) -> DataFrame:
    e, k, p = F.col("event_id"), F.col("event_type"), F.col("props")
    raw = F.when(e % 3 == 0, F.concat(F.lit("<think> "), k, F.lit("</think>\n"), p)).when(e % 3 == 1, F.concat(F.lit("<think>"), k, p)).otherwise(p)
    return _read(spark, sf, "events").select("event_id", T.thinking(raw).alias("x")).select("event_id", F.trim(F.regexp_replace("x.thinking", "\n", "")).alias("thinking"), F.regexp_replace("x.answer", "^\n", "").alias("answer"))


@query("prompts", "SELECT conv_id, turn, 'Output a short answer with minimum words' AS system, 'Context: ' || role || '\nQuestion: ' || text AS question FROM conversations")
def prompt_rows(spark: SparkSession, sf: str) -> DataFrame:
    m = prompts.prompt("squad", F.col("text"), F.col("role"))
    return _read(spark, sf, "conversations").select("conv_id", "turn", F.get(m, F.lit(0))["content"].alias("system"), F.get(m, F.lit(1))["content"].alias("question"))


@query("truncate_text", "SELECT doc_id, substr(text, 1, 400) AS start FROM documents")
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "documents").select("doc_id", T.truncate_chars(F.col("text"), 100).alias("start"))


# --- numbers ---------------------------------------------------------------------------------------------------

_NUM = "'-?\\d+(?:,\\d{3})*(?:\\.\\d+)?(?:[eE][+-]?\\d+)?'"


def _num_sql(expr: str, x: str) -> str:
    return f"SELECT l_orderkey, l_linenumber, round({expr}, 6)::DOUBLE AS v FROM (SELECT l_orderkey, l_linenumber, {x} AS t FROM lineitem)"


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "lineitem").withColumns({"q": F.col("l_quantity").cast("int").cast("string"), "p": F.col("l_linenumber").cast("string")})


_Q, _PN = "CAST(CAST(l_quantity AS INT) AS VARCHAR)", "CAST(l_linenumber AS VARCHAR)"


@query("numeric_last", _num_sql(f"CAST(replace(regexp_extract_all(t, {_NUM})[-1], ',', '') AS DOUBLE)", f"'pay ' || {_PN} || ' then 1,' || lpad({_Q}, 3, '0') || ' dollars'"))
def numeric_last(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.lit("pay "), "p", F.lit(" then 1,"), F.lpad("q", 3, "0"), F.lit(" dollars"))
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", r6(N.to_number(t)).alias("v"))


@query("numeric_first", _num_sql(f"CAST(replace(regexp_extract_all(t, {_NUM})[1], ',', '') AS DOUBLE)", f"'about ' || {_Q} || '.5 or ' || {_PN}"))
def numeric_first(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", r6(N.first_number(F.concat(F.lit("about "), "q", F.lit(".5 or "), "p"))).alias("v"))


@query("numeric_fraction", f"SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS INT) / l_linenumber::DOUBLE, 6)::DOUBLE AS v FROM lineitem")
def numeric_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", r6(N.to_number(F.concat(F.lit("so "), "q", F.lit(" / "), "p"))).alias("v"))


@query(
    "numeric_final_answer",
    "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN q WHEN 1 THEN q + 1 WHEN 2 THEN q + 2 WHEN 3 THEN q WHEN 4 THEN q WHEN 5 THEN NULL ELSE 3 END::DOUBLE AS v FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem)",
)
def numeric_final_answer(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber") % 7
    plus = lambda n: (F.col("l_quantity").cast("int") + n).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("2 + 2 = 4\n#### $"), "q", F.lit("\n9")))
        .when(k == 1, F.concat(F.lit("first <<1+1=2>> then <<"), plus(1), F.lit(">> 8")))
        .when(k == 2, F.concat(F.lit("thus \\boxed{"), plus(2), F.lit("} and 5")))
        .when(k == 3, F.concat(F.lit("7 apples.\nThe final answer is "), "q", F.lit(" of 9")))
        .when(k == 4, F.concat(F.lit("3 + 4\nSo, he earns "), "q", F.lit(" dollars")))
        .when(k == 5, F.concat(F.lit("he has "), "q", F.lit(" = 9 x 2")))
        .otherwise(F.lit("it costs 3"))
    )
    return _lines(spark, sf).select("l_orderkey", "l_linenumber", r6(N.final_answer(text, True)).alias("v"))


@query(
    "numeric_vote",
    "WITH o AS (SELECT l_orderkey AS qid, round_even(l_quantity % 4 / 3, 6) AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem), "
    "c AS (SELECT qid, v, count(*) AS n, min(k) AS k FROM o GROUP BY qid, v) SELECT qid, max_by(v, n * 1000 - k)::DOUBLE AS v FROM c GROUP BY qid",
)
def numeric_vote(spark: SparkSession, sf: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", (F.col("l_quantity") % 4 / 3).alias("v"))
    rows = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["v"]).alias("v"))
    return rows.select("qid", votes.numeric_majority(F.col("v")).alias("v"))


@query("numeric_accuracy", "SELECT l_orderkey, l_linenumber, (abs(l_discount - l_tax) <= 0.1)::INT AS a, coalesce((abs(l_discount - nullif(l_tax, 0)) <= 1e-6)::INT, 0) AS b FROM lineitem")
def numeric_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    d, t = F.col("l_discount"), F.col("l_tax")
    return _read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.close_enough(d, t, 0.1).alias("a"), N.close_enough(d, F.when(t != 0, t), 1e-6).alias("b"))


# --- joins -----------------------------------------------------------------------------------------------------


@query("last_answer_join", "SELECT d.doc_id AS qid, d.lang, e.event_type AS answer FROM documents d JOIN (SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id) e ON e.user_id = d.doc_id")
def last_answer_join(spark: SparkSession, sf: str) -> DataFrame:
    answers = _read(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_type").alias("answer"), F.col("event_id").alias("ordinal"))
    return joins.last_answers(_read(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "lang"), answers)


@query("first_uq_join", "SELECT l.doc_id AS qid, l.quality, e.value AS uq FROM labels l JOIN (SELECT user_id, min_by(value, event_id) AS value FROM events GROUP BY user_id) e ON e.user_id = l.doc_id")
def first_uq_join(spark: SparkSession, sf: str) -> DataFrame:
    scores = _read(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("value").alias("uq"), F.col("event_id").alias("ordinal"))
    return joins.first_scores(_read(spark, sf, "labels").select(F.col("doc_id").alias("qid"), "quality"), scores)


# --- ranking ---------------------------------------------------------------------------------------------------

_RANK = """,
r AS (SELECT *, rank() OVER (PARTITION BY uq_column ORDER BY uq DESC) + (count(*) OVER (PARTITION BY uq_column, uq) - 1) / 2.0 AS mid, row_number() OVER w AS k, count(*) OVER (PARTITION BY uq_column) AS n,
 avg(quality) OVER (w ROWS UNBOUNDED PRECEDING) AS m, CASE WHEN max(quality) OVER p > min(quality) OVER p THEN (quality - min(quality) OVER p) / (max(quality) OVER p - min(quality) OVER p) ELSE 0.5 END AS s
 FROM u WINDOW w AS (PARTITION BY uq_column ORDER BY uq, qid), p AS (PARTITION BY uq_column)),
q AS (SELECT *, avg(s) OVER (PARTITION BY uq_column ORDER BY uq, qid ROWS UNBOUNDED PRECEDING) AS ms, (quality::INT = 1)::INT AS pos FROM r)"""
_AUROC = "round((sum(pos * mid) - sum(pos) * (sum(pos) + 1) / 2.0) / nullif(sum(pos) * (count(*) - sum(pos)), 0), 6)::DOUBLE"
_AUARC = "round(sum(CASE WHEN k = 1 OR k = n THEN m / 2 ELSE m END) / (any_value(n) - 1), 6)::DOUBLE"
_PRR = "round(avg(ms), 6)::DOUBLE"
_DOCS = "WITH u AS (SELECT d.doc_id AS qid, 'n_chars' AS uq_column, d.n_chars::DOUBLE AS uq, l.quality::DOUBLE AS quality FROM documents d JOIN labels l USING (doc_id))"
_ORDERS = "WITH u AS (SELECT o_orderkey AS qid, o_orderstatus AS uq_column, (o_custkey % 97)::DOUBLE AS uq, o_totalprice::DOUBLE AS quality FROM orders)"


def _documents_scored(spark: SparkSession, sf: str) -> DataFrame:
    q = _read(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").cast("double").alias("quality"))
    s = _read(spark, sf, "documents").select(F.col("doc_id").alias("qid"), F.lit("n_chars").alias("uq_column"), F.col("n_chars").cast("double").alias("uq"))
    return s.join(q, "qid")


def _orders_scored(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), F.col("o_orderstatus").alias("uq_column"), (F.col("o_custkey") % 97).cast("double").alias("uq"), F.col("o_totalprice").cast("double").alias("quality"))


query("auroc", _DOCS + _RANK + f" SELECT {_AUROC} AS auroc FROM q")(lambda spark, sf: ranking.rank(_documents_scored(spark, sf)).select(r6("auroc").alias("auroc")))
query("auarc", _DOCS + _RANK + f" SELECT {_AUARC} AS auarc FROM q")(lambda spark, sf: ranking.rank(_documents_scored(spark, sf)).select(r6("auarc").alias("auarc")))
query("prr", _ORDERS + _RANK + f" SELECT uq_column, {_PRR} AS prr FROM q GROUP BY uq_column")(lambda spark, sf: ranking.rank(_orders_scored(spark, sf)).select("uq_column", r6("prr").alias("prr")))

_WIDE = "WITH u AS (SELECT d.doc_id AS qid, c.uq_column, CASE c.uq_column WHEN 'n_chars' THEN d.n_chars::DOUBLE ELSE 1 - (d.doc_id % 13) / 13.0 END::DOUBLE AS uq, l.quality::DOUBLE AS quality FROM documents d JOIN labels l USING (doc_id), (VALUES ('n_chars'), ('mod')) c(uq_column))"


@query(
    "uq_eval_long",
    _WIDE + _RANK + f", z AS (SELECT uq_column, count(*)::DOUBLE AS matched, {_AUROC} AS auroc, {_AUARC} AS auarc FROM q GROUP BY uq_column) SELECT uq_column, 'matched' AS metric, matched AS value FROM z UNION ALL SELECT uq_column, 'auroc', auroc FROM z UNION ALL SELECT uq_column, 'auarc', auarc FROM z",
)
def uq_eval_long(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "n_chars", (1 - (F.col("doc_id") % 13) / 13.0).alias("mod"))
    quality = _read(spark, sf, "labels").select(F.col("doc_id").alias("qid"), F.col("quality").cast("double").alias("quality"))
    return ranking.evaluate(docs, quality, ["n_chars", "mod"]).select("uq_column", "metric", r6("value").alias("value"))


@query("uq_resolve", "SELECT event_id AS qid, CASE WHEN event_type = 'view' THEN value ELSE event_id % 7 END::DOUBLE AS uq FROM events")
def uq_resolve(spark: SparkSession, sf: str) -> DataFrame:
    e = _read(spark, sf, "events").select(F.col("event_id").alias("qid"), F.when(F.col("event_type") == "view", F.col("value").cast("string")).otherwise("none").alias("wanted"), F.array((F.col("event_id") % 7).cast("double")).alias("entropy"))
    return e.select("qid", ranking.resolve_score(e, "wanted").alias("uq"))


@query("quality_binary", "SELECT o_orderkey AS qid, (o_totalprice >= 150000)::INT AS quality FROM orders")
def quality_binary(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "orders").select(F.col("o_orderkey").alias("qid"), ranking.binary_quality(F.col("o_totalprice"), 150000).alias("quality"))


@query(
    "oc_subset",
    "WITH u AS (SELECT d.doc_id AS qid, d.n_chars::DOUBLE AS uq, l.quality FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT quantile_cont(uq, 0.2) AS t, count(*) AS total FROM u) "
    "SELECT any_value(total) AS total, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality = 0 AND uq <= t) AS selected, round(any_value(t), 6) AS uq_threshold, round(count(*) FILTER (quality = 0 AND uq <= t) / count(*) FILTER (quality = 0)::DOUBLE, 4) AS ratio, "
    "array_to_string(list(qid::VARCHAR ORDER BY qid::VARCHAR) FILTER (quality = 0 AND uq <= t), ',') AS qids FROM u, c",
)
def oc_subset(spark: SparkSession, sf: str) -> DataFrame:
    found = subsets.with_ids(*subsets.confident_failures(_documents_scored(spark, sf)))
    return found.select("total", "bad", "selected", F.round("uq_threshold", 6).alias("uq_threshold"), "ratio", F.array_join("qids", ",").alias("qids"))


@query(
    "oc_subset_continuous",
    _ORDERS + ", c AS (SELECT uq_column, quantile_cont(uq, 0.2) AS t, quantile_cont(quality, 0.25) AS b, count(*) AS total FROM u GROUP BY uq_column) "
    "SELECT uq_column, any_value(total) AS total, count(*) FILTER (quality <= b) AS bad, count(*) FILTER (quality <= b AND uq <= t) AS selected, round(any_value(b), 4) AS quality_threshold, round(count(*) FILTER (quality <= b AND uq <= t) / count(*) FILTER (quality <= b)::DOUBLE, 4) AS ratio FROM u JOIN c USING (uq_column) GROUP BY uq_column",
)
def oc_subset_continuous(spark: SparkSession, sf: str) -> DataFrame:
    found, _ = subsets.confident_failures(_orders_scored(spark, sf), continuous=True, by=("uq_column",))
    return found.select("uq_column", "total", "bad", "selected", F.round("quality_threshold", 4).alias("quality_threshold"), "ratio")


from plumbline.plans import data_queries  # noqa: E402, F401  (registers its queries here)

"""More registered queries: files of the known data sets written from the test tables and read by their sources, evaluators of the
data sets, evaluation by method, and spectral scores where graphs are unions of cliques, so that closed forms exist."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import graph, pairs, ranking, spectral, subsets, votes
from plumbline.operators.stored import shared_folder
from plumbline.plans import evaluate, providers
from plumbline.plans import score as P
from plumbline.plans.queries import (
    _AUARC, _AUROC, _BLEU, _BLEU_COUNTS, _DOCS, _FAR, _RANK, _SIM, _SUMS, A, EXACT, GRADED, L, SQL, _C, _documents_scored, _norm, _read, exact, labels, query, r6, set_a, set_c, summary_report, qa_report, with_pairs,
)
from plumbline.sources import answers, documents, gold


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _joined(refs: Column | str) -> Column:
    return F.array_join(refs, "|")


# --- files -----------------------------------------------------------------------------------------------------


@query("scan_answers", "SELECT conv_id::VARCHAR AS qid, array_to_string(list(text ORDER BY turn), '|') AS answers, (row_number() OVER (ORDER BY conv_id) - 1)::INT AS ordinal FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def scan_answers(spark: SparkSession, sf: str) -> DataFrame:
    sets = pairs.answer_sets(_read(spark, sf, "conversations").where("role = 'assistant'"), "conv_id", "text", ["turn"], question=F.lit("é?"))
    at = _place(spark, "answers")
    answers.write_answers(sets.withColumn("ordinal", F.col("qid")), at, {"repeat": 10})
    return answers.read_answers(spark, at).select("qid", _joined("answers").alias("answers"), "ordinal")


def _document(spark: SparkSession, rows: DataFrame, element: Column, key: str | None, order: str) -> str:
    at = _place(spark, key or "list")
    head, tail = ("[", "]") if key is None else (f'{{"{key}": [', "]}")
    documents.write_document(rows.select(element.alias("element"), order), at, head, tail, [order])
    return at


@query("scan_triviaqa", f"SELECT c_custkey::VARCHAR AS qid, c_name AS question, lower(c_mktsegment) || '|' || {_norm('c_name')} AS refs FROM customer")
def scan_triviaqa(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.struct(F.array(F.lower("c_mktsegment")).alias("NormalizedAliases"), F.array(F.concat(F.lit("The "), "c_name"), F.col("c_mktsegment")).alias("HumanAnswers"))
    element = F.to_json(F.struct(F.col("c_custkey").cast("string").alias("QuestionId"), F.col("c_name").alias("Question"), answer.alias("Answer")))
    found = gold.trivia(spark, _document(spark, _read(spark, sf, "customer"), element, "Data", "c_custkey"))
    return found.select("qid", "question", _joined("refs").alias("refs"))


@query(
    "scan_coqa",
    "WITH a AS (SELECT conv_id, turn - 1 AS turn, " + _norm("text") + " AS x, " + _norm("substr(text, 1, 20)") + " AS y FROM conversations WHERE role = 'assistant') "
    "SELECT u.conv_id || '/' || u.turn AS qid, u.text AS question, CASE WHEN a.x IS NULL THEN '' WHEN x = y THEN x ELSE x || '|' || y END AS refs FROM conversations u LEFT JOIN a USING (conv_id, turn) WHERE role = 'user'",
)
def scan_coqa(spark: SparkSession, sf: str) -> DataFrame:
    c = _read(spark, sf, "conversations")
    turn = F.col("turn").cast("int")
    asked = F.when(F.col("role") == "user", F.struct(turn.alias("turn_id"), F.col("text").alias("input_text")))
    told = F.when(F.col("role") == "assistant", F.struct((turn - 1).alias("turn_id"), F.col("text").alias("input_text"), F.substring("text", 1, 20).alias("span_text")))
    stories = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(asked)).alias("questions"), F.array_sort(F.collect_list(told)).alias("answers"))
    element = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("story").alias("story"), "questions", "answers"))
    found = gold.coqa(spark, _document(spark, stories, element, "data", "conv_id"))
    return found.select("qid", "question", _joined("refs").alias("refs"))


@query("scan_squad", f"SELECT p_partkey::VARCHAR AS qid, p_type AS question, p_name AS context, {_norm('p_brand')} AS refs FROM part WHERE p_size % 4 <> 0")
def scan_squad(spark: SparkSession, sf: str) -> DataFrame:
    texts = F.when(F.col("p_size") % 4 != 0, F.array(F.struct(F.col("p_brand").alias("text")), F.struct(F.concat(F.lit("the "), "p_brand").alias("text")))).otherwise(F.array().cast("array<struct<text:string>>"))
    qas = F.array(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_type").alias("question"), texts.alias("answers")))
    element = F.to_json(F.struct(F.array(F.struct(F.col("p_name").alias("context"), qas.alias("qas"))).alias("paragraphs")))
    found = gold.squad(spark, _document(spark, _read(spark, sf, "part"), element, "data", "p_partkey"))
    return found.select("qid", "question", "context", _joined("refs").alias("refs"))


@query("scan_bioasq", f"SELECT p_partkey::VARCHAR AS qid, {_norm('p_name')} || '|' || {_norm('p_brand')} || CASE WHEN p_size % 3 = 0 THEN '' ELSE '|' || {_norm('p_type')} END AS refs FROM part")
def scan_bioasq(spark: SparkSession, sf: str) -> DataFrame:
    """An exact answer is a text, a list or a list of lists; two files make one table."""
    part, kind = _read(spark, sf, "part"), F.col("p_size") % 3
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    answer = F.when(kind == 0, text("p_brand")).when(kind == 1, F.concat(F.lit("["), text("p_brand"), F.lit(","), text("p_type"), F.lit("]"))).otherwise(F.concat(F.lit("[["), text("p_brand"), F.lit("],["), text("p_type"), F.lit("]]")))
    element = F.concat(F.lit('{"id":'), text(F.col("p_partkey").cast("string")), F.lit(',"body":"q","ideal_answer":['), text("p_name"), F.lit('],"exact_answer":'), answer, F.lit("}"))
    files = [_document(spark, part.where(F.col("p_partkey") % 2 == k), element, "questions", "p_partkey") for k in (0, 1)]
    return gold.bioasq(spark, files).select("qid", _joined("refs").alias("refs"))


@query("scan_svamp", "SELECT p_partkey::VARCHAR AS qid, p_name || chr(10) || p_type AS question, p_retailprice AS gold FROM part")
def scan_svamp(spark: SparkSession, sf: str) -> DataFrame:
    element = F.to_json(F.struct(F.col("p_partkey").cast("string").alias("ID"), F.col("p_name").alias("Body"), F.col("p_type").alias("Question"), F.col("p_retailprice").alias("Answer")))
    return gold.svamp(spark, _document(spark, _read(spark, sf, "part"), element, None, "p_partkey"))


@query("scan_gsm8k", "SELECT o_orderkey::VARCHAR AS qid, o_orderstatus AS question, (1000 + o_custkey % 9)::DOUBLE AS gold FROM orders")
def scan_gsm8k(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "orders").select(F.col("o_orderstatus").alias("question"), F.concat(F.lit("7 #### 3\nthen #### $1,00"), (F.col("o_custkey") % 9).cast("string")).alias("answer"), F.col("o_orderkey").alias("ordinal"))
    return gold.gsm8k(rows)


@query("scan_nq", f"SELECT c_custkey::VARCHAR AS qid, 'who' AS question, c_name || ' lives (x),' AS context, {_norm('c_mktsegment')} AS refs, c_name || ' lives' AS long_answer, c_name AS candidate FROM customer WHERE c_nationkey <> 3")
def scan_nq(spark: SparkSession, sf: str) -> DataFrame:
    """The columnar format; rows without a short answer go."""
    short = F.when(F.col("c_nationkey") == 3, F.array(F.lit(""))).otherwise(F.array(F.concat(F.lit("The "), "c_mktsegment")))
    span = lambda a, b: F.struct(F.lit(a).alias("start_token"), F.lit(b).alias("end_token"))
    rows = _read(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.struct(F.lit("who").alias("text")).alias("question"),
        F.struct(F.struct(F.array(F.lit("<p>"), "c_name", F.lit("lives"), F.lit("( x )"), F.lit(",")).alias("token"), F.array(*[F.lit(k == 0) for k in range(5)]).alias("is_html")).alias("tokens")).alias("document"),
        F.struct(F.array(F.lit("a"), F.lit("b")).alias("id"), F.array(span(0, 3), span(-1, -1)).alias("long_answer"), F.array(F.struct(short.alias("text")), F.struct(F.array().cast("array<string>").alias("text"))).alias("short_answers")).alias("annotations"),
        F.struct(F.array(F.lit(1)).alias("start_token"), F.array(F.lit(2)).alias("end_token"), F.array(F.lit(True)).alias("top_level")).alias("long_answer_candidates"),
    )
    found = gold.natural_questions(rows).where(F.get("long_answers", F.lit(1)).isNull())
    return found.select("qid", "question", "context", _joined("refs").alias("refs"), F.get("long_answers", F.lit(0)).alias("long_answer"), F.get("candidates", F.lit(0))["text"].alias("candidate"))


def _summaries(dataset: str) -> None:
    source, target = gold.SUMMARIES[dataset]
    own_id = dataset in ("xsum", "cnn_dailymail")

    def rows(spark: SparkSession, sf: str) -> DataFrame:
        ids = [F.concat(F.lit("x"), "doc_id").alias("id")] if own_id else []
        docs = _read(spark, sf, "documents").select(*ids, F.col("text").alias(source), F.concat("lang", "source").alias(target), F.col("doc_id").alias("ordinal"))
        return gold.summaries(docs, dataset).select("qid", "question", _joined("refs").alias("refs"))

    query(f"scan_{dataset}", f"SELECT {chr(39) + 'x' + chr(39) + ' || ' if own_id else ''}doc_id::VARCHAR AS qid, text AS question, lang || source AS refs FROM documents")(rows)


for _d in gold.SUMMARIES:
    _summaries(_d)


@query("scan_wmt19", "SELECT doc_id::VARCHAR AS qid, text AS question, source AS refs FROM documents")
def scan_wmt19(spark: SparkSession, sf: str) -> DataFrame:
    rows = _read(spark, sf, "documents").select(F.struct(F.col("text").alias("cs"), F.col("source").alias("en")).alias("translation"), F.col("doc_id").alias("ordinal"))
    return gold.translations(rows, "cs-en").select("qid", "question", _joined("refs").alias("refs"))


@query("row_ordinals", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1)::BIGINT AS ordinal FROM orders")
def row_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    return gold.with_ordinal(_read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", F.col("ordinal").cast("long").alias("ordinal"))


@query("label_cache", with_pairs(EXACT, " SELECT DISTINCT ti AS text1, tj AS text2, CASE WHEN ti < tj THEN 2 ELSE 0 END AS label, 0.7::DOUBLE AS confidence FROM p WHERE ti <> tj"))
def label_cache(spark: SparkSession, sf: str) -> DataFrame:
    """A cache that does not exist is built by asking for every pair, and read back."""
    built = providers.cache_for(set_a(spark, sf), _place(spark, "cache"), lambda q, a, b: [(2 if x < y else 0, 0.7) for x, y in zip(a, b, strict=True)], steps=2)
    return built.select("text1", "text2", F.col("label").cast("int").alias("label"), "confidence")


# --- evaluators ------------------------------------------------------------------------------------------------


def _same_family(name: str, whole: Callable, reports: tuple[str, ...], columns: tuple[str, ...]) -> None:
    for dataset in reports:

        def rows(spark: SparkSession, sf: str, dataset: str = dataset) -> DataFrame:
            c = set_c(spark, sf)
            out = evaluate.run(c.select("qid", "refs"), c.select("qid", "answers", "ordinal"), dataset, task="qa")["report"]
            return out.select(*[r6(x).alias(x) for x in columns], "number_of_questions")

        query(f"report_{dataset}", SQL[name])(rows)


_same_family("qa_report", qa_report, ("coqa", "squad", "bioasq", "nq"), ("average_exact_match", "average_f1", "average_accuracy", "average_rougel"))
_same_family("summary_report", summary_report, ("aeslc", "cnn_dailymail", "multi_news"), ("average_rouge_1", "average_rouge_2", "average_rouge_l", "average_bleu"))


@query(
    "report_wmt19",
    _C.format(na=_norm("a"), first=_norm("answers[1]"), r="").replace("x.answers, y.refs FROM", f"x.answers, [{_norm('y.refs[1]')}] AS refs FROM")
    + _BLEU_COUNTS
    + f" SELECT round(100 * {_BLEU}, 6)::DOUBLE AS corpus_bleu, 'de-en' AS translation_direction FROM (SELECT {_SUMS} FROM h)",
)
def report_wmt19(spark: SparkSession, sf: str) -> DataFrame:
    c = set_c(spark, sf)
    one = c.select("qid", F.array(F.get("refs", F.lit(0))).alias("refs"))
    out = evaluate.run(one, c.select("qid", "answers", "ordinal"), "wmt19_de-en", task="qa")["report"]
    return out.select(r6("corpus_bleu").alias("corpus_bleu"), "translation_direction")


def _numbers(name: str, before: str, tolerance: float) -> None:
    def rows(spark: SparkSession, sf: str) -> DataFrame:
        order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.concat(F.lit(before), (F.col("l_quantity") % 4).cast("int").cast("string")).alias("v"))
        sets = _read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["v"]).alias("answers"), F.lit(0).alias("ordinal"))
        right = sets.select("qid", (F.col("qid") % 4).cast("double").alias("gold"))
        out = evaluate.run(right, sets, name, task="qa", model="GPT-4o-mini")["report"]
        return out.select(r6("average_accuracy").alias("average_accuracy"), r6("average_rougel").alias("average_rougel"), "number_of_questions")

    query(
        f"report_{name}",
        "WITH o AS (SELECT l_orderkey AS qid, (l_quantity % 4)::INT AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem), "
        "c AS (SELECT qid, v, count(*) AS n, min(k) AS k FROM o GROUP BY qid, v), p AS (SELECT qid, max_by(v, n * 1000 - k) AS v FROM c GROUP BY qid), "
        "r AS (SELECT round(100 * avg((v = qid % 4)::INT), 6)::DOUBLE AS a, count(*) AS n FROM p) SELECT a AS average_accuracy, a AS average_rougel, n AS number_of_questions FROM r",
    )(rows)


_numbers("svamp", "about ", 0.1)
_numbers("gsm8k", "5 + 6\n#### $", 1e-6)


@query(
    "majority_vote_empty",
    "WITH a AS (SELECT user_id * 100000 + k // 10 AS qid, CASE event_type WHEN 'click' THEN '' WHEN 'view' THEN '' ELSE event_type END AS t, k % 10 AS i FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k FROM events)),\n"
    "v AS (SELECT qid, t, count(*) AS c FROM a GROUP BY qid, t), w AS (SELECT qid, CASE WHEN count(*) = 1 THEN nullif(max(t), '') END AS mode FROM (SELECT *, max(c) OVER (PARTITION BY qid) AS top FROM v) WHERE c = top GROUP BY qid)\n"
    "SELECT qid, coalesce(mode, t) AS prediction FROM w JOIN a USING (qid) WHERE i = 0",
)
def majority_vote_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Where the most common answer is an article or a mark, so empty once normalised, the first answer stands."""
    blank = F.transform(A, lambda x: F.when(x == "click", "The").when(x == "view", "!?").otherwise(x))
    return set_a(spark, sf).select("qid", votes.prediction(blank).alias("prediction"))


# --- evaluation by method --------------------------------------------------------------------------------------

_VOTED = """,
v AS (SELECT qid, t, count(*) AS c FROM a GROUP BY qid, t), top AS (SELECT qid, CASE WHEN count(*) = 1 THEN max(t) END AS mode FROM (SELECT *, max(c) OVER (PARTITION BY qid) AS most FROM v) WHERE c = most GROUP BY qid),
acc AS (SELECT qid, (coalesce(mode, t) = 'click')::INT::DOUBLE AS quality FROM top JOIN a USING (qid) WHERE i = 0)"""


def _ranked(name: str, rows: list, method: str, scores: Callable[[DataFrame], DataFrame], columns: list[str], sql: str, **options) -> None:
    """The whole evaluation of a method's scores; its rows of the columns with a closed form."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        sets = set_a(spark, sf)
        given = sets.select("qid", F.array(F.lit("click")).alias("refs"))
        found = scores(P.score(sets, labels(spark, rows), method))
        out = evaluate.run(given, sets.withColumn("ordinal", F.lit(0)), "triviaqa", found, task="uq", method=method, **options)["ranking"]
        return out.where(F.col("uq_column").isin(columns)).select("uq_column", "metric", r6("value").alias("value"))

    query(
        name,
        with_pairs(rows, _VOTED + sql + ",\nu AS (SELECT qid, uq_column, uq, quality FROM x JOIN acc USING (qid))" + _RANK)
        + f", z AS (SELECT uq_column, count(*)::DOUBLE AS matched, {_AUROC} AS auroc, {_AUARC} AS auarc FROM q GROUP BY uq_column) SELECT uq_column, 'matched' AS metric, matched AS value FROM z UNION ALL SELECT uq_column, 'auroc', auroc FROM z UNION ALL SELECT uq_column, 'auarc', auarc FROM z",
    )(run)


_ranked(
    "uq_eval_kle", EXACT, "kle", lambda s: s, ["cluster_assignment_entropy"],
    ",\nx AS (SELECT qid, 'cluster_assignment_entropy' AS uq_column, round(-sum(f * ln(f)), 6) + 0.0 AS uq FROM (SELECT a.qid, t, count(*) / any_value(n)::DOUBLE AS f FROM a JOIN m USING (qid) GROUP BY a.qid, t) GROUP BY qid)",
    decimals=6,
)
_ranked(
    "uq_eval_continuous_gwc", GRADED, "continuous_gwc", lambda s: s.withColumn("u_deg", r6("u_deg")), ["u_deg"],
    _SIM + ",\nx AS (SELECT qid, 'u_deg' AS uq_column, round(1 - sum(s) / (any_value(n) * any_value(n)), 6)::DOUBLE + 0.0 AS uq FROM sim JOIN m USING (qid) GROUP BY qid)",
)
_ranked(
    "uq_eval_density", GRADED, "discrete_semantic_density", lambda s: s.withColumn("semantic_density_uncertainty", r6("semantic_density_uncertainty")), ["discrete_semantic_density"],
    f",\nf AS (SELECT a.qid, t, count(*) / any_value(n)::DOUBLE AS f FROM a JOIN m USING (qid) GROUP BY a.qid, t),\nk AS (SELECT DISTINCT qid, ti, tj, CASE WHEN ti = tj THEN 1.0 ELSE greatest(0, 1 - greatest({_FAR('l', 0.5)}, {_FAR('r', 0.5)})) END AS k FROM p),\n"
    "x AS (SELECT k.qid, 'discrete_semantic_density' AS uq_column, round(1 - sum(x.f * k * y.f), 6) + 0.0 AS uq FROM k JOIN f x ON x.qid = k.qid AND x.t = ti JOIN f y ON y.qid = k.qid AND y.t = tj GROUP BY k.qid)",
)


@query("uq_invert", "SELECT doc_id AS qid, 'n_chars' AS uq_column, (1 - n_chars)::DOUBLE AS uq FROM documents")
def uq_invert(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.unpivot(_read(spark, sf, "documents").select(F.col("doc_id").alias("qid"), "n_chars"), ["n_chars"], invert=True)


@query("oc_subset_rows", _DOCS + ", c AS (SELECT quantile_cont(uq, 0.2) AS t FROM u) SELECT qid FROM u, c WHERE quality = 0 AND uq <= t")
def oc_subset_rows(spark: SparkSession, sf: str) -> DataFrame:
    return subsets.confident_failures(_documents_scored(spark, sf))[1]


# --- graphs that are unions of cliques -------------------------------------------------------------------------


@query("gwc_ecc_exact", with_pairs(EXACT, " SELECT qid, round(sqrt(n - k), 6)::DOUBLE AS u_ecc, n - k AS c_ecc_values, round(-(n - k), 6)::DOUBLE + 0.0 AS c_ecc_sum FROM (SELECT qid, count(*) AS n, count(DISTINCT t) AS k FROM a GROUP BY qid)"))
def gwc_ecc_exact(spark: SparkSession, sf: str) -> DataFrame:
    """Eigenvectors that are kept stand on one clique each and sum to nothing."""
    found = spectral.graph_scores(exact(spark, sf).select("qid", graph.label_weights(L).alias("weights")))
    return found.select("qid", r6("u_ecc").alias("u_ecc"), F.size("c_ecc").cast("long").alias("c_ecc_values"), r6(pairs.total(F.col("c_ecc"))).alias("c_ecc_sum"))


def _kernel(zero: str, other: str) -> str:
    """Entropy of a kernel with the value ``zero`` for the constant vector of a clique of m and ``other`` for the rest, by cliques."""
    d = f"(({zero} + (m - 1) * {other}) / m)"
    part = lambda v: f"CASE WHEN {v} > 1e-8 THEN {v} * ln({v}) ELSE 0 END"
    return f"round(-sum({part(f'({zero} / ({d} * n))')} + (m - 1) * {part(f'({other} / ({d} * n))')}), 6) + 0.0"


@query(
    "kle_cliques",
    with_pairs(EXACT, f",\nb AS (SELECT a.qid, t, count(*) AS m, any_value(n) AS n FROM a JOIN m USING (qid) GROUP BY a.qid, t)\n SELECT qid, {_kernel('1.0', 'exp(-0.3 * 2 * m)')} AS heat, {_kernel('1.0', 'CASE WHEN m > 1 THEN exp(-0.3 * m / greatest(m - 1, 1)) ELSE 1.0 END')} AS heat_normal, "
    f"{_kernel('(0.5)', '(1 / (2.0 + 2 * m))')} AS matern, {_kernel('1.0', '(CASE WHEN m > 1 THEN power(1 + m / greatest(m - 1, 1)::DOUBLE, -2) ELSE 1.0 END)')} AS matern_normal FROM b GROUP BY qid"),
)
def kle_cliques(spark: SparkSession, sf: str) -> DataFrame:
    e = spectral.kernel_scores(exact(spark, sf).select("qid", graph.label_edges(L).alias("g")), {"g": ""})
    at = lambda name: r6(F.col("entropies")[f"{name}_kernel_entropy"])
    return e.select("qid", at("heat_t=0.3").alias("heat"), at("heatn_t=0.3").alias("heat_normal"), at("matern_kappa=1.0_nu=1.0").alias("matern"), at("maternn_kappa=2.0_nu=2.0").alias("matern_normal"))



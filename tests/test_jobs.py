"""Sources, evaluators, providers and streaming on small files."""

import json
import math
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from plumbline.operators import ranking, reports
from plumbline.plans import evaluate, prompts, providers, score
from plumbline.sources import answers, gold, paths, subsets
from plumbline.streaming.scoring import score_stream


def put(folder, name, value):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False, indent=4), "utf-8")
    return str(path)


def test_answers(spark, tmp_path):
    path = put(tmp_path, "a.json", {"generaion_args": {"repeat": 1}, "answers": [{"qid": "1", "question": "é?", "answers": ["a", "b"]}, {"question_id": "2", "answers": "bare"}, {"qid": "3", "answers": []}]})
    got = {r["qid"]: r for r in answers.read_answers(spark, path).collect()}
    assert got["1"]["answers"] == ["a", "b"] and got["1"]["question"] == "é?" and got["1"]["ordinal"] == 0
    assert got["2"]["answers"] == ["bare"] and got["3"]["answers"] == []
    out = str(tmp_path / "out")
    answers.write_answers(answers.read_answers(spark, path), out, {"repeat": 1})
    again = {r["qid"]: r["answers"] for r in answers.read_answers(spark, out).collect()}
    assert again == {"1": ["a", "b"], "2": ["bare"], "3": []}


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    rows = spark.createDataFrame([("q", "a", "b", 1, 0.5), ("q", "a", "b", 2, 0.4)], "question string, text1 string, text2 string, label int, confidence double")
    answers.append_cache(rows.limit(1), path)
    answers.append_cache(rows, path)
    assert answers.read_cache(spark, path).collect() == [Row(question="q", text1="a", text2="b", label=2, confidence=0.4)]


def test_text_gold(spark, tmp_path):
    p = put(tmp_path, "t.json", {"Data": [{"QuestionId": "t1", "Question": "q", "Answer": {"NormalizedAliases": ["paris"], "HumanAnswers": ["The Paris!", "Lutetia"]}}]})
    assert gold.trivia(spark, p).first()["refs"] == ["paris", "lutetia"]
    p = put(tmp_path, "c.json", {"data": [{"id": "s", "story": "st", "questions": [{"turn_id": 1, "input_text": "who"}], "answers": [{"turn_id": 1, "input_text": "A man", "span_text": "a MAN"}, {"turn_id": 1, "input_text": "x", "span_text": "y"}]}]})
    r = gold.coqa(spark, p).first()
    assert (r["qid"], r["refs"], r["context"]) == ("s/1", ["man"], "st")
    p = put(tmp_path, "s.json", {"data": [{"paragraphs": [{"context": "c", "qas": [{"id": "1", "question": "q", "answers": [{"text": "An X"}]}, {"id": "2", "question": "q", "answers": []}]}]}]})
    assert [(r["qid"], r["refs"]) for r in gold.squad(spark, p).collect()] == [("1", ["x"])]
    ps = [put(tmp_path, f"b{i}.json", {"questions": [{"id": f"b{i}", "body": "q", "ideal_answer": ["Ideal"], "exact_answer": e}]}) for i, e in enumerate(["Yes", ["A1", "B"], [["C", "D"], "E"], None])]
    got = {r["qid"]: sorted(r["refs"]) for r in gold.bioasq(spark, ps).collect()}
    assert got == {"b0": ["ideal", "yes"], "b1": ["a1", "b", "ideal"], "b2": ["c", "d", "e", "ideal"], "b3": ["ideal"]}


def test_number_gold(spark, tmp_path):
    p = put(tmp_path, "v.json", [{"ID": "v1", "Body": "B.", "Question": "Q?", "Answer": 3.0}])
    r = gold.svamp(spark, p).first()
    assert (r["question"], r["gold"]) == ("B.\nQ?", 3.0)
    df = spark.createDataFrame([("q", "so #### 1,234", 0)], "question string, answer string, ordinal int")
    assert gold.gsm8k(df).first()["gold"] == 1234


def test_generation_gold(spark):
    df = spark.createDataFrame([("x", "doc", "sum", 5)], "id string, document string, summary string, ordinal int")
    assert gold.summaries(df, "xsum").first()["qid"] == "x" and gold.summaries(df, "multi_news").first()["qid"] == "5"
    t = spark.createDataFrame([((("ahoj"), "hi"), 0)], "translation struct<cs:string,en:string>, ordinal int")
    r = gold.translations(t, "cs-en").first()
    assert (r["question"], r["refs"]) == ("ahoj", ["hi"])
    with pytest.raises(ValueError):
        gold.translations(t, "csen")


def test_natural_questions(spark):
    row = {
        "id": "n1",
        "question": {"text": "who"},
        "document": {"tokens": {"token": ["<p>", "Ada", "( x )", ",", "wrote"], "is_html": [True, False, False, False, False]}},
        "annotations": {"id": ["a", "b"], "long_answer": [{"start_token": 0, "end_token": 3}, {"start_token": -1, "end_token": -1}], "short_answers": [{"text": ["The Ada"]}, {"text": []}]},
        "long_answer_candidates": {"start_token": [1], "end_token": [5], "top_level": [True]},
    }
    from plumbline.sources.schemas import NATURAL_QUESTIONS

    r = gold.natural_questions(spark.createDataFrame([row], NATURAL_QUESTIONS)).first()
    assert r["refs"] == ["ada"] and r["long_answers"] == ["Ada (x)", None]
    assert r["candidates"][0]["text"] == "Ada (x), wrote" and r["context"] == "Ada (x), wrote"


def test_ordinals(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 7 % 100)
    got = gold.with_ordinal(df, ["x"]).collect()
    assert all(r["ordinal"] == r["x"] for r in got) and len(got) == 100


def test_subsets(spark, tmp_path):
    put(tmp_path, "mistral:7b-x/gsm8k.json", {"dataset": "gsm8k", "model": "m", "total_questions": 5, "total_wrong": 2, "uq_threshold (bottom 20.0%)": -1.5, "wrong_and_low_uq_count": 1, "oc_ratio": 0.5, "qids": ["1"]})
    r = subsets.read_subsets(spark, str(tmp_path)).first()
    assert (r["model_folder"], r["total_wrong"], r["total_bad_rouge"], r["qids"]) == ("mistral:7b-x", 2, None, ["1"])


def test_paths(tmp_path, monkeypatch):
    assert paths.generated("trivia", "m", base=str(tmp_path)).endswith("output/trivia/m/trivia_m.json")
    p = put(tmp_path, "output/triviaqa_m.json", {})
    assert paths.generated("trivia", "m", base=str(tmp_path)) == p
    assert paths.generated("trivia", "m", given="x") == "x"
    monkeypatch.setenv("PLUMBLINE_DATA", "/d")
    assert paths.root(None, "PLUMBLINE_DATA", "./data") == "/d" and paths.root("/a", "PLUMBLINE_DATA", ".") == "/a"
    assert paths.scores("d", "m", "kle") == "uq_output/d/m/d_m_kle.json"


def frames(spark, rows, refs):
    a = spark.createDataFrame(rows, "qid string, answers array<string>, ordinal int")
    return spark.createDataFrame(refs, "qid string, refs array<string>"), a


def test_text_evaluation(spark):
    g, a = frames(spark, [("1", ["x"], 0), ("1", ["The Paris"], 1), ("2", ["cat", "dog"], 2), ("9", ["z"], 3)], [("1", ["paris"]), ("2", ["dog"]), ("3", ["q"])])
    found = {r["qid"]: r["accuracy"] for r in evaluate.quality(g, a, "trivia").collect()}
    assert found == {"1": 1, "2": 0}
    r = evaluate.report(evaluate.quality(g, a, "squad"), "squad").first()
    assert (r["average_exact_match"], r["number_of_questions"]) == (50.0, 2)
    none = evaluate.report(evaluate.quality(g.limit(0), a, "squad"), "squad").first()
    assert none["average_f1"] == 0 and none["number_of_questions"] == 0


def test_number_evaluation(spark):
    a = spark.createDataFrame([("1", ["so #### 5", "#### 6", "it is 5"], 0), ("2", [], 0)], "qid string, answers array<string>, ordinal int")
    g = spark.createDataFrame([("1", 5.0), ("2", 1.0)], "qid string, gold double")
    assert {r["qid"]: r["accuracy"] for r in evaluate.quality(g, a, "gsm8k").collect()} == {"1": 1, "2": 0}
    assert evaluate.report(evaluate.quality(g, a, "svamp"), "svamp").first()["average_rougel"] == 50.0


def test_generation_evaluation(spark):
    g, a = frames(spark, [("1", ["the cat"], 0), ("2", ["a"], 0)], [("1", ["the cat", ""]), ("2", ["", None])])
    q = evaluate.quality(g, a, "xsum")
    assert [(r["qid"], r["rouge_l"]) for r in q.collect()] == [("1", pytest.approx(200 / 3))]  # the vote is the normalised text
    pooled = spark.createDataFrame([("the cat is on the mat", ["the cat is on the mat"])], "prediction string, refs array<string>")
    assert reports.corpus_bleu(pooled).first()[0] == pytest.approx(100)
    assert evaluate.family("wmt19_cs-en") == "generation"
    with pytest.raises(ValueError):
        evaluate.family("other")


def test_ranking_of_scores(spark):
    g, a = frames(spark, [(str(i), ["x" if i % 2 else "y"], 0) for i in range(6)], [(str(i), ["x"]) for i in range(6)])
    s = spark.createDataFrame([(str(i), float(i % 2), 0) for i in range(6)] + [("0", 9.0, 1)], "qid string, e double, ordinal int")
    out = evaluate.run(g, a, "squad", s, ["e"])
    got = {r["metric"]: r["value"] for r in out["ranking"].collect()}
    assert got["matched"] == 6 and got["auroc"] == 0.0
    none = {r["metric"]: r["value"] for r in evaluate.rank_scores(out["quality"], s.limit(0), "squad", ["e"]).collect()}
    assert none == {"matched": 0, "auroc": None, "auarc": None}
    assert ranking.score_columns(spark.createDataFrame([(1, 2, 3)], "qid int, u_deg int, c_deg int")) == ["u_deg", "c_deg"]
    with pytest.raises(ValueError):
        evaluate.run(g, a, "squad", task="x")


def test_prompts(spark):
    df = spark.createDataFrame([("1", "who?", "ctx")], "qid string, question string, context string")
    m = prompts.prompts(df, "coqa").first()["messages"]
    assert m[1]["content"] == "story: ctx\n question: who?" and m[0]["role"] == "system"
    m = prompts.prompts(df, "wmt19", 1, "cs-en").first()["messages"]
    assert m[0]["content"].startswith("Translate from cs to en.") and m[1]["content"] == "who?"
    assert set(prompts.SYSTEM) == set(evaluate.DATASETS)


def test_providers_and_stream(spark, tmp_path):
    df = spark.createDataFrame([("1", "who?", "")], "qid string, question string, context string")
    sets = providers.generate(prompts.prompts(df, "nq"), lambda messages, n: [["a"] * (n - 1) + ["b"] for _ in messages], 3)
    assert sets.first()["answers"] == ["a", "a", "b"]
    empty = spark.createDataFrame([], "question string, text1 string, text2 string, label int, confidence double")
    new = providers.label_missing(sets, empty, lambda q, a, b: [(0, 0.8)] * len(q))
    assert new.count() == 2
    v = providers.encode(sets, lambda ts: [[float(len(t)), 1.0] for t in ts])
    assert len(v.first()["vectors"]) == 3
    replies = spark.createDataFrame([("who?", "a", "b", "entailment")], "question string, text1 string, text2 string, reply string")
    assert providers.labels_from_replies(replies).first()["label"] == 2
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    sets.write.parquet(src)
    new = spark.createDataFrame(new.collect(), new.schema)
    stream = spark.readStream.schema(sets.schema).parquet(src)
    q = score_stream(stream, new, "discrete_semantic_entropy", out, str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(out).first()["discrete_semantic_uncertainty"] == pytest.approx(0.636514, abs=1e-6)
    assert score.score(sets, new, "discrete_gwc").count() == 1


def test_cache_policy(spark, tmp_path):
    sets = spark.createDataFrame([("1", "q", ["a", "b", "c"])], "qid string, question string, answers array<string>")
    path = str(tmp_path / "cache")
    with pytest.raises(FileNotFoundError):
        providers.cache_for(sets, path)
    built = providers.cache_for(sets, path, lambda q, a, b: [(2 if x < y else 0, 0.7) for x, y in zip(a, b, strict=True)], steps=2)
    assert built.count() == 6
    more = spark.createDataFrame([("1", "q", ["a", "z"])], sets.schema)
    with pytest.raises(Exception, match="no label for"):
        score.score(more, providers.cache_for(more, path, lambda q, a, b: 1 / 0), "discrete_luq_pair").collect()
    m = sets.select(prompts.entailment_messages(F.col("question"), F.lit("x"), F.lit("y")).alias("m")).first()["m"]
    assert 'question "q"' in m[0]["content"] and "Answer 2: y" in m[0]["content"]


def test_report_documents(spark, tmp_path):
    a = spark.createDataFrame([("1", ["x"], 0), ('2"', ["y"], 0)], "qid string, answers array<string>, ordinal int")
    g = spark.createDataFrame([("1", ["x"]), ('2"', ["z"])], "qid string, refs array<string>")
    s = spark.createDataFrame([("1", 0.1), ('2"', 0.9)], "qid string, u_deg double")
    out = evaluate.run(g, a, "squad", s)
    at = str(tmp_path / "qa")
    answers.write_qa_report(out["report"], reports.per_question(out["quality"]), at)
    read = lambda folder: json.loads("".join(p.read_text("utf-8") for p in sorted(Path(folder).glob("part-*"))))
    assert read(at)["per_question_accuracy"] == {"1": 1, '2"': 0} and read(at)["average_accuracy"] == 50.0
    at = str(tmp_path / "uq")
    answers.write_uq_report(out["ranking"], at)
    assert read(at) == {"Number of matched questions": 2, "u_deg_auroc": 1.0, "u_deg_auarc": 0.75}
    at = str(tmp_path / "scores")
    answers.write_scores(s, at)
    assert read(at) == [{"qid": "1", "u_deg": 0.1}, {"qid": '2"', "u_deg": 0.9}]
    at = str(tmp_path / "none")
    answers.write_scores(s.limit(0), at)
    assert read(at) == []
    x = evaluate.run(g, a, "xsum", task="qa")
    answers.write_qa_report(x["report"], reports.per_question(x["quality"]), str(tmp_path / "gen"))
    assert read(str(tmp_path / "gen"))["per_question_accuracy"]["1"]["rouge_l"] == 100.0


def test_evaluation_by_method(spark):
    schema = "qid string, semantic_ids array<int>, entropies map<string,double>"
    q = spark.createDataFrame([("1", 1.0), ("2", 0.0), ("3", 1.0)], "qid string, accuracy double")
    kle = spark.createDataFrame([("1", [0], {"a": 0.1, "b": 0.9}), ("2", [0], {"a": 0.5, "b": 0.5}), ("3", [0], None)], schema)
    got = {(r["uq_column"], r["metric"]): r["value"] for r in evaluate.rank_scores(q, kle, "squad", method="kle").collect()}
    assert got["a", "auroc"] == 1.0 and got["b", "auroc"] == 0.0 and got["a", "matched"] == 2
    gwc = spark.createDataFrame([("1", 0.1, [0.2, 0.4], [[1.0]]), ("2", 0.2, [0.9, 0.9], [[1.0]])], "qid string, u_deg double, c_deg array<double>, similarity_matrix array<array<double>>")
    got = {r["uq_column"] for r in evaluate.rank_scores(q, gwc, "squad", method="continuous_gwc").collect()}
    assert got == {"u_deg", "c_deg"}
    triplet = spark.createDataFrame([("1", 0.9, 0.9, 0.1), ("2", 0.2, 0.3, 0.4)], "qid string, exact_match double, bert_score double, cosine_sim double")
    got = {(r["uq_column"], r["metric"]): r["value"] for r in evaluate.rank_scores(q, triplet, "squad", method="consistency_triplet").collect()}
    assert got["exact_match", "auroc"] == 1.0 and got["cosine_sim", "auroc"] == 0.0  # turned round
    density = spark.createDataFrame([("1", ["a"], 0.1), ("2", ["b"], 0.3)], "qid string, semantic_density_unique_responses array<string>, semantic_density_uncertainty double")
    got = {r["metric"]: r["value"] for r in evaluate.rank_scores(q, density, "squad", method="discrete_semantic_density").collect()}
    assert got["auroc"] == 1.0 and got["matched"] == 2
    assert evaluate.is_conservative("azure-GPT-4o") and not evaluate.is_conservative("llama")


def test_translations_report(spark):
    g, a = frames(spark, [("1", ["the cat is on the mat"], 0)], [("1", ["cat is on mat"])])
    r = evaluate.run(g, a, "wmt19_cs-en", task="qa")["report"].first()
    assert r["corpus_bleu"] == pytest.approx(100) and r["translation_direction"] == "cs-en" and r["number_of_questions"] == 1


def test_names_and_flags(spark):
    sets = spark.createDataFrame([("1", "q", ["a", "a"])], "qid string, question string, answers array<string>")
    v = spark.createDataFrame([("1", [[1.0, 0.0], [1.0, 0.0]])], "qid string, vectors array<array<double>>")
    r = score.score(sets, None, "consistency_triplet", first=v, second=v).first()
    assert (r["exact_match"], r["bert_score"], r["cosine_sim"]) == (1.0, 1.0, 1.0)
    empty = spark.createDataFrame([], "question string, text1 string, text2 string, label int, confidence double")
    assert score.score(sets, empty, "discrete_semantic_uncertainty").first()["discrete_semantic_uncertainty"] == 0
    assert [score.as_bool(x) for x in ("True", "TRUE", "yes", "", True, 1, 0, None)] == [True, True, False, False, True, True, False, False]


def test_empty_winner(spark):
    from plumbline.operators import votes

    rows = [(["Paris", "", "the"],), (["", "", "x"],), (["A", "b", "b"],), ([],)]
    df = spark.createDataFrame(rows, "answers array<string>")
    assert [r[0] for r in df.select(votes.prediction(F.col("answers"))).collect()] == ["paris", "", "b", ""]


def test_numbers_of_any_column(spark):
    df = spark.createDataFrame(
        [(["1", "x"], [[1.0, 2.0], [3.0, 4.0]], [[1.0], [2.0, 3.0]], {"a": 1.0}, "2.5", "x", [1.0, None], [True, False], True)],
        "texts array<string>, matrix array<array<double>>, ragged array<array<double>>, map map<string,double>, text string, word string, holes array<double>, flags array<boolean>, flag boolean",
    )
    got = df.select(*[ranking.numeric_value(df, c).alias(c) for c in df.columns]).first().asDict()
    assert {k for k, v in got.items() if math.isnan(v)} == {"texts", "ragged", "map", "word", "holes"}
    assert (got["matrix"], got["text"], got["flags"], got["flag"]) == (2.5, 2.5, 0.5, 1.0)


@pytest.mark.parametrize("layout", [{"indent": 4}, {"indent": 0, "separators": (",", ":")}, {}])
def test_documents_in_splits(spark, tmp_path, layout):
    """A document is read and written by as many tasks as it has splits, with the same elements and places."""
    from plumbline.sources import documents

    odd = ['a "quoted] [text\\', "{,}", "line\nend\u2028é", ""]
    rows = [{"qid": str(i), "question": odd[i % 4], "answers": [odd[(i + j) % 4] * (1 + i % 5) for j in range(i % 7)]} for i in range(60)]
    whole = {"generaion_args": {"answers": [1, 2]}, "first": [[1], {"answers": [3]}], "answers": rows, "last": [{"qid": "no"}]}
    (tmp_path / "a.json").write_text(json.dumps(whole, ensure_ascii=False, **layout), "utf-8")
    (tmp_path / "list.json").write_text(json.dumps(rows, **layout), "utf-8")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "997")
    try:
        found = answers.read_answers(spark, str(tmp_path / "a.json"))
        got = sorted((r["ordinal"], r["qid"], r["question"], r["answers"]) for r in found.collect())
        assert got == [(i, r["qid"], r["question"], r["answers"]) for i, r in enumerate(rows)]
        got = sorted((r["ordinal"], json.loads(r["element"])) for r in documents.read_elements(spark, str(tmp_path / "list.json"), None).collect())
        assert [x for _, x in got] == rows and [k for k, _ in got] == list(range(60))
        if layout:
            assert found.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set(name, before)


def test_parts_of_documents(spark, tmp_path):
    from plumbline.sources import documents

    out = str(tmp_path / "out")
    rows = spark.range(5000).select(F.format_string('{"n": %d}', F.col("id")).alias("element"), "id").repartition(7)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        documents.write_document(rows, out, '{"x": [', "]}", ["id"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    parts = sorted(Path(out).glob("part-*"))
    assert len(parts) > 3 and [x["n"] for x in json.loads("".join(p.read_text("utf-8") for p in parts))["x"]] == list(range(5000))
    assert documents.read_elements(spark, out, "x").where(F.col("ordinal") == F.get_json_object("element", "$.n").cast("int")).count() == 5000
    documents.write_document(rows.limit(0), out, "[", "]", ["id"])
    assert documents.read_elements(spark, out, None).count() == 0
    bad = put(tmp_path, "bad.json", {"x": [1]})
    with pytest.raises(Exception, match="no list"):
        documents.read_elements(spark, bad, None)
    Path(bad).write_text('{"x": [1', "utf-8")
    with pytest.raises(ValueError, match="no whole JSON document"):
        documents.read_elements(spark, bad, "x")

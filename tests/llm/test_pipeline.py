"""The five stages, each held against brute force on its own input, and the thin queries' columns."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, quality
from plumbline.llm.queries import queries

from .test_documents import classes, plain_repeats, plain_simhash, words


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs.collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf).write.parquet(at)
        docs = spark.read.parquet(at)
        out.append(docs.collect())
    return out


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


def test_columns(spark, sf, stages):
    for rows in stages[1:5]:
        assert rows[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality(spark, sf, stages):
    judge = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r["doc_id"] for r in stages[0] if judge([(r["text"] or "").encode()])[2][0]}
    assert {r["doc_id"] for r in stages[1]} == kept and all(len(words(r["text"])) >= 10 for r in stages[1])


def test_near_duplicates(stages):
    rows = sorted(stages[1], key=lambda r: r["doc_id"])
    top = classes([plain_simhash(r["text"]) for r in rows])
    assert {r["doc_id"] for r in stages[2]} == {rows[i]["doc_id"] for i in set(top)}


def test_passages(stages):
    want = {}
    for r, (n, gone, _) in zip(stages[2], plain_repeats([r["text"] for r in stages[2]], 35), strict=True):
        if n > gone:
            want[r["doc_id"]] = (n - gone, r["text"] if not gone else None)
    got = by_id(stages[3])
    assert set(got) == set(want)
    for k, (n, text) in want.items():
        assert len(words(got[k]["text"])) == n and (text is None or got[k]["text"] == text) and got[k]["n_chars"] == len(got[k]["text"])


def test_leaks(spark, sf, stages):
    items = [decontaminate.words_of(r["text"].encode()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = set()
    for r in stages[3]:
        w = decontaminate.words_of((r["text"] or "").encode())
        ids = {x: i for i, x in enumerate({*w, *(x for it in items for x in it)})}
        for it in items:
            if len(set(it) & set(w)) >= 0.6 * len(set(it)):
                d, _ = decontaminate.edit_distances(np.array([[ids[x] for x in it]]), np.array([[ids[x] for x in w]]))
                if d[0] <= int(0.2 * len(it) + 1e-9):
                    gone.add(r["doc_id"])
    assert {r["doc_id"] for r in stages[4]} == {r["doc_id"] for r in stages[3]} - gone


def test_packed(stages):
    sequences, docs = defaultdict(list), Counter()
    for p in stages[5]:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        docs[p["doc_id"]] += p["length"]
    for s in range(len(sequences)):
        at = 0
        for offset, length in sorted(sequences[s]):
            assert offset == at
            at += length
        assert at == 4096 or s == len(sequences) - 1
    assert set(docs) == {r["doc_id"] for r in stages[4]}
    assert all(docs[p["doc_id"]] == p["doc_tokens"] for p in stages[5])


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == len(stages[5])


COLUMNS = {
    "op1_lm_score": "doc_id n_words log_likelihood per_word",
    "op2_simhash": "doc_id fingerprint component_id",
    "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_decontaminate": "doc_id item_id edit_distance item_words similarity end_word",
    "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op7_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_html": "page_id url text n_chars",
    "op9_substrings": "doc_id n_words n_removed kept_sha256",
    "op10_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept score",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, sf, name):
    df = queries()[name](spark, sf)
    assert df.columns == COLUMNS[name].split() and df.count() > 0


# --- the stages on rows with nulls, empties, ties, repeats and clashing columns --------------------------------------


@pytest.fixture(scope="module")
def odd(spark, docs, rows, tmp_path_factory):
    """A folder with labels and benchmark for the odd rows, and those rows under columns that clash with names used inside."""
    at = str(tmp_path_factory.mktemp("odd"))
    labels = [(r[0], 1, 0) for r in rows[:60]] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    items = [(1, "nothing of this kind occurs in any of the texts that are looked through here today"), (None, None), (2, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    names = {"fp": "fp", "n_words": "n_words_removed"}
    clash = docs.select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns], F.lit(7).alias("_spans"), F.lit(8).alias("kept_digest"), F.lit("k").alias("_k_id"), F.lit(9).alias("key"), F.lit(5).alias("kept"))
    return at, clash


@pytest.mark.parametrize("stage", range(4))
def test_stages_on_odd_rows(spark, odd, stage):
    at, clash = odd
    name, f = corpus_pipeline.STAGES[stage]
    out = f(spark, clash, at)
    assert out.columns == clash.columns and out.schema == clash.schema
    got = out.collect()
    assert all((r["n_words_removed"], r["_spans"], r["kept_digest"], r["_k_id"], r["key"], r["kept"]) == ("clash", 7, 8, "k", 9, 5) for r in got)
    given = clash.collect()
    texts = lambda rows: Counter((r["doc_id"], r["text"]) for r in rows)
    if name == "leaks":
        assert texts(got) == texts(given)
    elif name == "quality":
        assert {len(words(r["text"])) >= 10 for r in got} == {True} and texts(got) <= texts(given) and len(got) > 30
    elif name == "near_duplicates":
        order = sorted(given, key=lambda r: (r["doc_id"] is None, r["doc_id"]))
        top = classes([plain_simhash(r["text"]) for r in order])
        assert texts(got) == texts([order[i] for i in set(top)])
    else:
        left = Counter()
        for r, (n, gone, _) in zip(given, plain_repeats([r["text"] for r in given], 35), strict=True):
            left[r["doc_id"]] += n > gone or not gone
        assert Counter(r["doc_id"] for r in got) == +left


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_empty_tables(spark, odd, tmp_path, stage):
    at, clash = odd
    _, f = corpus_pipeline.STAGES[stage]
    assert f(spark, clash.limit(0), at).count() == 0
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{at}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert f(spark, clash.limit(0), str(tmp_path)).count() == 0
    assert stage == 4 or f(spark, clash, str(tmp_path)).count() > 0


def test_packing_odd_rows(spark, odd, rows):
    at, clash = odd
    pieces = corpus_pipeline.pack(spark, clash, at).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    assert set(tokens) == {r[0] for r in rows} and all(n >= 1 for n in tokens.values())


def test_forest_by_brute_force():
    """Path lengths, one row and one split at a time."""
    rng = np.random.default_rng(5)
    rows = rng.standard_normal((120, 4)).round(1)
    rows[100:] = rows[0]  # ties
    forest = quality.IsolationForest(rows, trees=20, sample=32)

    def depth(tree, row):
        feature, cut, left, found = tree
        at, steps = 0, 0
        while feature[at] >= 0:
            at, steps = left[at] + int(row[feature[at]] > cut[at]), steps + 1
        assert found[at] >= steps  # what is left together counts as the tree it would be
        return found[at]

    usual = 2 * (np.log(31) + 0.5772156649) - 2 * 31 / 32
    want = [2 ** (-np.mean([depth(t, r) for t in forest.trees]) / usual) for r in rows]
    assert np.allclose(forest.score(rows), want) and len(set(forest.score(rows[100:]).tolist())) == 1


def test_cased_tokenizers_are_refused(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from plumbline.llm import packing

    cased = Tokenizer(models.WordLevel({"The": 0, "the": 1, "[UNK]": 2}, unk_token="[UNK]"))
    cased.pre_tokenizer = pre_tokenizers.Whitespace()
    cased.save(str(tmp_path / "cased.json"))
    with pytest.raises(ValueError):
        packing.ChunkTokenizer(str(tmp_path / "cased.json"))

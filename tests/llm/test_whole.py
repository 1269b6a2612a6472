"""The whole job where a bound once cut it: rare words, all positions, long items, many sources."""

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, lm_score, packing, sharding, simhash, substrings
from plumbline.llm.queries import tokenizer_path


def test_every_word_has_its_own_probability(spark):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{min(int(x), 30_000)}" for x in rng.zipf(1.2, 200)) for _ in range(150)]
    net = lm_score.train(spark.createDataFrame([(t,) for t in texts], "text string"), rounds=1, frequent=1536)
    count = Counter(w for t in texts for w in t.split())
    token = lambda w: int(net.vocabulary.ids(lm_score._keys([w.encode()]))[0])
    by = {}
    for w in count:
        by.setdefault(token(w), []).append(w)
    assert len(count) > 3000 and all(len(x) == 1 for t, x in by.items() if t < 1536)
    tail = max((t for t in by if t >= 1536), key=lambda t: len({count[w] for w in by[t]}))
    strange = next(w for w in (f"x{i}" for i in range(10**6)) if token(w) == tail)
    own = [*by[tail], strange]
    got = {own[r["doc_id"]]: r["log_likelihood"] for r in lm_score.score(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), net).collect()}
    framed = np.array([net.pad] * 2 + [tail] + [net.pad] * 2)
    base = net.log_probabilities(framed, np.array([2]))[0]
    total, once = sum(count[w] for w in by[tail]), sum(count[w] == 1 for w in by[tail])
    for w in by[tail]:
        assert got[w] == pytest.approx(base + np.log(count[w] / (total + once + 1)), abs=1e-6)
    assert got[strange] < min(got[w] for w in by[tail])
    mass = sum(np.exp(got[w] - base) for w in by[tail]) + 2 * len(own) * np.exp(got[strange] - base)
    assert mass == pytest.approx(1)


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_rounds_train_on_every_word(spark, monkeypatch, rounds):
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, n)) for n in [1, 2, 3, 15, 16, 17, 40] * 3]
    words = sum(len(t.split()) for t in texts)
    data = spark.createDataFrame([(t,) for t in texts], "text string")
    hashes = rng.integers(-(1 << 62), 1 << 62, len(texts))
    turns = [lm_score._masked(hashes, np.array([len(t.split()) for t in texts]), rounds, k) for k in range(rounds)]
    assert (np.sum(turns, axis=0) == 1).all() and len(turns[0]) == words
    weights, averaged = [], lm_score._averaged
    monkeypatch.setattr(lm_score, "_averaged", lambda rows, parts: weights.append(rows.where("block = 0").groupBy().sum("weight").first()[0]) or averaged(rows, parts))
    lm_score.train(data, rounds, slice_words=100)
    assert sum(weights) == words


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scores = []
    for parts in (1, 16):
        found = lm_score.score(docs.repartition(parts), slice_words=20_000).collect()  # several slices
        scores.append({r["doc_id"]: r["log_likelihood"] for r in found})
    assert scores[0] == scores[1] and len(scores[0]) == docs.count()


def test_several_readers_of_a_slice(spark, monkeypatch):
    """Slices of the word hash that several tasks read give the scores of one task, to the last bits of a sum."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    net = lm_score.train(docs, rounds=1)
    want = {r["doc_id"]: r["log_likelihood"] for r in lm_score.score(docs, net).collect()}
    monkeypatch.setattr(lm_score, "_SLICE_READ", 1000)
    got = {r["doc_id"]: r["log_likelihood"] for r in lm_score.score(docs, net).collect()}
    assert got == pytest.approx(want, rel=1e-9) and len(got) == docs.count()


def test_tree_of_averages(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "_FAN", 3)
    rows = [(0, k, float(k % 4 + 1), np.array([k, 1], np.float32).tobytes()) for k in range(30)]
    found = lm_score._averaged(spark.createDataFrame(rows, lm_score._MEANS), 30)
    weights = np.array([r[2] for r in rows])
    assert found[0] == pytest.approx([np.average(np.arange(30), weights=weights), 1], rel=1e-5)


@pytest.mark.parametrize("n", [500, 1000, 2000])
def test_long_items_are_found_at_the_limit(n):
    rng = np.random.default_rng(n)
    items = [(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, n)).encode()) for i in range(6)]
    bench = decontaminate.Benchmark(items)
    noise = [b"w%d" % x for x in rng.integers(0, 5000, 80)]
    texts = []
    for _, text in items * 3:
        w = text.split()
        for _ in range(int(0.2 * n)):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[at : at + (kind < 2)] = [b"zz%d" % rng.integers(1000)] * (kind != 1)
        k = int(rng.integers(80))
        texts.append(b" ".join(noise[:k] + w + noise[k:]))
    found = bench.matches([b"", *texts, items[0][1], b"w1 w2"])
    assert all(i in {x[0] for x in own} for (i, _), own in zip(items * 3, found[1:], strict=False))
    assert found[-2] == [(0, 0, n, n)] and not found[0] and not found[-1]


@pytest.mark.parametrize("n", [15, 40, 100, 200, 300, 400])
def test_recall_by_length(n):
    """Copies with as many edits as are allowed are found, at every length of the sampled search and beyond it."""
    rng = np.random.default_rng(n)
    items = [(i, b" ".join(b"w%d" % x for x in rng.integers(0, 5000, n))) for i in range(20)]
    bench, texts = decontaminate.Benchmark(items), []
    for _, text in items * 5:
        w = text.split()
        for _ in range(int(0.2 * n)):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[at : at + (kind < 2)] = [b"zz%d" % rng.integers(1000)] * (kind != 1)
        texts.append(b" ".join([b"w%d" % x for x in rng.integers(0, 5000, 30)] + w))
    found = bench.matches(texts)
    assert np.mean([i in {x[0] for x in own} for (i, _), own in zip(items * 5, found, strict=True)]) >= 0.95


def test_index_is_bounded_by_the_items():
    rng = np.random.default_rng(8)
    items, size, lengths = [], 0, [*range(15, 60), *range(60, 420, 30)]
    while size < 1 << 20:
        items.append((len(items), b" ".join(b"w%d" % x for x in rng.integers(0, 20_000, int(rng.choice(lengths))))))
        size += len(items[-1][1])
    assert len(pickle.dumps(decontaminate.Benchmark(items))) < 50 << 20


@pytest.mark.parametrize("max_queues", [1, 4])
def test_targets_hold_with_many_sources(spark, max_queues):
    rows = [(i, f"s{i % 12}", "the river and the stone " * 30) for i in range(240)] + [(240, None, "no source")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    pieces = packing.pack(docs, tokenizer_path(), window=1024, quantum=64, targets={"s0": 0.5, "s1": 0.25}, max_queues=max_queues).collect()
    assert {p["doc_id"] for p in pieces} == {r[0] for r in rows}
    held = Counter()
    for p in pieces:
        held[p["sequence_id"], p["source"]] += p["length"]
    for k in range(2):  # before a source runs dry
        assert abs(held[k, "s0"] - 512) <= 64 and abs(held[k, "s1"] - 256) <= 64


def _prose(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))


def test_collisions_remove_nothing(spark):
    """Hashes of six bits collide all the time; words decide."""
    rng = np.random.default_rng(2)
    shared = _prose(rng, 50)
    rows = [(i, _prose(rng, 120) + (" " + shared if i % 5 == 0 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    met = substrings._spans(substrings._found(docs, 35, 11, 6, "doc_id", "text", 4, None).where("marked"))
    assert met.count() == 40  # candidates everywhere
    got = {r["doc_id"]: (r["n_words_removed"], r["text"]) for r in substrings.remove_repeats(docs, bits=6).collect()}
    assert got == {i: (50, t.removesuffix(" " + shared)) if i % 5 == 0 else (0, t) for i, t in rows}


def test_rows_of_one_key_stay_linear(spark):
    """Rows that all have no id and one text: their spans are a set, not a list a row."""
    text = _prose(np.random.default_rng(3), 60)
    docs = spark.range(10_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    spans = substrings.repeated_spans(docs).collect()
    assert len(spans) == 1 and len(spans[0]["spans"]) <= 60
    got = substrings.remove_repeats(docs).groupBy("n_words_before", "n_words_removed", "text").count().collect()
    assert [tuple(r) for r in got] == [(60, 60, "", 10_000)]


def test_one_held_key_after_another():
    """Rows of a key are searched together, however batches cut them."""
    rng = np.random.default_rng(4)
    split = [[b"w%d" % x for x in rng.integers(0, 7, 80)] for _ in range(30)]
    rows = substrings.window_rows(split, np.arange(30), np.arange(30), 4, 2)
    rows = pa.table(rows).sort_by("key").combine_chunks()
    whole = [x for b in substrings._search(rows.to_batches()) for x in b.to_pylist()]
    old, substrings.HELD_ROWS = substrings.HELD_ROWS, 7
    try:
        cut = [x for b in substrings._search(rows.to_batches(max_chunksize=3)) for x in b.to_pylist()]
    finally:
        substrings.HELD_ROWS = old
    places = lambda found: Counter((x["k_id"], x["at"] + i) for x in found if x["marked"] for i in range(x["n"]))
    assert places(whole) == places(cut) and len(places(whole)) > 100


# --- fingerprints and shards: many rows of one kind ------------------------------------------------------------------


def test_a_dense_cloud_of_fingerprints(spark):
    """Shards over the limit are cut finer, down to few bits; no link is lost."""
    rng = np.random.default_rng(9)
    base = int(rng.integers(1 << 62))
    cloud = {base ^ sum(1 << int(j) for j in rng.choice(20, int(rng.integers(0, 7)), replace=False)) for _ in range(900)}
    far = {int(x) for x in rng.integers(0, 1 << 62, 100)}
    fps = np.array(sorted(cloud | far), np.int64)
    found = simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long"), hot=64).collect()
    assert len(found) < 125 * len(fps)
    want, got = np.arange(len(fps)), np.arange(len(fps))
    near = np.bitwise_count((fps[:, None] ^ fps[None]).view(np.uint64)) <= 4
    a, b = np.nonzero(near)
    where = {int(x): i for i, x in enumerate(fps)}
    want = simhash._union(want, a, b)
    got = simhash._union(got, np.array([where[r["u"]] for r in found]), np.array([where[r["v"]] for r in found]))
    assert (want == got).all() and len(set(want.tolist())) > 50


def test_finer_masks_lose_nothing():
    rng = np.random.default_rng(10)
    for _ in range(50):
        vary = rng.choice(64, int(rng.integers(6, 30)), replace=False)
        fps = [sum(1 << int(j) for j in vary if rng.random() < 0.4) for _ in range(60)]
        ones = np.array([sum(x >> j & 1 for x in fps) for j in range(64)])
        masks = simhash.finer(ones, 60, 4)
        assert len(masks) == 5 and all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])
        assert all(any((x ^ y) & m == 0 for m in masks) for x in fps for y in fps if (x ^ y).bit_count() <= 4)


def test_component_of_many_fingerprints(spark):
    """A large component's least id reaches all its fingerprints, by either way."""
    bits = [sum(1 << (4 * j + k) for j in range(i)) for i in range(12) for k in range(4)]
    docs = spark.createDataFrame([(100 + i, b) for i, b in enumerate(bits)] + [(7, bits[-1]), (None, bits[0])], "ident long, fp long")
    for hot in (3, 1000):
        found = {r["fp_"]: r["least"] for r in simhash._classes(docs, 4, hot).collect()}
        assert set(found) == set(bits) and set(found.values()) == {7}


def test_bounds_by_brute_force():
    rng = np.random.default_rng(11)
    bounds = sorted({(int(rng.integers(-5, 5)), *(int(x) for x in rng.integers(-5, 5, int(rng.integers(0, 3))))) for _ in range(300)}, key=lambda b: (*b, *[sharding.LOW] * (3 - len(b))))
    keys = rng.integers(-6, 6, (500, 3))
    got = sharding.Bounds(bounds, 3).reached(list(keys.T))
    assert got.tolist() == [sum((*b, *[sharding.LOW] * (3 - len(b))) <= tuple(k) for b in bounds) for k in keys.tolist()]
    assert sharding.Bounds([], 3).reached(list(keys.T)).tolist() == [0] * 500


def test_many_shards(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7_000).alias("text"))
    got = sharding.shard(rows, 1000, "rows", rows_per_task=1500).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
    assert len(got) == 20_000 and set(map(len, by.values())) == {20} and all(sorted(r["slot"] for r in x) == list(range(20)) for x in by.values())


def test_equal_texts_stand_together(docs, rows):
    got = sharding.shard(docs, 4, "bytes", tolerance=0.01).collect()
    sizes, of = Counter(), {}
    for r in got:
        sizes[r["shard"]] += r["size"]
        of.setdefault(r["text_crc32"], set()).add(r["shard"])
    largest = max(r["size"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert sum(len(x) - 1 for x in of.values()) <= 3  # a group is parted by a split only

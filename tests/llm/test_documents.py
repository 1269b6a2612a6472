"""Operators on documents against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, licenses, lm_score, packing, quality, sharding, simhash, substrings
from plumbline.llm.graph import components
from plumbline.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# --- SimHash ---------------------------------------------------------------------------------------------------


def plain_simhash(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints, radius=4):
    """Smallest member reachable, by all pairs."""
    n, top = len(prints), list(range(len(prints)))
    f = np.array(prints, np.uint64)

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(n):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= radius).tolist():
            a, b = find(i), find(j)
            top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(docs, rows, empty):
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    prints = [plain_simhash(r[1]) for r in ordered]
    want = Counter((r[0], p, ordered[c][0]) for r, p, c in zip(ordered, prints, classes(prints), strict=True))
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0


def test_keep_one(docs, rows, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    prints = [plain_simhash(r[1]) for r in ordered]
    want = Counter(ordered[c][0] for c in set(classes(prints)))
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert simhash.keep_one(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_forest_finds_all(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(4)])
    fps = np.unique(near).view(np.int64)
    keys = np.sort(rng.integers(0, 3, len(fps)))
    tree = simhash.BKForest(keys, fps.view(np.uint64))
    got = set(zip(*(x.tolist() for x in tree.search(np.arange(len(fps)), 4)), strict=True))
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps)) if i != j and keys[i] == keys[j] and int(np.bitwise_count(fps[i].view(np.uint64) ^ fps[j].view(np.uint64))) <= 4}
    assert got == want


def test_crowded_shards(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (300, 2))} | {int(x) for x in rng.integers(0, 2**62, 200)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["u"]: r["v"] for r in components(simhash.links(df, 4, per_shard=50, hot=20)).collect()}
    want = classes(fps)
    assert all(got.get(x, x) == fps[c] for x, c in zip(fps, want, strict=True))
    assert len({got.get(x, x) for x in fps}) > 1


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(7, 7)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    top = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(top[a], top[b])
            changed |= top[a] != m or top[b] != m
            top[a] = top[b] = m
    assert got == {k: v for k, v in top.items() if k != v}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- packing ---------------------------------------------------------------------------------------------------


def check_packing(pieces, docs_ids, window):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
        by_doc[p["doc_id"]].append(p)
    sizes = []
    for s in range(len(by_sequence)):
        at = 0
        for p in sorted(by_sequence[s], key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        sizes.append(at)
    assert all(n == window for n in sizes[:-1]) and sizes[-1] <= window
    for key, copies in docs_ids.items():
        got = Counter((p["start"], p["length"], bytes(p["ids"])) for p in by_doc[key])
        n = len(copies)
        ids = copies[0]
        covered = Counter()
        for (start, length, data), k in got.items():
            assert data == np.array(ids[start : start + length], "<u4").tobytes()
            covered.update({i: k for i in range(start, start + length)})
        assert covered == Counter({i: n for i in range(len(ids))})


@pytest.mark.parametrize("targets", [None, {"s0": 0.7, "s1": 0.2}, {"s0": 1.0}])
def test_packing(docs, rows, empty, targets):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    model.encode_special_tokens = True
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append([*model.encode(r[1] or "", add_special_tokens=False).ids, 2])
    pieces = packing.pack(docs, tokenizer_path(), window=256, quantum=32, targets=targets).collect()
    check_packing(pieces, want, 256)
    few = packing.pack(docs, tokenizer_path(), window=256, quantum=32, max_queues=2).collect()
    check_packing(few, want, 256)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_mixture():
    s = packing.Schedule([40_000, 30_000, 10_000], [0.5, 0.375, 0.125], 1000, 50)
    doc, at, n, place = s.place(np.array([0, 1, 2]), np.zeros(3, np.int64), np.array([40_000, 30_000, 10_000]))
    shares = np.zeros((80, 3))
    np.add.at(shares, (place // 1000, doc), n)
    assert n.sum() == 80_000 and (shares.sum(1) == 1000).all()
    assert (np.abs(shares - np.array([500, 375, 125])) <= 150).all()


def test_sequences(spark, docs):
    pieces = packing.pack(docs, tokenizer_path(), window=256)
    full = packing.sequences(pieces, 256).collect()
    assert all(len(r["ids"]) == 4 * (r["n_tokens"] if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 256) for r in full)


def test_tokenizer_memory():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path())
    model.encode_special_tokens = True
    odd = ["it's 'sing --'s don't. Été.” é. ≮ a̸= É! x². ①, a b\x1cz  q K İx. ß. 12,3a.b|c ’s", "<|endoftext|> a", "", "  ", "a.. b., c . d", "× . ÷. ç, œ. ñ.", "é. ab́c, x́", "THE The the."]
    fast = packing.ChunkTokenizer(tokenizer_path())
    for _ in range(2):
        assert fast.encode([t.encode() for t in odd]) == [np.array(model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]


# --- substrings ------------------------------------------------------------------------------------------------


def plain_repeats(texts, width):
    starts = Counter(tuple(w[i : i + width]) for t in texts for w in [words(t)] for i in range(len(w) - width + 1))
    out = []
    for t in texts:
        w = words(t)
        gone = {k for i in range(len(w) - width + 1) if starts[tuple(w[i : i + width])] > 1 for k in range(i, i + width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width, anchor", [(35, 11), (12, 5), (3, 2)])
def test_repeats(docs, rows, empty, width, anchor):
    found = substrings.remove_repeats(docs, width, anchor)
    assert found.columns[: len(docs.columns)] == docs.columns
    got = Counter((r["doc_id"], r["n_words_before"], r["n_words_removed"], r["kept_digest"]) for r in found.collect())
    want = Counter((r[0], *x) for r, x in zip(rows, plain_repeats([r[1] for r in rows], width), strict=True))
    assert got == want
    assert substrings.remove_repeats(empty, width, anchor).count() == 0


def test_untouched_text_stays(docs, rows):
    got = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs).where("n_words_removed = 0").collect()}
    assert all(got[r[0]] == r[1] for r in rows if r[0] in got)


def test_log():
    rng = np.random.default_rng(4)
    batches = [rng.integers(0, 400, rng.integers(1, 60)).astype(np.uint64) for _ in range(12)]
    log = substrings.FingerprintLog()
    for b in batches:
        log.add(b)
    seen = np.concatenate(batches)
    count = Counter(seen.tolist())
    assert log.again.tolist() == [count[x] > 1 for x in seen.tolist()]
    assert len(log.runs) < 8 and all((np.diff(r[0].astype(np.int64)) > 0).all() for r in log.runs)
    assert log.first().sum() == len(count)


def test_index_over_batches(spark, rows, tmp_path):
    index = substrings.SubstringIndex(f"file://{tmp_path}/index", fan_in=3)
    texts = [r[1] for r in rows if r[0] is not None and r[1]]
    history = []
    for k in range(4):
        batch = [(i, t) for i, t in enumerate(texts) if i % 4 == k]
        df = spark.createDataFrame(batch, "doc_id long, text string")
        got = {r["doc_id"]: r["n_words_removed"] for r in substrings.remove_repeats(df, 12, 5, index=index).collect()}
        want = plain_repeats(history + [t for _, t in batch], 12)[len(history) :]
        assert got == {i: x[1] for (i, _), x in zip(batch, want, strict=True)}
        history += [t for _, t in batch]
    assert 1 <= len(index.runs(spark)) < 3


# --- quality ---------------------------------------------------------------------------------------------------


def plain_statistics(text):
    w = words(text)
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if words(line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(win)
    covered = {k for i, x in enumerate(win) if count[x] > 1 for k in range(i, i + 5)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


def test_statistics(rows):
    more = ["a b c d e f g a b c d e", "x\nx\n\n\ny\nx", "#1 *2 & <b> é", "a a a a a a a", "1 2 3 4 5"]
    for t in [r[1] for r in rows] + more:
        assert quality.statistics((t or "").encode())[:5] == plain_statistics(t)


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:60]] + [(5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    judge = quality.fit(docs, labels)
    got = quality.assess(docs, judge).collect()
    assert len(got) == len(rows)
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
    kept = quality.keep(docs, judge)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)
    none = quality.fit(docs, labels.limit(0))
    assert all(r["kept"] != r["base_failed"] for r in quality.assess(docs, none).collect())
    assert quality.assess(empty, quality.fit(empty, labels)).count() == 0


def test_forest_on_held_out_rows():
    import pyarrow.parquet as pq

    docs = {r["doc_id"]: r["text"] for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()}
    labels = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()
    stats = np.array([quality.statistics(docs[r["doc_id"]].encode()) for r in labels])
    good = np.array([r["quality"] > 0 for r in labels])
    half = np.arange(len(labels)) % 2 == 0
    judge = quality.Judge(stats[half], good[half])
    score = judge.forest.score(quality.features(stats[~half]))
    rest = good[~half]
    auc = np.mean([a < b for a in score[rest] for b in score[~rest]])
    assert auc > 0.9
    clean = rest & ~quality.base_failed(stats[~half])
    assert (score[clean] <= judge.threshold).mean() > 0.97


def test_all_labelled_rows_count(spark):
    """More labelled rows than a driver should gather: the forest and its threshold are those of all of them, in any layout."""
    rng = np.random.default_rng(4)
    n = 21_000
    known = np.array("a bc def Ghij klmno, pqrstu. vw 12 x# yz!".split())
    texts = [" ".join(known[rng.integers(0, len(known), m)]) for m in rng.integers(12, 40, n)]
    ids, good = rng.permutation(10 * n)[:n] - 5, rng.random(n) < 0.9
    docs = spark.createDataFrame(list(zip(ids.tolist(), texts, strict=True)), "doc_id long, text string")
    labels = spark.createDataFrame(list(zip(ids.tolist(), good.astype(int).tolist(), strict=True)), "doc_id long, quality int")
    judge = quality.fit(docs.repartition(2), labels.repartition(5))
    right = set(ids[good].tolist())
    passing = [r for r in quality.assess(docs, judge).collect() if r["doc_id"] in right and not r["base_failed"]]
    above = sum(r["score"] > judge.threshold for r in passing)
    same = sum(r["score"] == judge.threshold for r in passing)
    assert above <= int(quality.MAX_GOOD_LOST * len(passing)) < above + same
    want = quality.Judge(np.array([quality.statistics(t.encode()) for t in texts]), good, keys=ids)
    assert judge.threshold == want.threshold
    assert all(np.array_equal(a, b) for x, y in zip(judge.forest.trees, want.forest.trees, strict=True) for a, b in zip(x, y, strict=True))
    for count in (1, 50, 7000, n):
        at, tree = quality.deal(ids[:count], 300, quality.how_often(count))
        assert set(at.tolist()) == set(range(count)) and len(set(zip(at.tolist(), tree.tolist(), strict=True))) == len(at)


# --- language model --------------------------------------------------------------------------------------------


def test_scores_by_hand(docs, rows, empty):
    net = lm_score.train(docs, rounds=1, mask_every=2)
    got = Counter((r["doc_id"], r["n_words"], round(r["log_likelihood"], 3)) for r in lm_score.score(docs, net).collect())
    want = Counter()
    for r in rows:
        ids = net.vocabulary.ids(lm_score._keys((r[1] or "").encode().lower().split())).tolist()
        framed = [net.pad] * 2 + ids + [net.pad] * 2
        total = 0.0
        for i, y in enumerate(ids):
            h = np.tanh(net.base + sum(t[framed[i + 2 + o]] for t, o in zip(net.side, (-2, -1, 1, 2), strict=True)))
            for logits, k in ((h @ net.to_class + net.class_bias, y // 64), (h @ net.to_word[y // 64] + net.word_bias[y // 64], y % 64)):
                total += logits[k] - np.log(np.exp(logits.astype(np.float64)).sum())
        want[(r[0], len(ids), round(total, 3))] += 1
    assert sum((got & want).values()) >= len(rows) - 2  # float32 sums may round the other way
    assert lm_score.score(empty, net).count() == 0 and lm_score.score(empty).count() == 0


def test_model_beats_unigrams_and_shuffles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train, held = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0")
    net = lm_score.train(train)
    per_word = lambda d: (lambda r: r[0] / r[1])(lm_score.score(d, net).agg(F.sum("log_likelihood"), F.sum("n_words")).first())
    start = lm_score.Network(*lm_score.vocabulary(train))
    before = (lambda r: r[0] / r[1])(lm_score.score(held, start).agg(F.sum("log_likelihood"), F.sum("n_words")).first())
    natural = per_word(held)
    assert natural > before + 0.1
    every = [w for r in held.collect() for w in (r["text"] or "").split()]
    np.random.default_rng(0).shuffle(every)
    mixed = spark.createDataFrame([(i, " ".join(every[i : i + 300])) for i in range(0, len(every), 300)], "doc_id long, text string")
    assert per_word(mixed) < natural - 0.1


# --- decontamination -------------------------------------------------------------------------------------------


def test_edit_distances():
    rng = np.random.default_rng(0)
    for _ in range(40):
        item, window = rng.integers(0, 4, 6), rng.integers(0, 4, 10)
        row = [0] * 11
        for i, x in enumerate(item):
            new = [row[0] + 1]
            for j, y in enumerate(window):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        assert decontaminate.edit_distances(item[None], window[None])[0][0] == min(row)


def test_leaks(spark, docs, rows, empty):
    rng = np.random.default_rng(1)
    items = [(0, rows[20][1]), (1, "never seen words only here twice over and over again my friend"), (2, None), (3, ""), (4, "short one"), (None, rows[21][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    spoiled = rows[22][1].split()
    copy = spoiled.copy()
    for at in rng.choice(len(copy), len(copy) // 6, replace=False):
        copy[at] = f"new{at}"
    bench = bench.union(spark.createDataFrame([(5, " ".join(copy))], bench.schema))
    got = {(r["doc_id"], r["item_id"]): r["edit_distance"] for r in decontaminate.find(docs, bench).collect()}
    assert got[(20, 0)] == 0 and got[(21, None)] == 0 and got[(22, 5)] == len(spoiled) // 6
    by_hand = set()
    for r in rows:
        w = decontaminate.words_of((r[1] or "").encode())
        for i, t in [*items, (5, " ".join(copy))]:
            own = decontaminate.words_of((t or "").encode())
            if own and w:
                ids = {x: k for k, x in enumerate(sorted({*w, *own}))}
                d, _ = decontaminate.edit_distances(np.array([[ids[x] for x in own]]), np.array([[ids[x] for x in w]]))
                if d[0] <= int(0.2 * len(own) + 1e-9):
                    by_hand.add((r[0], i))
    assert set(got) == by_hand
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in rows if r[0] not in {d for d, _ in by_hand})
    assert decontaminate.find(docs, bench, block_bytes=200).count() == len(decontaminate.find(docs, bench).collect())
    assert decontaminate.find(empty, bench).count() == 0 and decontaminate.find(docs, bench.limit(0)).count() == 0


def test_recall_at_the_limit():
    rng = np.random.default_rng(5)
    items = [(i, " ".join(f"w{rng.integers(400)}" for _ in range(int(rng.integers(15, 60)))).encode()) for i in range(60)]
    bench = decontaminate.Benchmark(items)
    hits = 0
    for i, text in items * 3:
        w = text.split()
        for _ in range(int(0.2 * len(w))):
            at, kind = int(rng.integers(len(w))), int(rng.integers(3))
            w[at : at + (kind < 2)] = [b"zz%d" % rng.integers(1000)] * (kind != 1)
        noise = [b"w%d" % rng.integers(400) for _ in range(80)]
        hits += any(x[0] == i for x in bench.matches([b" ".join(noise[:40] + w + noise[40:])])[0])
    assert hits / 180 >= 0.9


# --- licences --------------------------------------------------------------------------------------------------


def test_licenses(spark, empty):
    texts = [
        "Released under the MIT License.", "x CC BY-NC 4.0 y cc by", "All Rights\nReserved all rights reserved", None, "", "This work is licensed under the GNU General Public License, version 3.",
        "general public", "CC-BY", "Licensed under the Apache License, Version 2.0.", "éall rights reserved", "License MIT the under released", "lİcense mit license",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (0, texts[0], "x")], "doc_id long, text string, labels string")
    got = sorted(licenses.scan(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[r["doc_id"] or 0]
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r["labels"] for r in got if r["doc_id"] is not None}
    assert by[0] == "mit" and by[5] == "gpl,gpl-3.0" and by[8] == "apache-2.0" and by[1] == "cc-by,cc-by-nc-4.0" and by[10] == ""
    assert licenses.scan(empty).count() == 0


# --- sharding --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_sharding(docs, rows, empty, law):
    got = sharding.shard(docs, 4, law).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    if law == "rows":
        assert max(map(len, by.values())) - min(len(by[k]) for k in range(4)) <= 1
    assert sharding.shard(empty, 4, law).count() == 0


def test_one_group_is_split(spark):
    df = spark.createDataFrame([(i % 3, "same") for i in range(300)] + [(i, f"text {i}") for i in range(100)], "doc_id long, text string")
    sizes = Counter()
    for r in sharding.shard(df, 8, "bytes", tolerance=0.01).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 12

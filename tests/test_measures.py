"""Measures of text quality against brute force, and on long texts that have nothing in common."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import reports


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_counts_and_subsequences(spark):
    """Texts of few words, so that words repeat, and of many, so that most stand on one side; without words and without references too."""
    rng = np.random.default_rng(5)
    words = lambda most, kinds: " ".join(f"w{k}" for k in rng.integers(0, kinds, rng.integers(0, most)))
    rows = [(i, words(25, kinds), [words(15, kinds) for _ in range(i % 4)]) for i, kinds in enumerate([3, 8, 60] * 40)]
    df = spark.createDataFrame(rows, "i int, p string, refs array<string>")
    p, refs = T.split_words(F.col("p")), F.transform("refs", T.split_words)
    got = df.select("i", *[T.clipped(p, refs, n).alias(f"c{n}") for n in (1, 2, 3, 4)], F.transform(refs, lambda r: T.lcs_length(p, r)).alias("lcs")).collect()
    grams = lambda x, n: Counter(tuple(x[k : k + n]) for k in range(len(x) - n + 1))
    for r in got:
        _, a, held = rows[r["i"]]
        a, held = a.split(), [h.split() for h in held]
        for n in (1, 2, 3, 4):
            most = Counter()
            for h in held:
                most |= grams(h, n)
            assert r[f"c{n}"] == sum((grams(a, n) & most).values())
        assert r["lcs"] == [lcs(a, h) for h in held]


def test_long_texts_without_common_words(spark):
    """What one side lacks is told apart by hash, not by comparing all with all."""
    long = lambda mark: " ".join(f"{mark}{k}" for k in range(12000))
    df = spark.createDataFrame([(1, [long("a") + " same"], [long("b") + " same"])], "qid int, answers array<string>, refs array<string>")
    began = time.monotonic()
    r = reports.generation_quality(df).first()
    assert time.monotonic() - began < 12
    assert r["rouge_1"] == r["rouge_l"] == pytest.approx(100 / 12001) and r["rouge_2"] == 0

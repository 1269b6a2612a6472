"""Maps of scores ranked in blocks, against the long table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import curves, ranking
from plumbline.plans import evaluate


def table(spark, n=700, key=str):
    rng = np.random.default_rng(3)
    rows = []
    for i in rng.permutation(n).tolist():
        held = {"tied": float(rng.integers(3)), "free": float(rng.normal()), "hot": 1.0, "odd": [None, float("nan"), float("inf"), 0.5][i % 4]}
        rows.append((key(i), {k: v for k, v in held.items() if i % 5 or k != "free"} if i % 7 else None))
    rows += [(key(1), {"tied": 9.0}), (key(n + 1), {"unasked": 1.0, "tied": 2.0}), (None, {"tied": 1.0})]
    kind = "string" if key is str else "long"
    quality = [(key(i), None if i % 11 == 0 else float(rng.integers(2)) * (1 + i % 3)) for i in range(n) if i % 13]
    return spark.createDataFrame(rows, f"qid {kind}, m map<string,double>").repartition(5), spark.createDataFrame(quality, f"qid {kind}, quality double")


@pytest.mark.parametrize("key", [str, int])
@pytest.mark.parametrize("size", [64, 1 << 19])
def test_blocks_and_the_long_table_agree(spark, monkeypatch, key, size):
    monkeypatch.setattr(curves, "RANGE", size)
    scores, quality = table(spark, key=key)
    read = lambda df: {r["uq_column"]: tuple(r)[1:] for r in df.collect()}
    long = scores.where("m is not null").select("qid", F.explode("m").alias("uq_column", "uq"))
    want = read(ranking.rank(long.join(quality, "qid"))) | {"unasked": (0, None, None, None)}
    for usual in ([], ["tied", "free", "hot", "odd"]):
        got = read(curves.rank_maps(scores, "m", quality, usual))
        assert set(got) == set(want)
        for name, row in want.items():
            assert got[name] == tuple(x if x is None else pytest.approx(x, abs=1e-9, nan_ok=True) for x in row), name
    assert read(curves.rank_maps(scores.limit(0), "m", quality, [])) == {}
    assert {r[0] for r in read(curves.rank_maps(scores, "m", quality.limit(0), [])).values()} == {0}


def test_a_range_is_cut_within_a_tie():
    rows = np.zeros(10, curves._ROW)
    rows["uq"], rows["place"] = [0, 1, 1, 1, 1, 1, 1, 2, 2, 3], [5, 1, 2, 3, 4, 5, 6, 1, 2, 0]
    assert curves._cut(rows, rows[[3, 7]]) == [0, 4, 8, 10]


def test_maps_are_computed_once(spark):
    """Neither the names of the columns nor the ranking computes the scores again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(str(i), {"a": i / 7, "b": 1.0}) for i in range(50)], "qid string, entropies map<string,double>")
    found = spark.createDataFrame([(str(i), float(i % 2)) for i in range(50)], "qid string, accuracy double")
    got = evaluate.rank_scores(found, rows.mapInArrow(counted, rows.schema), "squad", method="kle", decimals=6).collect()
    assert len(got) == 6 and seen.value == 50

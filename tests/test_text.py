import math

import pytest
from pyspark.sql import functions as F

from plumbline.functions import numeric as N
from plumbline.functions import text as T
from plumbline.operators import votes


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


def test_normalize(spark):
    assert value(spark, T.normalize_answer(F.lit("The_Cat's  hat, an Apple"))) == "cat s hat apple"
    assert value(spark, T.normalize_answer(F.lit(None).cast("string"))) == ""
    assert value(spark, T.normalize_answer(F.lit("The A an"))) == ""


def test_spaces(spark):
    assert value(spark, T.remove_extra_spaces(F.lit(" a , b ( c ) [ d ] { e }  ! "))) == "a, b (c) [d] {e}!"
    assert value(spark, T.normalize_spaces(F.lit("  Paris,\t France "))) == "paris, france"


def test_overlaps(spark):
    a, b = F.lit("the cat sat on mat"), F.lit("the cat on the mat")
    assert value(spark, T.lcs_length(T.split_words(a), T.split_words(b))) == 4
    assert value(spark, T.rouge_l(a, b)) == pytest.approx(0.8)
    assert value(spark, T.rouge_n(a, b, 1)) == pytest.approx(0.8)
    assert value(spark, T.rouge_n(a, b, 2)) == pytest.approx(0.25)
    assert value(spark, T.rouge_n(F.lit("x"), b, 2)) == 0
    assert value(spark, T.token_f1(F.lit("cat cat dog"), F.lit("the cat"))) == pytest.approx(2 * 1 / (3 + 1))
    assert value(spark, T.rouge_l(F.lit(""), b)) == 0
    assert value(spark, T.lexical_similarity(F.lit(" "), F.lit(""))) == 1
    assert value(spark, T.lexical_similarity(F.lit("a"), F.lit(""))) == 0


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_lcs_against_table(spark):
    import random

    random.seed(4)
    rows = [([random.choice("abcd") for _ in range(random.randrange(12))], [random.choice("abcd") for _ in range(random.randrange(12))]) for _ in range(60)]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select("a", "b", T.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r["n"] == lcs(r["a"], r["b"]) for r in got)


def test_containment(spark):
    assert value(spark, T.exact_match(F.lit("Paris, France"), F.lit("paris"))) == 1
    assert value(spark, T.exact_match(F.lit("Lyon"), F.lit("paris"))) == 0
    assert value(spark, T.exact_match(F.lit("Lyon"), F.lit(""))) == 1


def test_bleu(spark):
    refs = arr("the cat is on the mat")
    assert value(spark, T.sentence_bleu(F.lit("the cat is on the mat"), refs)) == pytest.approx(1)
    # one unigram of two, nothing longer: numerators smoothed to 0.1, brevity penalty exp(1 - 6/2)
    want = math.exp(1 - 6 / 2) * math.exp(0.25 * (math.log(1 / 2) + math.log(0.1 / 1) + math.log(0.1) + math.log(0.1)))
    assert value(spark, T.sentence_bleu(F.lit("the dog"), refs)) == pytest.approx(want)
    assert value(spark, T.sentence_bleu(F.lit("dog"), refs)) == 0
    assert value(spark, T.sentence_bleu(F.lit(""), refs)) == 0
    assert value(spark, T.sentence_bleu(F.lit("x"), arr())) == 0


def test_votes(spark):
    assert value(spark, votes.majority(arr("Paris", "the paris", "Lyon"))) == "paris"
    assert value(spark, votes.majority(arr("Rome", "Lyon", "Lyon", "rome!"))) == "rome"
    assert value(spark, votes.majority(arr())) == ""
    assert value(spark, votes.prediction(arr("The", "the"))) == ""
    numbers = F.array(*[F.lit(x) for x in (1.0, 2.0, 2.0000001, 1.0, None)])
    assert value(spark, votes.numeric_majority(numbers)) == 1.0
    assert value(spark, votes.numeric_majority(F.array().cast("array<double>"))) is None


@pytest.mark.parametrize(
    "text, want",
    [("1,234", 1234), ("$5", 5), ("3/4", 0.75), ("3/0 or 7", 7), ("from 2 to 1,000.5 km", 1000.5), ("-1e3", -1000), ("none", None), ("", None), (None, None), ("1_000", 1000)],
)
def test_to_number(spark, text, want):
    assert value(spark, N.to_number(F.lit(text).cast("string"), True)) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("so #### 1,234\n5", 1234),
        ("<<1+1=2>> then <<9>> 3", 9),
        ("thus \\boxed{7} and 8", 7),
        ("The final answer is 12 of 20", 12),
        ("Answer: 5\nbye 9", 5),
        ("Therefore, he earns 30 dollars, 2 left", 30),
        ("Therefore, the total is 31 dollars", 31),
        ("= 9 x 2", None),
        ("it is 4", 4),
        ("", None),
    ],
)
def test_final_answer(spark, text, want):
    assert value(spark, N.final_answer(F.lit(text), True)) == want


def test_truncation_and_tolerance(spark):
    assert value(spark, N.looks_truncated(F.lit("we get (")))
    assert not value(spark, N.looks_truncated(F.lit("done.")))
    assert value(spark, N.close_enough(F.lit(1.05), F.lit(1.0), 0.1)) == 1
    assert value(spark, N.close_enough(F.lit(None).cast("double"), F.lit(1.0), 0.1)) == 0
    assert value(spark, N.gold_answer(F.lit("a #### b #### 1,200"))) == 1200


def test_replies(spark):
    assert value(spark, T.entailment_label(F.lit("Neutral... or Entailment"))) == 2
    assert value(spark, T.entailment_label(F.lit("?"))) == 1
    assert value(spark, T.thinking(F.lit("<think>a b</think>c"))) == ("a b", "c")
    assert value(spark, T.thinking(F.lit("</think>c<think>"))) == ("", "</think>c<think>")
    assert value(spark, T.truncate_chars(F.lit("abcdefgh"), 1)) == "abcd"
    assert value(spark, T.truncate_chars(F.lit("abcdefgh"), 0)) == "abcdefgh"

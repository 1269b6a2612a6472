import random

import pytest

WORDS = "the of and alpha beta gamma delta river stone cloud light paper glass metal forest meadow ocean island valley summit bridge castle garden window mirror candle shadow silver copper".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ed", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empties, ties, repeated rows, a long text, copies, near copies and shared passages."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(15, 120)) for _ in range(60)]
    passage = prose(rng, 60)
    texts = base + [base[0]] * 12 + [base[1] + " tail"] + [t + "\n" + passage for t in base[2:8]]
    texts += [None, "", "  \n\t ", "one", "Été naïve ça\tİx", prose(rng, 5000), "a b c d", "A  B\nC d"]
    out = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 0, "x", "clash") for i, t in enumerate(texts)]
    out.append(out[5])  # a repeated row
    out.append((None, base[9], "en", "s1", 0, "x", "clash"))  # a null id
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, n_words string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)

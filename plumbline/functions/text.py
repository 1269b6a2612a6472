"""Text normalisation and answer-quality measures as column expressions.

A "words" argument is an array of strings.  Measures treat null text as empty and return doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII punctuation marks and four quotation marks that normalisation turns into blanks.
PUNCTUATION = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~‘’´]"
#: Where blanks are taken out, in order.
SPACING = [
    (r"\s+([,.!?;:])", "$1"),
    (r"\(\s+", "("),
    (r"\s+\)", ")"),
    (r"\[\s+", "["),
    (r"\s+\]", "]"),
    (r"\{\s+", "{"),
    (r"\s+\}", "}"),
    (r"\s+", " "),
]


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def split_words(c: Column) -> Column:
    """Words between white space (Unicode, as Python splits); an empty array for empty text."""
    return F.filter(F.split(text(c), r"(?U)\s+"), lambda w: w != "")


def normalize_answer(c: Column) -> Column:
    """Lower case; underscores and punctuation to blanks; English articles dropped; single blanks."""
    plain = F.regexp_replace(F.lower(text(c)), PUNCTUATION, " ")
    return F.array_join(split_words(F.regexp_replace(plain, r"\b(a|an|the)\b", " ")), " ")


def normalize_spaces(c: Column) -> Column:
    """Lower case and single blanks; punctuation stays."""
    return F.array_join(split_words(F.lower(text(c))), " ")


def remove_extra_spaces(c: Column) -> Column:
    """Blanks before closing and after opening punctuation go, runs of white space become one blank."""
    out = text(c)
    for pattern, to in SPACING:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def exact_match(prediction: Column, reference: Column) -> Column:
    """1 if the normalised reference is contained in the normalised prediction (an empty one always is)."""
    return F.contains(normalize_answer(prediction), normalize_answer(reference)).cast("int")


def counts(words: Column) -> Column:
    """Map from each word to how often it occurs."""
    return F.map_from_entries(F.transform(F.array_distinct(words), lambda w: F.struct(w, F.size(F.filter(words, lambda x: x == w)))))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two word arrays."""
    return F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda n, w: n + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w)))
    )


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often and in whatever lambda the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _both(a: Column, b: Column, body) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda x: body(x["a"], x["b"]))


def _f1(same: Column, a: Column, b: Column) -> Column:
    # 2pr / (p + r) with p = same / |a| and r = same / |b|
    return let(same, lambda s: F.when(s > 0, 2.0 * s / (F.size(a) + F.size(b))).otherwise(0.0))


def token_f1(prediction: Column, reference: Column) -> Column:
    return _both(split_words(normalize_answer(prediction)), split_words(normalize_answer(reference)), lambda a, b: _f1(overlap(a, b), a, b))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: of the words that both sides have, one row of the table folded over ``a``.  A
    word changes the row only from the places on where ``b`` has it."""

    def raised(row: Column, found: Column) -> Column:
        at = lambda x, j: F.aggregate(found, x, lambda most, k: F.when(k <= j, F.greatest(most, F.get(row, k - 1) + 1)).otherwise(most))
        return F.transform(row, at)

    def fold(held: Column) -> Column:
        places = F.when(F.size(held["b"]) > 0, F.sequence(F.lit(1), F.size(held["b"]))).otherwise(F.array().cast("array<int>"))
        step = lambda row, word, places: let(F.filter(places, lambda k: F.get(held["b"], k - 1) == word), lambda found: raised(row, found))
        return let(places, lambda p: F.array_max(F.aggregate(held["a"], F.array_repeat(F.lit(0), F.size(held["b"]) + 1), lambda row, word: step(row, word, p))))

    def shared(held: Column) -> Column:
        own = lambda words: F.filter(words, lambda w: F.array_contains(held["both"], w))
        return let(F.struct(own(held["a"]).alias("a"), own(held["b"]).alias("b")), fold)

    def compared(a: Column, b: Column) -> Column:
        both = F.struct(a.alias("a"), b.alias("b"), F.array_intersect(a, b).alias("both"))
        return let(both, lambda held: F.when(F.size(held["both"]) == 0, F.lit(0)).otherwise(shared(held)))

    return _both(a, b, compared)


def rouge_l(prediction: Column, reference: Column) -> Column:
    """F1 of the longest common subsequence of white-space words; 0 without overlap."""
    return _both(split_words(prediction), split_words(reference), lambda a, b: _f1(lcs_length(a, b), a, b))


def lexical_similarity(one: Column, other: Column) -> Column:
    """ROUGE-L of space-normalised texts; two empty texts are alike, one empty is unlike."""
    return words_alike(split_words(normalize_spaces(one)), split_words(normalize_spaces(other)))


def words_alike(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(_f1(lcs_length(a, b), a, b))


def ngrams(words: Column, n: int) -> Column:
    if n == 1:
        return F.coalesce(words, F.array().cast("array<string>"))
    # A slice would copy the whole array for each place.
    gram = lambda own, i: F.concat_ws(" ", *[F.get(own, i + k) for k in range(n)])
    return let(words, lambda own: F.when(F.size(own) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(own) - n), lambda i: gram(own, i))))


def rouge_n(prediction: Column, reference: Column, n: int) -> Column:
    return _both(ngrams(split_words(prediction), n), ngrams(split_words(reference), n), lambda a, b: _f1(overlap(a, b), a, b))


def best(references: Column, measure) -> Column:
    """The largest value of ``measure(reference)`` over an array of references, 0 for an empty one."""
    return F.coalesce(F.array_max(F.transform(references, measure)), F.lit(0.0))


def clipped(prediction: Column, references: Column, n: int) -> Column:
    """n-grams of the prediction that the references hold, each counted at most as often as in the fullest reference.  Which ones are
    held is found by hash; only those are counted."""

    def matched(grams: Column, held: Column, g: Column) -> Column:
        most = F.array_max(F.transform(held, lambda r: F.size(F.filter(r, lambda x: x == g))))
        return F.least(F.size(F.filter(grams, lambda x: x == g)), F.coalesce(most, F.lit(0)))

    grams, held = ngrams(prediction, n), F.transform(references, lambda r: ngrams(r, n))
    return _both(grams, held, lambda own, refs: F.aggregate(F.array_intersect(own, F.flatten(refs)), F.lit(0), lambda total, g: total + matched(own, refs, g)))


def closest_length(prediction: Column, references: Column) -> Column:
    """Length of the reference nearest in length to the prediction, the shorter on a tie."""
    n = F.size(prediction)
    return F.array_min(F.transform(references, lambda r: F.struct(F.abs(F.size(r) - n).alias("d"), F.size(r).alias("n"))))["n"]


def bleu_of(hits: list[Column], totals: list[Column], length: Column, reference_length: Column) -> Column:
    """BLEU-4 with uniform weights from counts; no unigram hit gives 0, other zero counts are smoothed to 0.1."""
    logs = [F.log(F.when(h == 0, F.lit(0.1)).otherwise(h.cast("double")) / F.greatest(t, F.lit(1))) for h, t in zip(hits, totals, strict=True)]
    penalty = F.when(length > reference_length, F.lit(1.0)).otherwise(F.exp(1 - reference_length / length))
    return F.when((hits[0] == 0) | (length == 0), F.lit(0.0)).otherwise(penalty * F.exp(0.25 * (logs[0] + logs[1] + logs[2] + logs[3])))


def sentence_bleu(prediction: Column, references: Column) -> Column:
    """Of a text against an array of reference texts, on white-space words."""
    return _both(split_words(prediction), F.transform(references, split_words), _bleu)


def _bleu(a: Column, refs: Column) -> Column:
    empty = (F.size(a) == 0) | (F.coalesce(F.array_max(F.transform(refs, F.size)), F.lit(0)) == 0)
    totals = [F.greatest(F.size(a) - n + 1, F.lit(0)) for n in (1, 2, 3, 4)]
    counted = F.struct(*[clipped(a, refs, n).alias(f"h{n}") for n in (1, 2, 3, 4)], closest_length(a, refs).alias("length"))
    return F.when(empty, F.lit(0.0)).otherwise(let(counted, lambda c: bleu_of([c[f"h{n}"] for n in (1, 2, 3, 4)], totals, F.size(a), c["length"])))


def exact_match_confidence(answers: Column) -> Column:
    """Share of the later answers that equal the first after space normalisation; 1 if there is none."""
    first = normalize_spaces(F.get(answers, F.lit(0)))
    later = F.slice(answers, 2, F.greatest(F.size(answers) - 1, F.lit(0)))
    same = F.size(F.filter(later, lambda x: normalize_spaces(x) == first))
    return F.when(F.size(answers) == 0, F.lit(0.0)).when(F.size(later) == 0, F.lit(1.0)).otherwise(same / F.size(later))


def thinking(c: Column) -> Column:
    """``struct(thinking, answer)``: what stands between the think tags and after them; malformed text is all answer."""
    t = text(c)
    start, end = F.locate("<think>", t), F.locate("</think>", t)
    ok = (start > 0) & (end > start)
    return F.struct(
        F.when(ok, F.trim(F.substring(t, start + 7, end - start - 7))).otherwise(F.lit("")).alias("thinking"),
        F.when(ok, F.trim(F.substring(t, end + 8, F.length(t)))).otherwise(t).alias("answer"),
    )


def entailment_label(c: Column) -> Column:
    """Label (2, 1 or 0) that a model's reply names; entailment goes before neutral, what names none is neutral."""
    t = F.lower(text(c))
    return F.when(F.contains(t, F.lit("entailment")), 2).when(F.contains(t, F.lit("neutral")), 1).when(F.contains(t, F.lit("contradiction")), 0).otherwise(1)


def truncate_chars(c: Column, max_tokens: int) -> Column:
    """Without a tokenizer: the first four characters a token; zero or less leaves the text as it is."""
    return c if max_tokens <= 0 else F.substring(c, 1, 4 * max_tokens)

"""Numbers in free text: conversion, extraction of final answers, comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import let, text

#: What counts as a number, a fraction, a final-answer marker, and a cut-off tail.
NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?(?:[eE][+-]?\d+)?"
FRACTION = r"(-?\d+)\s*/\s*(-?\d+)"
PLAIN = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"
HASHES = r"####+\s*([^\n\r]+)"
ANGLES = r"<<\s*([^<>]+?)\s*>>"
BOXED = r"\\boxed\{([^{}]+)\}"
PHRASES = [
    r"(?dim)^\s*(?:final\s+answer|answer)\s*[:：-]?\s*(.+)$",
    r"(?di)(?:the\s+)?final\s+(?:numerical\s+)?answer\s*(?:is|:)\s*(.+)",
    r"(?di)(?:the\s+)?answer\s*(?:is|:)\s*(.+)",
    r"(?dim)^\s*(?:thus|therefore|so),?\s+.*?\b(?:is|are)\s+(.+)$",
    r"(?dim)^\s*(?:thus|therefore|so),?\s+.*?\b(?:makes?|earns?|gets?|costs?)\s+(.+)$",
]
#: What a text must hold, in lower case, for the closing phrase in the same place to match.
HINTS = [("answer",), ("answer",), ("answer",), ("thus", "therefore", "so"), ("thus", "therefore", "so")]
ANSWERED = r"(?i)(####+|\\boxed\{|final\s+answer|final\s+numerical\s+answer)"
NUMERIC_LINE = r"^[$\s]*[-+]?\d+(?:,\d{3})*(?:\.\d+)?\s*$"
ANY_NUMBER = r"-?\d+(?:,\d{3})*(?:\.\d+)?"
DANGLING = r"(?i)(?:[=+\-*/×x:]|\\\[|\\\(|\\text\{?|\{|\(|\[|\b(?:of|from|by|for|to|the|a|an|in|on|at)\b)\s*$"
UNFINISHED = r"(?i)(?:=\s*)?-?\d+(?:,\d{3})*(?:\.\d+)?\s*[×x*/+\-]\s*-?\d+(?:,\d{3})*(?:\.\d+)?\s*$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _plain(c: Column) -> Column:
    """The whole text as a number, as Python reads it; else null."""
    return F.when(c.rlike(PLAIN) | c.rlike(SPECIAL), F.translate(c, "_", "").try_cast("double"))


def _spans(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1))


def _span_value(c: Column) -> Column:
    return F.translate(c, ",", "").try_cast("double")


def first_number(c: Column) -> Column:
    return _span_value(F.get(_spans(text(c)), F.lit(0)))


def last_number(c: Column) -> Column:
    return let(_spans(text(c)), lambda spans: _span_value(F.get(spans, F.size(spans) - 1)))


def to_number(c: Column, dollars: bool = False) -> Column:
    """The text as a number; else as a fraction with a denominator other than 0; else its last number; else null."""

    def of(t: Column) -> Column:
        bare = _strip(F.translate(t, ",$" if dollars else ",", ""))
        top, bottom = (F.regexp_extract(t, FRACTION, i).try_cast("double") for i in (1, 2))
        fraction = F.when(t.contains("/"), let(bottom, lambda b: F.when(b != 0, top / b)))
        return F.coalesce(let(bare, _plain), fraction, last_number(t))

    return let(_strip(text(c)), of)


def _last(c: Column, pattern: str) -> Column:
    return let(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda found: F.get(found, F.size(found) - 1))


def looks_truncated(c: Column) -> Column:
    """Whether a worked answer seems cut off before its result."""
    s = F.regexp_replace(text(c), r"(?U)\s+$", "")
    lines = F.filter(F.transform(F.split(s, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), _strip), lambda x: x != "")
    last = F.coalesce(F.get(lines, F.size(lines) - 1), s)
    sound = last.rlike(ANY_NUMBER) & ~last.rlike(DANGLING) & ~last.rlike(UNFINISHED)
    return F.when(s == "", True).otherwise(~(s.rlike(ANSWERED) | last.rlike(NUMERIC_LINE) | sound | s.rlike(r"[.!?)\]}]$")))


def final_answer(c: Column, conservative: bool = False) -> Column:
    """The final number of a worked answer: after ``####``, in the last ``<<>>``, in the last box, after a closing
    phrase (its first number), else the text's own number; with ``conservative`` null for texts that seem cut off."""

    def of(s: Column) -> Column:
        # A pattern is only tried on texts that hold what it needs; looking for that costs far less.
        holds = lambda low, *words: reduce(Column.__or__, [low.contains(w) for w in words])
        marked = F.when(s.contains("####"), let(F.regexp_extract(s, HASHES, 1), lambda x: F.when(x != "", to_number(x, True))))
        spans = [F.when(s.contains(mark), let(_last(s, p), lambda x: F.when(x.isNotNull(), to_number(x, True)))) for p, mark in ((ANGLES, "<<"), (BOXED, "\\boxed{"))]
        phrases = lambda low: F.coalesce(*[F.when(holds(low, *words), let(_last(s, p), lambda x: F.when(x.isNotNull(), first_number(x)))) for p, words in zip(PHRASES, HINTS, strict=True)])
        closing = let(F.lower(s), phrases)
        rest = to_number(s, True)
        return F.coalesce(marked, *spans, closing, F.when(~looks_truncated(s), rest) if conservative else rest)

    return let(text(c), of)


def gold_answer(c: Column) -> Column:
    """The number after the last ``####``."""
    return to_number(F.substring_index(text(c), "####", -1), True)


def close_enough(prediction: Column, gold: Column, tolerance: float) -> Column:
    return F.coalesce((F.abs(prediction - gold) <= tolerance).cast("int"), F.lit(0))

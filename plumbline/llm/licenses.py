"""License detection by a positional index of rare words, with DataFrame functions only.

One pass keeps, of each text, the words that occur in licence templates, with their positions.  How many
documents hold each such word gives its weight (IDF over all documents).  The index is a table of postings, (word, template,
place, weight), in which every template's rarest words are marked.  Texts with a marked word are looked up there, and
the postings met are grouped by where the template would begin: enough of its rarest words must agree on one beginning, and
all words of its key phrases must stand at their places.  Templates are data; the plan does not depend on them.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: Fixed by contract: phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label, template, key phrases that must stand at their places in it.  Key phrases avoid very common words, which
#: would have to be kept for every text.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["hereby granted free", "associated documentation files"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "gnu affero general public license", ["gnu affero general public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"]),
    ("creative-commons", "licensed under a creative commons attribution license", ["creative commons attribution"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["binary forms", "without modification"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released", "public domain"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["use copy modify"]),
    *((label, phrase, [phrase]) for phrase, label in BASE.items()),
]
RARE = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def licence_words(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n_words, held)``: held are the words of ``vocabulary`` in a text, as ``(i, w)`` in order of place."""
    words = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), _PARTING), "")
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    # lower() also changes letters beyond ASCII, so it only picks what translate() then decides.
    held = F.filter(F.transform("words", lambda w, i: F.when(F.lower(w).isin(vocabulary), F.struct(i.alias("i"), F.translate(w, _UPPER, _LOWER).alias("w")))), lambda x: x.isNotNull())
    return kept.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(held, lambda x: x["w"].isin(vocabulary)).alias("held"))


#: Words too common to weigh, unless a phrase needs them.
_COMMON = {"the", "to", "of", "a", "and", "in", "is", "this", "or", "are", "as", "for", "any", "with", "into"}


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of a few constants."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def postings(templates: list, base: dict[str, str], idf: dict[str, float], rare: int) -> list[dict]:
    """One row per word of a template that has a weight or belongs to a key phrase: ``w, t, place, share`` (of the template's weight),
    whether it is among the ``rare`` rarest (``is_rare``) or in a key phrase (``is_key``), and of the template how many of
    either must be met (``need``, ``keys``), its label, and whether it is a base phrase."""
    out = []
    for t, (label, text, keys) in enumerate(templates):
        words = text.split()
        weight = [idf.get(w, 0.0) for w in words]
        whole = sum(weight) or 1.0
        rarest = sorted((k for k, w in enumerate(words) if w in idf), key=lambda k: (-weight[k], k))[:rare]
        must = set()
        for key in keys:
            n = len(key.split())
            at = next(k for k in range(len(words)) if words[k : k + n] == key.split())
            must.update(range(at, at + n))
        common = {"t": t, "need": min(2, len(rarest)), "keys": len(must), "label": label, "is_base": base.get(text) == label}
        out += [{"w": w, "place": k, "share": weight[k] / whole, "is_rare": k in rarest, "is_key": k in must, **common} for k, w in enumerate(words) if w in idf]
    return out


_POSTING = "w:string,place:int,share:double,is_rare:boolean,is_key:boolean,t:int,need:int,keys:int,label:string,is_base:boolean"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list | None = None, base: dict[str, str] | None = None, rare: int = RARE) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row.

    Base phrases are counted wherever they stand.  A template is found where at least two of its ``rare`` rarest
    words (one, if it has but one) agree on its beginning and its key phrases stand at their places; ``score`` is
    the largest share of a template's IDF weight that stands at one beginning, 0 if no template is found.
    Null and empty texts have no words.  Null ids and repeated rows are scanned like any row; extra columns are
    not read; an empty table gives an empty one.
    """
    base = base or BASE
    templates = templates or TEMPLATES
    templates = [*templates, *((label, phrase, [phrase]) for phrase, label in base.items() if (label, phrase, [phrase]) not in templates)]
    needed = sorted({w for _, t, keys in templates for p in (t, *keys) for w in p.split() if w not in _COMMON} | {w for _, _, keys in templates for k in keys for w in k.split()})
    kept = cut(licence_words(docs, needed, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    words = F.transform("held", lambda x: x["w"])
    counts = {r["w"]: r["n"] for r in kept.select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a vocabulary word
    total = kept.count()
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1e-3 for w in needed}

    index = postings(templates, base, idf, rare)
    marked = F.from_json(F.lit(json.dumps(sorted({p["w"] for p in index if p["is_rare"]}))), "array<string>")
    looked = kept.where(F.arrays_overlap(words, marked)).select("row", F.inline("held"))
    # As many rows as the templates have words: the index is always small.
    met = looked.join(F.broadcast(_rows(docs.sparkSession, index, _POSTING)), "w").groupBy("row", "t", (F.col("i") - F.col("place")).alias("begin"))
    of_template = ["need", "keys", "label", "is_base"]
    starts = met.agg(F.sum("share").alias("share"), F.count_if("is_rare").alias("n_rare"), F.count_if("is_key").alias("n_key"), *[F.any_value(c).alias(c) for c in of_template])
    starts = starts.where((F.col("n_rare") >= F.col("need")) & (F.col("n_key") == F.col("keys")))
    in_base = lambda c: F.when(F.col("is_base"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = starts.groupBy("row").agg(
        F.count_if("is_base").alias("n_base"),
        F.min(in_base("begin")).cast("long").alias("first_word"),
        F.max(in_base("begin")).cast("long").alias("last_word"),
        joined(in_base("label")).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.round(F.least(F.max("share"), F.lit(1.0)), 6).alias("score"),
    )
    rows = kept.select("row", "doc_id", "n_words").join(found, "row", "left")
    return rows.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0}).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

"""One JSON document (UTF-8) that many tasks read and write.

JSON has no line ends inside its texts, so every line begins outside of them: a file is read by lines, in splits, and how deep
each split begins follows from the brackets of those before.  What leaves the executors is a few numbers a split.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.stored import stored

_TOKEN = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\[\]{},]')


class _Scan:
    """Cuts a split's text at the commas of the list that holds the elements.  Section 0 is what is open where the split begins."""

    def __init__(self, depth: int, level: int):
        self.depth, self.level = depth, level
        self.section, self.k = 0, 0
        self.name: str | None = None  # the last text at the depth of the document's keys
        self.opened: list[list] = [[0, None, None, 0]] if depth >= level else []  # section, bracket, name, commas
        self.held: list[str] = []

    def _piece(self, text: str) -> tuple[int, int, str, bool]:
        self.held.append(text)
        whole, self.held = "\n".join(self.held), []
        return self.section, self.k, whole, self.section > 0 or self.k > 0

    def feed(self, text: str) -> Iterator[tuple[int, int, str, bool]]:
        """Pieces ``(section, place, text, begun in this split)`` that end in ``text``."""
        start, level = 0, self.level
        for m in _TOKEN.finditer(text):
            c = text[m.start()]
            if c == '"':
                if self.depth == 1:
                    self.name = m.group()
            elif c == ",":
                if self.depth == level:
                    yield self._piece(text[start : m.start()])
                    start = m.end()
                    self.k += 1
                    self.opened[-1][3] += 1
            elif c in "[{":
                self.depth += 1
                if self.depth == 1 and (c == "[") != (level == 1):
                    raise ValueError("the document is no " + ("list" if level == 1 else "object"))
                if self.depth == level:
                    self.section, self.k, start = self.section + 1, 0, m.end()
                    self.opened.append([self.section, c, self.name and json.loads(self.name), 0])
            else:
                if self.depth == level:
                    yield self._piece(text[start : m.start()])
                self.depth -= 1
        if self.depth >= level:
            self.held.append(text[start:])

    def rest(self) -> tuple[int, int, str, bool] | None:
        return self._piece("") if self.depth >= self.level else None


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], str]]:
    """((file, start of the split), text) of successive rows of one split."""
    for b in batches:
        if not b.num_rows:
            continue
        file, at = (b.column(c).to_numpy() for c in ("file", "at"))
        ends = np.r_[0, np.flatnonzero((np.diff(file) != 0) | (np.diff(at) != 0)) + 1, b.num_rows].tolist()
        for i, j in zip(ends, ends[1:]):
            yield (int(file[i]), int(at[i])), "\n".join(b.column("value").slice(i, j - i).to_pylist())


_SECTIONS = "file long, at long, section int, bracket string, name string, commas int, head string, tail string, pending string"


def _sections(depths: dict, level: int):
    """A row for each list or object that a split sees, with the pieces that its ends cut off."""

    def rows(key: tuple[int, int], scan: _Scan, head: str | None) -> pa.RecordBatch:
        last = scan.rest()
        tail = None
        if last is not None:
            head, tail = (head, last[2]) if last[3] else (last[2], None)
        pending = scan.name and json.loads(scan.name)
        found = scan.opened or [[-1, None, None, 0]]
        fields = zip(*[(*key, *s, head if s[0] == 0 else None, tail if i == len(found) - 1 else None, pending) for i, s in enumerate(found)], strict=True)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(fields, kinds, strict=True)], [c.split()[0] for c in _SECTIONS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scan, head = None, None, None
        for here, text in _runs(batches):
            if here != key:
                if scan is not None:
                    yield rows(key, scan, head)
                key, scan, head = here, _Scan(depths[here], level), None
            for *_, piece, begun in scan.feed(text):
                head = head if begun else piece
        if scan is not None:
            yield rows(key, scan, head)

    return run


def _whole(depths: dict, places: dict, level: int):
    """The elements that begin and end in one split, with their place in the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, scan = None, None
        for here, text in _runs(batches):
            if here != key:
                key, scan = here, _Scan(depths[here], level)
            wanted = places.get(here, {})
            found = [(piece, wanted[s] + k) for s, k, piece, begun in scan.feed(text) if begun and s in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([e for e, _ in found], pa.string()), pa.array([k for _, k in found], pa.int32())], ["element", "ordinal"])

    return run


def read_elements(spark: SparkSession, path: str | list[str], key: str | None) -> DataFrame:
    """``(element, ordinal)``: the elements, as JSON text, of the list under the top-level ``key`` of a document, or of the list that
    the document is.  Files of a folder follow each other in the order of their names, be they parts of one document or documents."""
    level = 1 if key is None else 2
    lines = spark.read.text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_path").alias("path"))
    bare = F.regexp_replace(F.regexp_replace("value", r"\\.", ""), r'"[^"]*"', "")
    deeper = F.length(F.translate(bare, "]}", "")) - F.length(F.translate(bare, "[{", ""))
    splits = lines.groupBy("file", "at").agg(F.min("path").alias("path"), F.sum(deeper).alias("deeper")).collect()  # one row a split
    depth, depths = 0, {}
    for s in sorted(splits, key=lambda s: (s["path"], s["at"])):
        depths[s["file"], s["at"]] = depth
        depth += s["deeper"]
    if depth:
        raise ValueError(f"no whole JSON document: {path}")
    lines = lines.select("value", "file", "at")
    sections = stored(lines.mapInArrow(_sections(depths, level), _SECTIONS))
    seen: dict = {}
    for s in sections.drop("head", "tail").orderBy("section").collect():  # a few rows a split
        seen.setdefault((s["file"], s["at"]), []).append(s)
    number, wanted, count, pending, places, cut = 0, False, 0, None, {}, []
    for unit, (at, _) in enumerate(depths.items()):
        for s in seen.get(at, []):
            if s["section"] > 0:
                name = pending if s["name"] is None else s["name"]
                number, wanted, count = number + 1, s["bracket"] == "[" and (key is None or name == key), 0
            if wanted and s["section"] >= 0:
                places.setdefault(at, {})[s["section"]] = count
                cut.append((*at, s["section"], unit, number, count))
            count += s["commas"]
        pending = next((s["pending"] for s in seen.get(at, []) if s["pending"] is not None), pending)
    known = spark.createDataFrame(cut, "file long, at long, section int, unit int, number int, base int")
    ends = sections.join(F.broadcast(known), ["file", "at", "section"])
    piece = lambda text, place: F.struct("number", place.alias("ordinal"), F.struct("unit", F.col(text).alias("text")).alias("p"))
    pieces = ends.select(F.explode(F.array(piece("head", F.col("base")), piece("tail", F.col("base") + F.col("commas")))).alias("x")).select("x.*").where("p.text is not null")
    joined = pieces.groupBy("number", "ordinal").agg(F.array_join(F.array_sort(F.collect_list("p"))["text"], "\n").alias("element")).select("element", "ordinal")
    return lines.mapInArrow(_whole(depths, places, level), "element string, ordinal int").union(joined).where(F.col("element").rlike(r"\S"))


def write_document(rows: DataFrame, path: str, head: str = "[", tail: str = "]", order: list[str] | None = None) -> None:
    """One JSON document, UTF-8 as it is: ``rows(element)``, each a piece of JSON, between ``head`` and ``tail``.

    The folder's part files, one after another by name, are the document; each is written by a task of its own, row by row, so
    that no task sorts or holds the whole.
    """
    spark = rows.sparkSession
    # The first range holds its own upper bound, so the first row has the id 0.
    rows = rows.orderBy(*order) if order else rows.coalesce(1)
    lines = rows.select(F.when(F.monotonically_increasing_id() == 0, F.col("element")).otherwise(F.concat(F.lit(","), "element")).alias("value"))
    edge = lambda text: spark.range(1, numPartitions=1).select(F.lit(text).alias("value"))
    edge(head).union(lines).union(edge(tail)).write.mode("overwrite").text(path)

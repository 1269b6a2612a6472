"""Many score columns of the same rows, ranked at once: what ``ranking.rank`` gives, for maps of scores.

A row a question is stored, not a row a question and column.  Batches of rows are turned into columns, sorted and cut at bounds
common to all batches, and travel as blocks of numbers; a column's blocks meet in order of their ranges, so a task holds one range
at a time and carries running totals from each to the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.stored import stored

#: About how many rows a range has, and how many rows a range are looked at to choose its bounds.
RANGE, LOOKED_AT = 1 << 19, 256
_BLOCKS = "uq_column string, range int, first long, rows binary"
_ROW = np.dtype([("uq", "f8"), ("place", "i8"), ("quality", "f8")])


def _placed(quality: DataFrame) -> DataFrame:
    """``quality(qid, quality)`` with a number that orders as qid does."""
    q = quality.where(F.col("qid").isNotNull() & F.col("quality").isNotNull()).select("qid", F.col("quality").cast("double").alias("quality"))
    if isinstance(q.schema["qid"].dataType, T.IntegralType):
        return q.withColumn("place", F.col("qid").cast("long"))
    ids = stored(q.select("qid").distinct().repartitionByRange("qid").withColumn("b", F.spark_partition_id().cast("long")))
    place = F.shiftleft("b", 40) + F.row_number().over(Window.partitionBy("b").orderBy("qid"))
    return q.join(ids.select("qid", place.alias("place")), "qid")


def _cells(b: pa.RecordBatch, usual: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(names, rows, scores) of the rows of a batch that have the same names; null stands for the usual ones."""
    values = b.column("scores")
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts, flat = np.cumsum(sizes) - sizes, values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    own: dict[tuple | None, list[int]] = {}
    names = b.column("names")
    if names.null_count == len(names):
        own[None] = list(range(len(names)))
    else:
        for i, x in enumerate(names.to_pylist()):
            own.setdefault(x if x is None else tuple(x), []).append(i)
    for form, rows in own.items():
        form, at = usual if form is None else list(form), np.array(rows, np.int64)
        yield form, at, flat[starts[at, None] + np.arange(len(form))]


def _cut(rows: np.ndarray, bounds: np.ndarray | None) -> list[int]:
    """Where sorted rows are cut at sorted bounds ``(uq, place)``; a row at a bound goes before it."""
    if bounds is None:
        return [0, len(rows)]
    low, high = (np.searchsorted(rows["uq"], bounds["uq"], side) for side in ("left", "right"))
    within = [i + int(np.searchsorted(rows["place"][i:j], p, "right")) for i, j, p in zip(low.tolist(), high.tolist(), bounds["place"].tolist(), strict=True)]
    return [0, *within, len(rows)]


def _sorted_columns(scores: np.ndarray, place: np.ndarray, quality: np.ndarray) -> Iterator[np.ndarray]:
    """For each column the rows that have a score, by score and place."""
    by_place = np.argsort(place, kind="stable")
    place, quality = place[by_place], quality[by_place]
    columns = np.ascontiguousarray(scores[by_place].T)
    for values, order in zip(columns, np.argsort(columns, axis=1, kind="stable"), strict=True):
        rows = np.empty(len(values) - int(np.isnan(values).sum()), _ROW)
        order = order[: len(rows)]  # what is no number is sorted last
        rows["uq"], rows["place"], rows["quality"] = values[order], place[order], quality[order]
        yield rows


class _Curve:
    """Running totals of one column over its rows in order, given a range at a time."""

    def __init__(self) -> None:
        self.n, self.sum, self.means, self.first, self.last = 0, 0.0, 0.0, 0.0, 0.0
        self.low, self.high = np.inf, -np.inf
        self.good, self.bad, self.lost = 0, 0, 0.0
        self.tie: tuple[float, int, int] | None = None  # the last uncertainty's good and bad rows, not counted above

    def add(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        uq, quality = rows["uq"], rows["quality"]
        sums = self.sum + np.cumsum(quality)
        means = sums / (self.n + np.arange(1, len(rows) + 1))
        if not self.n:
            self.first = means[0]
        self.n, self.sum, self.last = self.n + len(rows), sums[-1], means[-1]
        self.means += means.sum()
        self.low, self.high = min(self.low, quality.min()), max(self.high, quality.max())
        starts = np.flatnonzero(np.r_[True, uq[1:] != uq[:-1]])
        good = np.add.reduceat((np.trunc(quality) == 1).astype(np.int64), starts)
        bad = np.diff(np.r_[starts, len(rows)]) - good
        if self.tie is not None:
            if self.tie[0] == uq[0]:
                good[0], bad[0] = good[0] + self.tie[1], bad[0] + self.tie[2]
            else:
                self._count(np.array([self.tie[1]]), np.array([self.tie[2]]))
        self._count(good[:-1], bad[:-1])
        self.tie = uq[-1], int(good[-1]), int(bad[-1])

    def _count(self, good: np.ndarray, bad: np.ndarray) -> None:
        self.lost += float((good * (self.bad + np.cumsum(bad) - bad / 2)).sum())  # to bad rows of less uncertainty, ties at half
        self.good, self.bad = self.good + int(good.sum()), self.bad + int(bad.sum())

    def found(self) -> tuple:
        """matched, auroc, auarc, prr"""
        if not self.n:
            return 0, None, None, None
        self._count(np.array([self.tie[1]]), np.array([self.tie[2]]))
        auroc = 1 - self.lost / (self.good * self.bad) if self.good and self.bad else None
        auarc = (self.means - (self.first + self.last) / 2) / (self.n - 1) if self.n > 1 else None
        apart = abs(self.low - self.high) > 1e-8 + 1e-5 * abs(self.high)
        return self.n, auroc, auarc, (self.means / self.n - self.low) / (self.high - self.low) if apart else 0.5


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of column and range as a row a column."""
    column, at, held, curve = None, None, [], None

    def close() -> None:
        rows = np.frombuffer(b"".join(held), _ROW)
        curve.add(rows[np.lexsort((rows["place"], rows["uq"]))])

    def out() -> pa.RecordBatch:
        n, *measures = curve.found()
        return pa.RecordBatch.from_arrays([pa.array([column]), pa.array([n], pa.int64()), *(pa.array([None if x is None else float(x)], pa.float64()) for x in measures)], ["uq_column", "matched", "auroc", "auarc", "prr"])

    for b in batches:
        for name, number, block in zip(*(b.column(c) for c in ("uq_column", "range", "rows")), strict=True):
            name, number = name.as_py(), number.as_py()
            if (name, number) != (column, at):
                if curve is not None:
                    close()
                    held.clear()
                if name != column or curve is None:
                    if curve is not None:
                        yield out()
                    curve = _Curve()
                column, at = name, number
            held.append(block.as_py())
    if curve is not None:
        close()
        yield out()


def rank_maps(scores: DataFrame, column: str, quality: DataFrame, usual: list[str], decimals: int | None = None) -> DataFrame:
    """``uq_column, matched, auroc, auarc, prr`` (see ``ranking.rank``) of every key of ``scores(qid, <column>: map from name to score)``;
    keys that no question with quality has a score under are matched 0 times.  Maps with the ``usual`` keys in order are
    the cheaper ones.  ``decimals``: scores are rounded to so many first, half to even.
    """
    spark, names = scores.sparkSession, F.map_keys(column)
    standard = names == F.array(*[F.lit(x) for x in usual]) if usual else F.lit(False)
    own = scores.where(F.col(column).isNotNull()).select("qid", F.when(~standard, names).alias("names"), F.transform(F.map_values(column), lambda x: x.cast("double")).alias("scores"))
    table = stored(own.join(_placed(quality), "qid", "left").select("names", "scores", "place", "quality"))
    total = table.where("place is not null").count()
    ranges = max(1, -(-total // RANGE))
    bounds: dict[str, np.ndarray] = {}
    if ranges > 1:
        looked_at = table.where(F.col("place").isNotNull() & (F.pmod(F.xxhash64("place"), F.lit(max(1, total // (ranges * LOOKED_AT)))) == 0)).toArrow()
        cells: dict[str, list[np.ndarray]] = {}
        for b in looked_at.to_batches():
            place = b.column("place").to_numpy()
            for form, at, x in _cells(b, usual):
                x = x if decimals is None else np.round(x, decimals) + 0.0
                for name, rows in zip(form, _sorted_columns(x, place[at], np.zeros(len(at))), strict=True):
                    cells.setdefault(name, []).append(rows)
        for name, found in cells.items():
            rows = np.concatenate(found)
            rows = rows[np.lexsort((rows["place"], rows["uq"]))]
            if len(rows) >= ranges:
                bounds[name] = rows[np.arange(1, ranges) * len(rows) // ranges]
    told = spark.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column("place").is_valid().to_numpy(zero_copy_only=False)
            place, quality = b.column("place").fill_null(0).to_numpy(), b.column("quality").fill_null(0).to_numpy()
            for form, at, x in _cells(b, usual):
                x, at = x[known[at]], at[known[at]]
                x = x if decimals is None else np.round(x, decimals) + 0.0
                found = []
                for name, rows in zip(form, _sorted_columns(x, place[at], quality[at]), strict=True):
                    cuts = _cut(rows, told.value.get(name))
                    blocks = [(name, k, int(rows["place"][i]), rows[i:j].tobytes()) for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)) if i < j]
                    found += blocks or [(name, 0, 0, b"")]
                if found:
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["uq_column", "range", "first", "rows"])

    dealt = table.mapInArrow(deal, _BLOCKS).repartition("uq_column").sortWithinPartitions("uq_column", "range", "first")
    return dealt.mapInArrow(_ranked, "uq_column string, matched long, auroc double, auarc double, prr double")

"""Histogram sort: splitters found by counting, then one exchange.

A key is a few 64-bit integers, compared in order.  The driver probes candidate boundaries; each round one pass
over the narrow key table sums the exact bytes between probes (every partition looks its keys up in the sorted probes, and
sends partial sums), and the interval around each wanted split narrows until it is met within the
tolerance.  Where all candidates inside an interval share the leading integer, the next one is probed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut

LOW, HIGH = -(1 << 63), (1 << 63) - 1


class Bounds:
    """Ascending candidate boundaries; one that names the leading integers only stands for the smallest key that begins so."""

    def __init__(self, bounds: list[tuple[int, ...]], width: int):
        self.parts = np.array([(*b, *[LOW] * (width - len(b))) for b in bounds], np.int64).reshape(len(bounds), width)

    def reached(self, key: list[np.ndarray]) -> np.ndarray:
        """How many bounds each key is at least: one binary search for all keys."""
        lo, hi = np.zeros(len(key[0]), np.int64), np.full(len(key[0]), len(self.parts))
        for _ in range(len(self.parts).bit_length()):
            open_ = lo < hi
            mid = np.minimum((lo + hi) // 2, max(len(self.parts) - 1, 0))
            at_least = np.ones(len(lo), bool)
            for own, bound in zip(reversed(key), reversed(self.parts.T), strict=True):
                bound = bound[mid]
                at_least = (own > bound) | ((own == bound) & at_least)
            lo, hi = np.where(open_ & at_least, mid + 1, lo), np.where(open_ & ~at_least, mid, hi)
        return lo


def _counts(rows: DataFrame, keys: list[str], weight: str, bounds: list[tuple[int, ...]]) -> list[tuple[int, int]]:
    """Exact weight and number of the rows below each bound.  Partitions send sums by interval."""
    told = rows.sparkSession.sparkContext.broadcast(Bounds(bounds, len(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(told.value.parts) + 1
        sums, counts = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            at = told.value.reached([b.column(k).to_numpy() for k in keys])
            np.add.at(sums, at, b.column(weight).to_numpy())
            counts += np.bincount(at, minlength=n)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met]), pa.array(counts[met])], ["b", "w", "n"])

    partial = rows.select(*dict.fromkeys([*keys, weight])).mapInArrow(run, "b long, w long, n long")
    found = {r["b"]: (r["w"], r["n"]) for r in partial.groupBy("b").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect()}  # a row an interval
    total, count, out = 0, 0, []
    for i in range(len(bounds)):
        w, n = found.get(i, (0, 0))
        total, count = total + w, count + n
        out.append((total, count))
    return out


def splitters(rows: DataFrame, keys: list[str], weight: str, parts: int, tolerance: float = 0.002, fan: int = 16, max_rounds: int = 300) -> tuple[list[tuple[int, ...]], int, int]:
    """``parts - 1`` ascending bounds that cut the weight evenly, the total weight, and how many rounds it took.

    Each is within ``tolerance`` of a part's weight of its target, or, where one key alone weighs more, next to it.
    """
    total = rows.agg(F.sum(weight)).first()[0] or 0
    targets = [total * i / parts for i in range(1, parts)]
    slack = tolerance * total / parts
    # For each split: the integers fixed so far, the open interval of the next one, and the best bound with its error.
    state = [{"lead": (), "lo": LOW, "hi": HIGH, "best": None, "error": float("inf"), "done": total == 0} for _ in targets]
    spent = 0
    for spent in range(max_rounds):
        probes = set()
        for s in state:
            if not s["done"]:
                width = s["hi"] - s["lo"]
                steps = min(fan, width)
                s["probes"] = sorted({(*s["lead"], s["lo"] + width * i // (steps + 1)) for i in range(1, steps + 1)} | {(*s["lead"], s["hi"])}) if width else [(*s["lead"], s["lo"])]
                probes.update(s["probes"])
        if not probes:
            break
        bounds = sorted(probes)
        below = dict(zip(bounds, _counts(rows, keys, weight, bounds), strict=True))
        for s, target in zip(state, targets, strict=True):
            if s["done"]:
                continue
            for p in s["probes"]:
                if abs(below[p][0] - target) < s["error"]:
                    s["best"], s["error"] = p, abs(below[p][0] - target)
            if s["error"] <= slack:
                s["done"] = True
                continue
            values = [below[p][0] for p in s["probes"]]
            i = bisect_left(values, target)  # the first probe with at least the target below it
            hi = s["probes"][i][-1] if i < len(values) else None
            lo = s["probes"][i - 1][-1] if i else s["lo"]
            if 0 < i < len(values) and below[s["probes"][i]][1] - below[s["probes"][i - 1]][1] <= 1:
                s["done"] = True  # a single row lies between: one of its sides is the nearest there is
                continue
            if hi is None:  # beyond the largest value of this integer
                lo, hi = s["probes"][-1][-1], s["probes"][-1][-1]
            if hi - lo <= 1:
                # All that lies between is the key that equals lo: go into it by the next integer.
                if len(s["lead"]) + 1 < len(keys):
                    s["lead"], s["lo"], s["hi"] = (*s["lead"], lo), LOW, HIGH
                else:
                    s["done"] = True
            else:
                s["lo"], s["hi"] = lo, hi
    else:
        raise RuntimeError("splitters did not settle")
    return sorted(s["best"] or (HIGH,) for s in state), total, spent


def shard(
    docs: DataFrame,
    shards: int = 8,
    law: str = "bytes",
    id_col: str = "doc_id",
    text_col: str = "text",
    tolerance: float = 0.002,
    rows_per_task: int = 100_000,
) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` of every row, in the order of (hash of text, id).

    Law ``bytes`` makes the shards' sizes near equal, law ``rows`` their row counts; a row's size is its text's
    UTF-8 bytes plus one.  Equal texts stand together, and are parted only where a split falls inside their group.
    The key ends with a stored row number, so that not even a third of all rows with one id and text is
    indivisible.  Null texts are empty, a null id sorts first, repeated rows have places of their own, extra columns are not read, and
    an empty table gives an empty one.  The one exchange deals rows to ranges inside the shards, about ``rows_per_task`` in each;
    a range's places begin where those before it in the shard end.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(law)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.monotonically_increasing_id().alias("n"),
    )
    rows = cut(rows.withColumns({"i": F.coalesce("doc_id", F.lit(LOW)), "one": F.lit(1).cast("long")}))
    keys, weight = ["h", "i", "n"], "size" if law == "bytes" else "one"
    count = rows.count()
    bounds, _, _ = splitters(rows, keys, weight, shards, 0.0 if law == "rows" else tolerance)
    told = docs.sparkSession.sparkContext.broadcast(Bounds(bounds, len(keys)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = told.value.reached([b.column(k).to_numpy() for k in keys])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "shard"])

    order = ["shard", *keys]
    narrow = ["doc_id", "size", "text_crc32", *keys]
    ranges = rows.select(*narrow).mapInArrow(placed, "doc_id long, size long, text_crc32 long, h long, i long, n long, shard int")
    ranges = cut(ranges.repartitionByRange(max(shards, -(-count // rows_per_task)), *order).sortWithinPartitions(*order).select("doc_id", "size", "text_crc32", "shard"))
    # Stored rows keep their partition and place in it, which this id names.
    ranges = ranges.withColumn("id", F.monotonically_increasing_id())
    ranges = ranges.select("doc_id", "size", "text_crc32", "shard", F.shiftright("id", 33).alias("range"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    held = ranges.groupBy("range", "shard").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("range", "shard").collect()  # at most ranges + shards rows
    filled, starts = [0] * shards, []
    for r in held:
        starts.append((r["range"], r["shard"], filled[r["shard"]] - r["first"]))
        filled[r["shard"]] += r["n"]
    table = docs.sparkSession.createDataFrame(starts, "range long, shard int, start long")
    return ranges.join(F.broadcast(table), ["range", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("start") + F.col("at")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )

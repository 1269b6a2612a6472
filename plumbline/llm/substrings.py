"""Substring deduplication with a log-structured index of window fingerprints.

Every window of ``width`` consecutive words has a fingerprint.  Windows are dealt to tasks by their anchor, the
least hash among the shorter word sequences inside; equal windows have equal anchors, and neighbours mostly
share one, so a run of windows travels as one packed row.  Rows are sorted by anchor and read as a stream; a task keeps
what it has seen of some anchors in a log of sorted, immutable runs: each new batch is sorted, merge-joined with the runs,
and becomes a run itself; runs of like size are compacted.

What matches is a candidate, and is verified: the words of the candidates' windows meet by anchor and are compared
themselves, so that a collision of hashes removes nothing.

With an index folder the log outlives the call: what a batch adds is written as a new sorted run with its words, the next
batch meets it, and after ``fan_in`` runs they are compacted into one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import batched, cut, doc_key, remove, unused, utf8

WIDTH = 35
ANCHOR = 11
FP_BYTES = 4
#: Bytes of text whose windows are dealt to one task, and rows (of whole anchors) that a task holds at a time.
TASK_BYTES, HELD_ROWS = 32 << 20, 50_000
_B = 0x9E3779B97F4A7C15 | 1
_ROWS = "key long, k_id long, k_text long, at int, n int, marked boolean, prints binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _sequence_hashes(words: np.ndarray, width: int, bits: int = 64) -> np.ndarray:
    """Hash of the ``width`` words from each place on, built by doubling; len(words) - width + 1 of them."""
    total, have, power, step = None, 0, words, 1
    while True:
        if width & step:
            m = len(words) - have - step + 1
            total = power[:m].copy() if total is None else total[:m] * np.uint64(pow(_B, step, 1 << 64)) + power[have : have + m]
            have += step
        step *= 2
        if step > width:
            return _mix(total) & np.uint64((1 << bits) - 1)
        half = step // 2
        power = power[: len(power) - half] * np.uint64(pow(_B, half, 1 << 64)) + power[half:]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step, least = 1, x
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def window_rows(split: list[list[bytes]], k_id: np.ndarray, k_text: np.ndarray, width: int, anchor: int, bits: int = 64) -> pa.RecordBatch | None:
    """Packed rows of the windows of some documents.

    Of windows that are equal among these documents all are ``marked`` as repeated, and only the first sends its
    fingerprint on: a passage that many documents share costs each task that reads them one row.
    """
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    keep = np.flatnonzero(sizes >= width)
    if not len(keep):
        return None
    digest = xxhash.xxh64_intdigest
    words = np.array([digest(w) for d in keep.tolist() for w in split[d]], np.uint64)
    sizes = sizes[keep]
    starts = np.cumsum(sizes) - sizes
    per = sizes - width + 1
    doc = np.repeat(np.arange(len(keep)), per)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    place = starts[doc] + at
    prints = _sequence_hashes(words, width, bits)[place]
    anchors = _sliding_min(_sequence_hashes(words, anchor, bits), width - anchor + 1)[place]

    order = np.argsort(prints, kind="stable")
    ranked = prints[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    marked, sends = np.empty(len(order), bool), np.empty(len(order), bool)
    marked[order], sends[order] = several, new

    key = np.where(sends, anchors, _mix(k_text[keep].view(np.uint64))[doc])
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (marked[1:] != marked[:-1]) | (sends[1:] != sends[:-1])
    first = np.flatnonzero(head)
    n = np.diff(np.r_[first, len(doc)])
    packed = prints[sends].view(np.uint8).reshape(-1, 8)[:, :FP_BYTES].tobytes()
    ends = np.cumsum(np.where(sends[first], n, 0)) * FP_BYTES
    own = keep[doc[first]]
    return pa.RecordBatch.from_arrays(
        [pa.array(key[first].view(np.int64)), pa.array(k_id[own]), pa.array(k_text[own]), pa.array(at[first].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(marked[first]), _binary(packed, ends)],
        ["key", "k_id", "k_text", "at", "n", "marked", "prints"],
    )


class FingerprintLog:
    """Sorted immutable runs of fingerprints, each with the entry that brought it first and whether it came again."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.again = np.zeros(0, bool)  # of each entry so far: its fingerprint is found elsewhere

    def add(self, prints: np.ndarray) -> None:
        """Merge-join a batch of entries with the runs, and keep what is new as a run."""
        base = len(self.again)
        ranked, first, back, count = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        known = np.zeros(len(ranked), bool)
        late = []
        for fps, owner, told in self.runs:
            at = np.searchsorted(fps, ranked)
            hit = np.flatnonzero(fps[np.minimum(at, len(fps) - 1)] == ranked)
            known[hit] = True
            old = at[hit]
            late.append(owner[old[~told[old]]])
            told[old] = True
        twice = known | (count > 1)
        self.again = np.concatenate([self.again, twice[back]])
        for owner in late:
            self.again[owner] = True
        fresh = ~known
        self.runs.append((ranked[fresh], base + first[fresh], twice[fresh]))
        while len(self.runs) > 1 and len(self.runs[-2][0]) < 2 * len(self.runs[-1][0]):
            a, b = self.runs.pop(), self.runs.pop()
            merged = np.concatenate([a[0], b[0]])
            order = np.argsort(merged, kind="stable")
            self.runs.append(tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True)))
        if not len(self.runs[-1][0]):
            self.runs.pop()

    def first(self) -> np.ndarray:
        """Of each entry: whether it brought its fingerprint into the log."""
        out = np.zeros(len(self.again), bool)
        for _, owner, _ in self.runs:
            out[owner] = True
        return out


def _unpack(column: pa.Array) -> np.ndarray:
    """All fingerprints of a column of packed ones, one after another."""
    joined = b"".join(column.to_pylist())
    out = np.zeros((len(joined) // FP_BYTES, 8), np.uint8)
    out[:, :FP_BYTES] = np.frombuffer(joined, np.uint8).reshape(-1, FP_BYTES)
    return out.view(np.uint64).ravel()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted by key -> rows that are repeated (``marked``) and rows with the fingerprints first seen here.
    Rows of whole keys are held, no more than are needed to reach ``HELD_ROWS``."""
    held, count = [], 0
    for b in batches:
        while b.num_rows:
            if count < HELD_ROWS:
                held.append(b.slice(0, HELD_ROWS - count))
                b = b.slice(held[-1].num_rows)
                count += held[-1].num_rows
                continue
            key = b.column("key").to_numpy()
            same = int(np.searchsorted(key, held[-1].column("key")[-1].as_py(), "right"))
            if same:
                held.append(b.slice(0, same))
                b = b.slice(same)
            if b.num_rows:
                yield from _searched(held)
                held, count = [], 0
    if held:
        yield from _searched(held)


def _searched(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    log, held = FingerprintLog(), []
    for b in batches:
        n = b.column("n").to_numpy().astype(np.int64)
        sent = np.fromiter(map(len, b.column("prints").to_pylist()), np.int64, b.num_rows) > 0
        entry = np.repeat(np.flatnonzero(sent), n[sent])
        prints = _unpack(b.column("prints"))
        key = b.column("key").to_numpy().view(np.uint64)
        log.add(_mix(prints ^ _mix(key)[entry]))
        held.append((b.drop_columns(["prints"]), n, sent, prints))
    fresh = log.first()
    done = 0
    for b, n, sent, prints in held:
        key, k_id, k_text, at, marked = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "k_id", "k_text", "at", "marked"))
        row = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        again, new = np.ones(len(row), bool), np.zeros(len(row), bool)
        size = int(n[sent].sum())
        again[sent[row]] = log.again[done : done + size]
        new[sent[row]] = fresh[done : done + size]
        all_prints = np.zeros(len(row), np.uint64)
        all_prints[sent[row]] = prints
        done += size
        hit = (again | marked[row]) & (at[row] >= 0)
        for rows, is_hit in ((np.flatnonzero(hit), True), (np.flatnonzero(new), False)):
            if not len(rows):
                continue
            r, o = row[rows], off[rows]
            head = np.ones(len(rows), bool)
            head[1:] = (r[1:] != r[:-1]) | (o[1:] != o[:-1] + 1)
            first = np.flatnonzero(head)
            count = np.diff(np.r_[first, len(rows)])
            packed = b"" if is_hit else all_prints[rows].view(np.uint8).reshape(-1, 8)[:, :FP_BYTES].tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[r[first]]), pa.array(k_id[r[first]]), pa.array(k_text[r[first]]), pa.array((at[r[first]] + o[first]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array([is_hit] * len(first)), _binary(packed, np.cumsum(count) * (0 if is_hit else FP_BYTES))],
                ["key", "k_id", "k_text", "at", "n", "marked", "prints"],
            )


def _windows(docs: DataFrame, width: int, anchor: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b, "text")
            k_id, k_text = b.column("k_id").to_numpy(), b.column("k_text").to_numpy()
            for i, j in batched(map(len, texts), 4_000_000):
                out = window_rows([t.split() for t in texts[i:j]], k_id[i:j], k_text[i:j], width, anchor, bits)
                if out is not None:
                    yield out

    return docs.mapInArrow(run, _ROWS)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, sorted by anchor -> ``(k_id, k_text, at)`` of the windows whose words stand nowhere else."""
    now, seen = None, {}
    alone: list[tuple[int, int, int]] = []

    def lonely():
        alone.extend(x for x in seen.values() if x is not None)

    for b in batches:
        for anchor, k_id, k_text, at, n, sure, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if anchor != now:
                lonely()
                now, seen = anchor, {}
            begins = [0, *accumulate(len(w) + 1 for w in words.split(b" "))]
            width = len(begins) - n
            for i in range(n):
                window = words[begins[i] : begins[i + width] - 1]
                seen[window] = None if sure or window in seen else (k_id, k_text, at + i)
        if len(alone) >= 100_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*alone, strict=True), _ALONE, strict=True)], schema=_ALONE)
            alone = []
    lonely()
    if alone:
        yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*alone, strict=True), _ALONE, strict=True)], schema=_ALONE)


_ALONE = pa.schema([("k_id", pa.int64()), ("k_text", pa.int64()), ("at", pa.int32())])
_CANDIDATES = pa.schema([("anchor", pa.int64()), ("k_id", pa.int64()), ("k_text", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("sure", pa.bool_()), ("words", pa.binary())])
_CANDIDATE = "anchor long, k_id long, k_text long, at int, n int, sure boolean, words binary"


def _anchored(words: list[bytes], spans: list[dict], width: int, anchor: int, bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Runs of windows of one document with the same anchor, among those of ``spans``: anchor, first window, how many, their words."""
    hashes = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    anchors = _sliding_min(_sequence_hashes(hashes, anchor, bits), width - anchor + 1)
    turn = np.zeros(len(anchors) + 1, np.int64)
    first = np.array([x["at"] for x in spans])
    np.add.at(turn, first, 1)
    np.add.at(turn, first + np.array([x["n"] for x in spans]), -1)
    at = np.flatnonzero(np.cumsum(turn[:-1]) > 0)
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (anchors[at[1:]] != anchors[at[:-1]])])
    for i, j in zip(head.tolist(), [*head[1:].tolist(), len(at)], strict=True):
        yield int(anchors[at[i]].view(np.int64)), int(at[i]), j - i, b" ".join(words[at[i] : at[i] + j - i + width - 1])


def _candidates(text_col: str, columns: tuple[str, str, str], width: int, anchor: int, bits: int):
    """Rows with spans -> the words of their candidate windows.  Runs that are equal in a batch go out once, as sure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(columns[2]).is_valid())
            texts, (ids, hashes, spans) = utf8(b, text_col), (b.column(c).to_pylist() for c in columns)
            for i, j in batched(map(len, texts), 4_000_000):
                found: dict[tuple, list] = {}
                for text, own, k_id, k_text in zip(texts[i:j], spans[i:j], ids[i:j], hashes[i:j], strict=True):
                    for key, at, n, words in _anchored(text.split(), own, width, anchor, bits):
                        if (row := found.get((key, n, words))) is None:
                            found[key, n, words] = [key, k_id, k_text, at, n, False, words]
                        else:
                            row[5] = True
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*found.values(), strict=True), _CANDIDATES, strict=True)], schema=_CANDIDATES)

    return run


class SubstringIndex:
    """A folder of sorted runs of the windows of all batches so far: their fingerprints, to be met, and their words, to verify.

    Documents are not kept, only windows, each once; so ids, nulls and columns of the batches do not matter, a batch
    that is given twice is found as repeated, and an empty one adds an empty run.
    """

    def __init__(self, path: str, fan_in: int = 8):
        self.path, self.fan_in = path.rstrip("/"), fan_in

    def _fs(self, spark):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def runs(self, spark) -> list[str]:
        path, fs = self._fs(spark)
        if not fs.exists(path):
            return []
        names = (x.getPath() for x in fs.listStatus(path))
        return sorted(p.toString() for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, spark) -> DataFrame | None:
        """``(key, prints, words)`` of all runs."""
        runs = self.runs(spark)
        return spark.read.parquet(*runs) if runs else None

    def append(self, rows: DataFrame) -> None:
        """Write ``rows(key, prints, words)``, a batch's new windows, as a run; compact if there are ``fan_in``."""
        spark = rows.sparkSession
        number = 1 + max((int(r.rsplit("-", 1)[1]) for r in self.runs(spark)), default=0)
        rows.repartition("key").sortWithinPartitions("key").write.parquet(f"{self.path}/run-{number:06d}")
        runs = self.runs(spark)
        if len(runs) >= self.fan_in:
            # Runs hold different fingerprints, so compaction is a merge by key.
            spark.read.parquet(*runs).repartition("key").sortWithinPartitions("key").write.parquet(f"{self.path}/run-{number + 1:06d}")
            for r in runs:
                remove(spark, r)


def _new_runs(text_col: str, column: str, width: int, anchor: int, bits: int):
    """Rows with spans -> ``(key, prints, words)`` of those windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, own in zip(utf8(b, text_col), b.column(column).to_pylist(), strict=True):
                words = text.split()
                prints = _sequence_hashes(np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64), width, bits)
                found = [(key, prints[at : at + n].view(np.uint8).reshape(-1, 8)[:, :FP_BYTES].tobytes(), joined) for key, at, n, joined in _anchored(words, own, width, anchor, bits)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["key", "prints", "words"])

    return run


def _tasks(docs: DataFrame, text_col: str) -> int:
    """How many tasks the windows are dealt to: a bounded share of the text each."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def _spans(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k_id", "k_text").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def _found(docs: DataFrame, width: int, anchor: int, bits: int, id_col: str, text_col: str, tasks: int, old: DataFrame | None) -> DataFrame:
    """Rows (see ``_searched``) of the windows of ``docs`` that meet equal fingerprints, and of those first seen."""
    rows = _windows(docs.select(*doc_key(id_col, text_col), F.col(text_col).alias("text")), width, anchor, bits)
    if old is not None:
        zero = F.lit(0).cast("long")
        rows = rows.union(old.select("key", zero, zero, F.lit(-1), (F.length("prints") / FP_BYTES).cast("int"), F.lit(False), "prints"))
    return rows.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_search, _ROWS)


def repeated_spans(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(k_id, k_text, spans)``: for each row of ``docs`` (see ``doc_key``) with windows whose fingerprints are met again, the
    candidates, where runs of such windows start, in words, and how many windows they hold."""
    return _spans(_found(docs, width, anchor, 64, id_col, text_col, _tasks(docs, text_col), None).where("marked"))


def remove_repeats(
    docs: DataFrame,
    width: int = WIDTH,
    anchor: int = ANCHOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    index: SubstringIndex | None = None,
    names: tuple[str, str, str] = ("n_words_before", "n_words_removed", "kept_digest"),
    bits: int = 64,
) -> DataFrame:
    """``docs`` with its text less every word that a repeated window covers, and three more columns at the end, called
    ``names``: words before, words removed, and the SHA-256 of the kept words joined by one space.

    A window is repeated if its words also start anywhere else, in any row, the same included; all its places are
    removed, the first one too.  Words are compared, not hashes only.  Where nothing is removed the text stays as it is, else
    the kept words are joined by one space.  A null text stays null and counts as empty; null ids are kept.  Rows that repeat an id
    and text are repeats of each other.  Columns of ``docs`` named like the new ones are replaced; an empty table gives an empty
    one.  With an ``index``, windows of earlier batches count too, and this batch's new ones are added to it.  Fewer ``bits`` of a
    hash only make more candidates to verify.
    """
    docs = docs.drop(*names)
    columns, spark = docs.columns, docs.sparkSession
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], T.LongType()), T.StructField(names[2], T.StringType())])
    own_id, own_text, spans, r_id, r_text, alone = unused(["_own_id", "_own_text", "_spans", "_r_id", "_r_text", "_alone"], columns)
    k_id, k_text = doc_key(id_col, text_col)
    keyed, tasks = docs.withColumns({own_id: k_id, own_text: k_text}), _tasks(docs, text_col)

    def met(rows: DataFrame, spans: DataFrame, values: str, as_: str, how: str = "left") -> DataFrame:
        """Rows with what their key has in ``spans``; both grow with the input, so this is a merge join."""
        right = spans.select(F.col("k_id").alias(r_id), F.col("k_text").alias(r_text), F.col(values).alias(as_)).hint("merge")
        return rows.join(right, (F.col(own_id) == F.col(r_id)) & (F.col(own_text) == F.col(r_text)), how).drop(r_id, r_text)

    old = index and index.read(spark)
    found = _found(docs, width, anchor, bits, id_col, text_col, tasks, old)
    if index is not None:
        found = cut(found)
        new = met(keyed, _spans(found.where("not marked and at >= 0")), "spans", spans, "inner")
        new = cut(new.mapInArrow(_new_runs(text_col, spans, width, anchor, bits), "key long, prints binary, words binary"))
    # Both uses of these rows read one exchange of the texts, as all columns go into either.
    joined = met(keyed, _spans(found.where("marked")), "spans", spans)
    candidates = joined.mapInArrow(_candidates(text_col, (own_id, own_text, spans), width, anchor, bits), _CANDIDATE)
    if old is not None:
        known = old.join(candidates.select("anchor").distinct().hint("merge"), F.col("key") == F.col("anchor"), "left_semi")
        zero = F.lit(0).cast("long")
        candidates = candidates.union(known.select("key", zero, zero, F.lit(0), (F.length("prints") / FP_BYTES).cast("int"), F.lit(True), "words"))
    lonely = candidates.repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(_verified, "k_id long, k_text long, at int")
    lonely = lonely.groupBy("k_id", "k_text").agg(F.collect_set("at").alias("at"))
    judged = met(joined, lonely, "at", alone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found, refuted = utf8(b, text_col), b.column(spans).to_pylist(), b.column(alone).to_pylist()
            old = b.column(text_col)
            kept, counts, removed, digests = [None] * len(texts), [], [], []
            for i, (text, own, but) in enumerate(zip(texts, found, refuted, strict=True)):
                words = text.split()
                counts.append(len(words))
                if own:
                    windows = np.zeros(len(words) + 1, np.int64)
                    at = np.array([x["at"] for x in own])
                    np.add.at(windows, at, 1)
                    np.add.at(windows, at + np.array([x["n"] for x in own]), -1)
                    repeated = np.cumsum(windows[:-1]) > 0
                    repeated[but or []] = False
                    at = np.flatnonzero(repeated)
                    turn = np.zeros(len(words) + 1, np.int64)
                    turn[at] = 1
                    np.add.at(turn, at + width, -1)
                    words = [words[k] for k in np.flatnonzero(np.cumsum(turn[:-1]) == 0)]
                joined = b" ".join(words)
                removed.append(counts[-1] - len(words))
                digests.append(hashlib.sha256(joined).hexdigest())
                kept[i] = joined.decode("utf-8") if removed[-1] else None
            changed = pa.array([n > 0 for n in removed])
            text = pa.compute.if_else(changed, pa.array(kept, old.type), old)
            yield pa.RecordBatch.from_arrays([*(text if c == text_col else b.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], [*columns, *names])

    out = judged.mapInArrow(run, schema)
    if index is not None:
        out = cut(out)
        index.append(new)
    return out

"""Mixture-controlled packing of tokenised documents by deficit round-robin.

Every source is a queue of tokens.  In round ``r`` queue ``s`` earns ``window * share_s`` tokens of credit, is
served as many whole quanta as its credit covers, and carries the rest on as its deficit.  After r rounds it
has been served ``quantum * floor(r * window * share_s / quantum)`` tokens, or all it has: a closed form, so any
task can place any document without the state of another, and no deficit is lost between windows or
partitions.  The served tokens form one stream, cut every ``window`` tokens into sequences; so each window
holds the target proportions within a quantum a queue, and only the last sequence needs padding.  A queue
that runs dry is passed over, and the rest fill the windows in their own proportions.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batched, cut, utf8

WINDOW = 4096
MAX_QUEUES = 256
MAX_PARTS = 16_384
QUANTUM = 256
_FIX = 16  # bits of the fixed-point credits; exact for queues of up to 2 ** 46 tokens
WORDS_HELD, MIXED_HELD = 1_000_000, 200_000
_TRAIL = b".,;:!?|$%&*#)"
#: ASCII letters, and those of Latin-1 that have one code point, so that no normalisation joins them to others.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_tokenizers: dict = {}


class ChunkTokenizer:
    """Ids of a text, white-space chunk by chunk, with a memory of the words and chunks seen.

    Only for tokenizers that lower-case and treat ASCII white space as a mere boundary, and letters before other
    ASCII characters as a token of their own, as the word-end BPE does.  Words of plain letters go straight to
    the model, without its normaliser and word splitter.  The memories are emptied when full, so their
    size is bounded; they never change a result.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        probe = "The Quick ÉCOLE"
        if self.whole.encode(probe, add_special_tokens=False).ids != self.whole.encode(probe.lower(), add_special_tokens=False).ids:
            raise ValueError(f"{path} tells upper case from lower; only tokenizers that lower-case are known here")
        # Plain words are encoded many at a time; the tokens that end a word tell them apart again.
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])
        vocabulary, suffix = self.whole.get_vocab(), getattr(self.whole.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        self.seen: dict[bytes, bytes] = {}
        self.mixed: dict[bytes, bytes] = {}

    def _learn(self, chunks: set[bytes]) -> None:
        seen = self.seen
        plain, mixed, odd = [], [], []
        for c in chunks:
            if c.isalpha() or _LETTERS(c):
                plain.append(c)
            elif (w := c.rstrip(_TRAIL)) and (w.isalpha() or _LETTERS(w)):
                mixed.append((c, w, c[len(w) :]))
            else:
                odd.append(c)
        new = {w for _, w, _ in mixed if w not in seen}.difference(chunks)
        tails = {t for _, _, t in mixed if t not in seen}.difference(odd)
        words, marks = plain + list(new), odd + list(tails)
        for i in range(0, len(words), 1000):
            seen.update(zip(words[i : i + 1000], self._plain(words[i : i + 1000]), strict=True))
        seen.update(zip(marks, self._each(marks), strict=True))
        self.mixed.update((c, seen[w] + seen[t]) for c, w, t in mixed)

    def _each(self, chunks: list[bytes]) -> list[bytes]:
        found = self.whole.encode_batch_fast([c.decode("utf-8") for c in chunks], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _plain(self, words: list[bytes]) -> list[bytes]:
        joined = b"\n".join(words).decode("utf-8").lower()
        ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(words):  # a vocabulary that doesn't mark words' ends
            return self._each(words)
        data = ids.tobytes()
        return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        held = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the memory is large
        try:
            return self._encode(texts)
        finally:
            if held:
                gc.enable()

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        split = [t.lower().split() for t in texts]
        flat = list(chain.from_iterable(split))
        if len(self.seen) > WORDS_HELD:
            self.seen.clear()
        if len(self.mixed) > MIXED_HELD:
            self.mixed.clear()
        ids = list(map(self.seen.get, flat))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            mixed, seen = self.mixed, self.seen
            new = {flat[i] for i in missing}.difference(mixed)
            if new:
                self._learn(new)
            for i in missing:
                c = flat[i]
                ids[i] = mixed[c] if c in mixed else seen[c]
        ends = list(accumulate(map(len, split), initial=0))
        return [b"".join(ids[i:j]) for i, j in zip(ends, ends[1:], strict=False)]


def _tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``docs(doc_id, source, queue, text)`` -> ``(doc_id, source, queue, part, at, n, ids)``: ids (with ``end_id``) as
    16-bit integers where they fit, else 32-bit; ``at`` counts the tokens of the queue before the row in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, told = _tokenizer(tokenizer), TaskContext.get().partitionId(), {}
        small = model.whole.get_vocab_size() < 1 << 16 and end_id < 1 << 16
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            texts, queues = utf8(b, "text"), b.column("queue").to_pylist()
            for i, j in batched(map(len, texts), 1_000_000):
                at, n, packed = [], [], []
                for queue, ids in zip(queues[i:j], model.encode(texts[i:j]), strict=True):
                    ids += end
                    n.append(len(ids) // 4)
                    at.append(told.get(queue, 0))
                    told[queue] = at[-1] + n[-1]
                    packed.append(np.frombuffer(ids, "<u4").astype("<u2").tobytes() if small else ids)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in ("doc_id", "source", "queue")), pa.array([part] * (j - i), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                    ["doc_id", "source", "queue", "part", "at", "n", "ids"],
                )

    return docs.mapInArrow(run, "doc_id long, source string, queue string, part int, at long, n long, ids binary")


class Schedule:
    """The closed form of the round-robin for queues of given lengths (tokens) and shares."""

    def __init__(self, lengths: list[int], shares: list[float], window: int = WINDOW, quantum: int = QUANTUM):
        self.length = np.array(lengths, np.int64)
        total = sum(shares) or 1
        # Never quite nothing: what is not aimed at is served in the end.
        self.credit = np.array([max(1 << 4, round(window * s / total * (1 << _FIX))) for s in shares], np.int64)
        self.window, self.quantum = window, quantum
        self.done = self.round_of(np.arange(len(lengths)), np.maximum(self.length - 1, 0) // quantum)

    def round_of(self, queue: np.ndarray, event: np.ndarray) -> np.ndarray:
        """The round (from 1) in which the queue is served its quantum number ``event`` (from 0)."""
        credit = self.credit[queue]
        return ((event + 1) * (self.quantum << _FIX) + credit - 1) // credit

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens that each queue (column) has been served after so many rounds (row)."""
        r = np.minimum(rounds[:, None], self.done)
        credit = r * (self.credit >> _FIX) + (r * (self.credit & ((1 << _FIX) - 1)) >> _FIX)
        return np.minimum(credit // self.quantum * self.quantum, self.length)

    def place(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pieces of documents that begin at ``start`` of their queue: (document's index, start in it, length, place in the stream)."""
        first, last = start // self.quantum, (start + length - 1) // self.quantum
        k = last - first + 1
        doc = np.repeat(np.arange(len(queue)), k)
        event = np.repeat(first - (np.cumsum(k) - k), k) + np.arange(len(doc))
        q = queue[doc]
        rounds, back = np.unique(self.round_of(q, event), return_inverse=True)
        before, after = self.served(rounds - 1), self.served(rounds)
        lo = np.maximum(start[doc], event * self.quantum)
        hi = np.minimum(start[doc] + length[doc], (event + 1) * self.quantum)
        turn = np.cumsum(after - before, axis=1) - (after - before)
        place = before.sum(1)[back] + turn[back, q] + lo - before[back, q]
        return self.cut(doc, lo - start[doc], hi - lo, place)

    def cut(self, doc: np.ndarray, at: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """Join what is adjacent in the stream, then cut at the windows' ends."""
        joins = np.zeros(len(doc), bool)
        joins[1:] = (doc[1:] == doc[:-1]) & (place[1:] == place[:-1] + n[:-1])
        head = np.flatnonzero(~joins)
        if len(head):
            n = np.add.reduceat(n, head)
        doc, at, place = doc[head], at[head], place[head]
        k = (place + n - 1) // self.window - place // self.window + 1
        i = np.repeat(np.arange(len(doc)), k)
        w = place[i] // self.window + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
        lo, hi = np.maximum(place[i], w * self.window), np.minimum(place[i] + n[i], (w + 1) * self.window)
        return doc[i], at[i] + lo - place[i], hi - lo, lo


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    targets: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_queues: int = MAX_QUEUES,
    max_parts: int = MAX_PARTS,
    digests: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, source, start, length, ids, doc_tokens, sequence_id, offset``; with ``digests``
    a long ``ids_crc32`` in place of ``ids``.

    ``targets`` gives token proportions by source; a source without one (or all, by default) gets its own
    share of what is left.  With over ``max_queues`` sources every targeted source keeps a queue of its own, and the rest
    are dealt by hash to as many queues as remain (one at least), whose windows hold proportions by queue, not by
    source.  The input is read by at most ``max_parts`` tasks; so the queue positions at which partitions begin, which
    every task is sent, are at most ``max(max_queues, targets + 1) * max_parts`` integers.  A null source is a queue of its own.
    A null or empty text is the end token alone.  Repeated rows are packed as often as they occur, extra
    columns are not read, and an empty table gives no pieces.  ``ids`` is the piece as little-endian unsigned
    32-bit integers.  All sequences but the last are full; the last is padded to the window unless its
    length is a power of two.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    many = docs.select("source").distinct().limit(max_queues + 1).count() > max_queues
    queue = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    if many:
        hashed = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(max(1, max_queues - len(targets or {})))).cast("string"))
        queue = F.when(F.col("source").isin(list(targets)), queue).otherwise(hashed) if targets else hashed
    rows = cut(tokenize(docs.coalesce(max_parts).select("doc_id", "source", queue.alias("queue"), "text"), tokenizer, end_id))
    sums = rows.groupBy("queue", "part").agg(F.sum("n").alias("n")).collect()  # at most max_queues * max_parts
    names = sorted({r["queue"] for r in sums})
    index = {x: i for i, x in enumerate(names)}
    bases = np.zeros((max((r["part"] for r in sums), default=0) + 2, len(names)), np.int64)
    for r in sums:
        bases[r["part"] + 1, index[r["queue"]]] = r["n"]
    bases = np.cumsum(bases, axis=0)
    totals = dict(zip(names, bases[-1].tolist(), strict=True))
    wanted = {f"={k}": v for k, v in (targets or {}).items() if f"={k}" in totals}
    rest = 1 - sum(wanted.values())
    if rest < -1e-9 or any(v < 0 for v in wanted.values()):
        raise ValueError("targets must not be negative nor add up to more than 1")
    free = sum(n for x, n in totals.items() if x not in wanted) or 1
    schedule = Schedule(list(totals.values()), [wanted[x] if x in wanted else max(rest, 0) * n / free for x, n in totals.items()], window, quantum)
    told = docs.sparkSession.sparkContext.broadcast((schedule, index, bases))
    name = "ids_crc32" if digests else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule, index, bases = told.value
        for b in batches:
            packed, n, at = b.column("ids").to_pylist(), b.column("n").to_numpy(), b.column("at").to_numpy()
            queue = np.array([index[x] for x in b.column("queue").to_pylist()], np.int64)
            start = at + bases[b.column("part").to_numpy(), queue]
            for i, j in batched(map(len, packed), 4_000_000):
                doc, at_, length, place = schedule.place(queue[i:j], start[i:j], n[i:j])
                wide = [memoryview(np.frombuffer(x, "<u2" if 2 * m == len(x) else "<u4").astype("<u4")).cast("B") for x, m in zip(packed[i:j], n[i:j].tolist(), strict=True)]
                pieces = (wide[d][4 * s : 4 * (s + k)] for d, s, k in zip(doc.tolist(), at_.tolist(), length.tolist(), strict=True))
                own = pa.array(map(zlib.crc32, pieces), pa.int64()) if digests else pa.array(map(bytes, pieces), pa.binary())
                take = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), b.column("source").take(take), pa.array(at_), pa.array(length), own, b.column("n").take(take), pa.array(place // window), pa.array(place % window)],
                    ["doc_id", "source", "start", "length", name, "doc_tokens", "sequence_id", "offset"],
                )

    return rows.mapInArrow(run, f"doc_id long, source string, start long, length long, {name} {'long' if digests else 'binary'}, doc_tokens long, sequence_id long, offset long")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """``(sequence_id, n_tokens, ids)``: the pieces of each sequence joined, padded to ``window`` unless its length is a
    power of two.  A group holds at most ``window`` tokens.  Every piece belongs to one sequence, so nulls, ties and repeats do not
    arise; extra columns are not read, and an empty table gives an empty one."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    joined = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.unhex(F.array_join(F.transform(parts, lambda x: x["ids"]), "")).alias("ids"))
    n = F.col("n_tokens")
    full = F.when(n.bitwiseAND(n - 1) == 0, n).otherwise(F.lit(window))
    pad = F.unhex(F.lit(pad_id.to_bytes(4, "little").hex()))
    return joined.select("sequence_id", "n_tokens", F.concat("ids", F.unhex(F.repeat(F.hex(pad), (full - n).cast("int")))).alias("ids"))

"""Benchmark decontamination: edit-distance search by the CGK embedding, bit sampling and exact verification.

The CGK random walk (Chakraborty, Goldenberg, Koucky, 2016) reads a sequence of words with a pointer that
moves on by a random bit, which depends on the step and the word; the words read are the embedding.  Sequences
at a small edit distance fall into step again, so their embeddings differ in few places.  A repetition draws a
walk and samples a few places of it; windows of an item's size whose samples equal the item's are candidates,
and a semi-global edit distance over the window and its margins decides.  How many repetitions reach the target
recall is found by embedding randomly edited copies of the items.  Items that would need more than ``MAX_REPEATS`` are
searched exactly instead: cut into one piece more than the edits allowed, they keep a piece unedited in any match, and
where one of their pieces occurs the same edit distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batched, utf8

SIMILARITY = 0.8
RECALL = 0.98
SAMPLES = 3
MAX_REPEATS = 96
#: Text of the items that are sent to the tasks at a time.  What is built of it takes some ten times as much.
BLOCK_BYTES = 8 << 20
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of other characters beyond ASCII."""
    return text.translate(_FOLD).split()


def edit_distances(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item (a row) to any stretch of its window (a row), and where that stretch ends."""
    m = windows.shape[1]
    ramp = np.arange(m + 1)
    row = np.zeros((len(items), m + 1), np.int64)
    for i in range(items.shape[1]):
        new = row + 1
        new[:, 1:] = np.minimum(new[:, 1:], row[:, :-1] + (windows != items[:, i : i + 1]))
        row = np.minimum.accumulate(new - ramp, axis=1) + ramp
    end = row.argmin(1)
    return row[np.arange(len(row)), end], end


def _odds(seed: int, rep: int, n: int) -> np.ndarray:
    """A mixed odd number for each step of a repetition."""
    x = np.uint64((seed * 0x9E3779B97F4A7C15 + rep * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF) + np.arange(n, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(2)).view(np.int64) | 1


class Walks:
    """Repetitions for items of one length: the seed that the walk's bits are hashed with, and the sampled places.

    Whether a step moves on is a bit of a hash of repetition, step and word; nothing is kept of it.  Every other repetition walks backwards from the window's end, so that edits at one end spoil half of them only.
    Places are sampled from the first n steps, on which a walk reads about half of the window.
    """

    def __init__(self, n: int, repeats: int, samples: int, rng: np.random.Generator):
        self.n, samples = n, min(samples, n)
        self.seed = int(rng.integers(1 << 62))
        self.places = [sorted(rng.choice(n, samples, replace=False).tolist()) for _ in range(repeats)]
        self.salt = rng.integers(1, 1 << 62, samples, dtype=np.int64) * 2 + 1

    def keys(self, rep: int, words: np.ndarray, starts: np.ndarray, met: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Indices of the windows at ``starts`` and the hashes of their sampled words, after each place.  With ``met``, hashes
        that items have after each place, a window is dropped at the first place where no item has its hash."""
        own, key, out = np.arange(len(starts)), np.zeros(len(starts), np.int64), []
        first, turn = (starts + self.n - 1, -1) if rep % 2 else (starts, 1)
        off, step, odds = np.zeros(len(starts), np.int64), 0, _odds(self.seed, rep, self.n)
        for k, place in enumerate(self.places[rep]):
            while True:
                word = np.where(off < self.n, words[first + turn * np.minimum(off, self.n - 1)], -1)
                if step == place:
                    break
                off += ((word + 2) * odds[step]) >> 43 & 1
                step += 1
            key = key * self.salt[k] + (word + 2) * self.salt[-1 - k]
            key ^= (key >> 29) & 0x7FFFFFFFF
            out.append(key)
            if met is not None:
                near = np.minimum(np.searchsorted(met[k], key), len(met[k]) - 1)
                go = met[k][near] == key
                own, key, off, first = own[go], key[go], off[go], first[go]
        return own, [*out[:-1], key]


class Pieces:
    """The items of one length cut into ``most + 1`` pieces: within ``most`` edits one of them occurs unedited (pigeonhole), at
    most ``most`` words from its place in the item."""

    def __init__(self, items: np.ndarray, most: int):
        self.edges = np.linspace(0, items.shape[1], most + 2).astype(np.int64)
        self.odd = np.random.default_rng(12).integers(1, 1 << 62, int(np.diff(self.edges).max()), dtype=np.int64) * 2 + 1
        self.tables = {}  # by width: hashes, ascending, with their item and place
        for width in np.unique(np.diff(self.edges)).tolist():
            at = self.edges[:-1][np.diff(self.edges) == width]
            own = np.concatenate([self._hashed(items[:, a : a + width].ravel(), width)[::width] for a in at.tolist()])
            item, place = np.tile(np.arange(len(items)), len(at)), np.repeat(at, len(items))
            order = np.argsort(own, kind="stable")
            self.tables[width] = own[order], item[order], place[order]

    def _hashed(self, words: np.ndarray, width: int) -> np.ndarray:
        """Of the ``width`` words from each place on."""
        out = np.zeros(max(len(words) - width + 1, 0), np.int64)
        for k in range(width):
            out += (words[k : k + len(out)] + 2) * self.odd[k]
        return out

    def starts(self, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, item, text): where items would begin, by a piece that occurs in a text; that may be before the text."""
        found = []
        for width, (keys, item, place) in self.tables.items():
            own = self._hashed(words, width)
            own_at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own)
            lo, hi = np.searchsorted(keys, own[own_at]), np.searchsorted(keys, own[own_at], "right")
            m = hi - lo
            k = np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            piece = np.repeat(own_at, m)
            found.append((piece - place[k], item[k], np.searchsorted(ends, piece, "right")))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Benchmark:
    """Items by length, their walks, and the hashed samples to meet."""

    def __init__(self, items: list[tuple[object, bytes]], similarity: float = SIMILARITY, recall: float = RECALL, samples: int = SAMPLES, max_repeats: int = MAX_REPEATS, seed: int = 11):
        self.vocabulary: dict[bytes, int] = {}
        by_length: dict[int, list[tuple[object, list[int]]]] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if ids:
                by_length.setdefault(len(ids), []).append((item_id, ids))
        self.classes = []
        for n, own in sorted(by_length.items()):
            rng = np.random.default_rng((seed, n))
            words = np.array([x for _, x in own], np.int64)  # ids, of which the walks take hashes
            most = int((1 - similarity) * n + 1e-9)
            repeats = self._repeats(words, most, recall, samples, max_repeats + 1, rng)
            if repeats > max_repeats and most < n:
                self.classes.append((n, most, [i for i, _ in own], words, Pieces(words, most), None))
                continue
            walks = Walks(n, min(repeats, max_repeats), samples, rng)
            tables = []
            for rep in range(len(walks.places)):
                _, after = walks.keys(rep, words.ravel(), np.arange(len(own)) * n)
                order = np.argsort(after[-1], kind="stable")
                tables.append((after[-1][order], order.astype(np.int32), [np.unique(x) for x in after]))
            self.classes.append((n, most, [i for i, _ in own], words, walks, tables))
        self.members = [np.unique(own[3]).astype(np.int32) for own in self.classes]
        self.margin = max((c[1] for c in self.classes), default=0)

    @staticmethod
    def _repeats(words: np.ndarray, most: int, recall: float, samples: int, max_repeats: int, rng: np.random.Generator) -> int:
        """Repetitions after which a copy with the most edits allowed is met with probability ``recall``."""
        if not most:
            return 1
        trial, n, pairs = Walks(words.shape[1], 16, samples, rng), words.shape[1], []
        for _ in range(24):
            item = words[rng.integers(len(words))].tolist()
            copy = item.copy()
            for _ in range(most):
                at, kind = int(rng.integers(max(1, len(copy)))), int(rng.integers(3))
                copy[at : at + (kind < 2)] = [int(rng.integers(1 << 30, 1 << 31))] * (kind != 1)
            pairs += [item, (copy + [0] * n)[:n]]
        both, starts = np.array(pairs, np.int64).ravel(), np.arange(len(pairs)) * n
        met = [trial.keys(rep, both, starts)[1][-1].reshape(-1, 2) for rep in range(16)]
        p = max(float(np.mean([x[:, 0] == x[:, 1] for x in met])), 1e-3)
        return int(min(max_repeats, max(4, np.ceil(np.log(1 - recall) / np.log(1 - min(p, 0.999))))))

    def matches(self, texts: list[bytes]) -> list[list[tuple[object, int, int, int]]]:
        """For each text its items, with edit distance, words of the item, and the word at which the passage ends."""
        split = [words_of(t) for t in texts]
        pad = self.margin
        sizes = np.fromiter((len(w) + pad for w in split), np.int64, len(split))
        get, gap = self.vocabulary.get, [b""] * pad
        words = np.fromiter(map(get, chain.from_iterable(chain(w, gap) for w in split), repeat(0)), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        known = np.zeros(len(words) + 1, np.int32)
        member = np.zeros(len(self.vocabulary) + 1, np.uint8)
        found: dict[tuple[int, int, int], tuple[int, int]] = {}
        for c, (n, most, _, items, walks, tables) in enumerate(self.classes):
            if tables is None:
                self._exact(c, words, starts, ends, found)
                continue
            if len(words) < n:
                continue
            # Within the allowed edits a window holds at least that many words of the items of this length.
            member[self.members[c]] = 1
            np.cumsum(member[words], out=known[1:])
            member[self.members[c]] = 0
            at = np.flatnonzero(known[n:] - known[:-n] >= n - most)
            if not len(at):
                continue
            doc = np.searchsorted(ends, at, "right")
            inside = at + n <= ends[doc]
            at, doc = at[inside], doc[inside]
            pairs = []
            for rep, (keys, order, met) in enumerate(tables):
                own, after = walks.keys(rep, words, at, met)
                lo, hi = np.searchsorted(keys, after[-1]), np.searchsorted(keys, after[-1], "right")
                m = hi - lo
                w = np.repeat(own, m)
                pairs.append(w * len(items) + order[np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(len(w))])
            pairs = np.unique(np.concatenate(pairs))
            for i in range(0, len(pairs), 50_000):
                w, item = np.divmod(pairs[i : i + 50_000], len(items))
                lo = at[w] - most
                span = lo[:, None] + np.arange(n + 2 * most)
                inside = (span >= starts[doc[w]][:, None]) & (span < ends[doc[w]][:, None])
                around = np.where(inside, words[np.clip(span, 0, len(words) - 1)], 0)
                distance, end = edit_distances(items[item], around)
                for k in np.flatnonzero(distance <= most).tolist():
                    place = (int(distance[k]), int(lo[k] + end[k] - starts[doc[w[k]]]))
                    key = (int(doc[w[k]]), c, int(item[k]))
                    found[key] = min(found.get(key, place), place)
        return self._placed(found, len(texts))

    def _exact(self, c: int, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, found: dict) -> None:
        """Items of whose pieces one occurs.  Starts that lie in one stretch of ``most`` words share a window."""
        n, most, _, items, pieces, _ = self.classes[c]
        step = max(most, 1)
        at, item, doc = pieces.starts(words, ends)
        cells = np.unique(np.stack([doc, item, (at - starts[doc]) // step], 1), axis=0)
        span = np.arange(-most, n + most + step)
        some = max(1, 2_000_000 // len(span))
        for i in range(0, len(cells), some):
            doc, item, cell = cells[i : i + some].T
            lo = starts[doc] + cell * step - most
            place = (lo + most)[:, None] + span
            inside = (place >= starts[doc][:, None]) & (place < ends[doc][:, None])
            distance, end = edit_distances(items[item], np.where(inside, words[np.clip(place, 0, len(words) - 1)], 0))
            for k in np.flatnonzero(distance <= most).tolist():
                best = (int(distance[k]), int(lo[k] + end[k] - starts[doc[k]]))
                key = (int(doc[k]), c, int(item[k]))
                found[key] = min(found.get(key, best), best)

    def _placed(self, found: dict, texts: int) -> list[list[tuple[object, int, int, int]]]:
        out: list[list[tuple[object, int, int, int]]] = [[] for _ in range(texts)]
        for (d, c, item), (distance, end) in sorted(found.items()):
            n, _, ids, *_ = self.classes[c]
            out[d].append((ids[item], distance, n, end))
        return out


def benchmarks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, **options) -> Iterator[Benchmark]:
    """The items in blocks of about ``block_bytes`` of text, one after another: what is sent to the tasks is bounded."""
    items = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        yield Benchmark(sorted(((r["i"], r["t"].encode()) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])), **options)


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs`` and item found in it: ``doc_id, item_id, edit_distance, item_words, similarity,
    end_word`` (words counted as ``words_of`` does).  An item is found if some stretch of the text is within
    ``(1 - similarity) * its words`` word edits of it.

    Null texts and items without words match nothing; null ids are kept; repeated rows give repeated results; extra
    columns are not read; empty tables give an empty one.  Texts are searched whole.  More than ``block_bytes``
    of items are searched block by block.
    """
    parts = []
    for bench in benchmarks(items, **options):
        told = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, ids = utf8(b, "text"), b.column("doc_id").to_pylist()
                for i, j in batched(map(len, texts), 4_000_000):
                    rows = [(d, item, e, n, 1 - e / n, end) for d, own in zip(ids[i:j], told.value.matches(texts[i:j]), strict=True) for item, e, n, end in own]
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "edit_distance", "item_words", "similarity", "end_word"])

        parts.append(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, item_id long, edit_distance int, item_words int, similarity double, end_word long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item is found.

    Rows with a null, empty or wordless text stay, as do null ids; repeated rows go or stay together; no column is added or looked
    up but the text; an empty table of either kind leaves ``docs`` as it is.  Texts are searched whole.
    """
    for bench in benchmarks(items, **options):
        told = docs.sparkSession.sparkContext.broadcast(bench)

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = utf8(b, text_col)
                for i, j in batched(map(len, texts), 4_000_000):
                    yield b.slice(i, j - i).filter(pa.array([not x for x in told.value.matches(texts[i:j])]))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

"""Documents scored by masked pseudo-likelihood: a network that sees a window on both sides predicts every word.

All documents and all their words count.  A first pass counts every distinct word by its 64-bit hash, in a table that stays
in the cluster.  A second one turns texts into tokens, once, and deals them to training slices by a hash of the
document: which slices there are depends on the number of words alone, so neither the layout of the input nor the number
of tasks changes a score.  In each round every slice trains a copy of the network on its share of the masked words
(the rounds together mask every word once); the copies are averaged, weighted by words, in a tree in the
cluster, so what is gathered grows with the input while the driver holds one model.  Last, each word's
log-probability given its neighbours is summed.

The vocabulary is every distinct word.  The network tells the ``frequent`` most frequent apart, and deals the others to
``rare`` tail tokens by hash; a tail word's probability is its token's, given the neighbours, times its own share in the
token by exact counts.  Each tail token keeps a share for words never seen.  Counts and words meet slice by slice of
the word hash, in the exchange that also deals out the tokens, so no task holds the vocabulary.  The output is factored into
a class and a word in it, which keeps a prediction to some hundred products.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batched, cut, utf8

BUCKETS = 1 << 18
FREQUENT, RARE = 3584, 512
PER_CLASS = 64
SIDE, DIM = 2, 16
_OFFSETS = [o for o in range(-SIDE, SIDE + 1) if o]
_BLOCK = 1 << 14
#: Exponentials of numbers up to this size, and sums of them, are well inside single precision.
_LARGEST = 80.0
#: Words of a training slice, and how many documents' words a slice trains on at a time.
SLICE_WORDS, _CHUNK_WORDS = 2_000_000, 1 << 17
#: Slices of the word hash in which counts and words meet: so many at least, and about so many distinct words in each; those
#: that more words reach are read by several tasks.
_SLICES, _SLICE_DISTINCT, _SLICE_READ = 16, 1 << 20, 8_000_000
_FAN, _MOST_TASKS = 64, 100_000


def _split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """All words, and the number of words of each text."""
    split = [t.lower().split() for t in texts]
    return list(chain.from_iterable(split)), np.fromiter(map(len, split), np.int64, len(split))


def _keys(words: list[bytes]) -> np.ndarray:
    """What tells words apart."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def _framed(ids: np.ndarray, n: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of several texts with ``SIDE`` pads before, between and after; and where the words are."""
    at = np.arange(len(ids)) + SIDE * (np.repeat(np.arange(len(n)), n) + 1)
    out = np.full(len(ids) + SIDE * (len(n) + 1), pad, np.int64)
    out[at] = ids
    return out, at


class Vocabulary:
    """What a network knows of the words: the frequent ones in a hash table, how often each token occurs in the corpus; of
    each tail token the logarithms of what its words' counts are divided by, and of the share of one unseen word."""

    def __init__(self, frequent: list[tuple[int, int]], rare: np.ndarray, most: int, buckets: int = BUCKETS):
        """``frequent``: (key, count), the most frequent first.  ``rare``: places, distinct words and words that occur once, of
        the words of each tail token, the frequent ones among them included."""
        self.most, self.tail_tokens, rare = most, len(rare), rare.astype(np.float64)
        self.size = most + self.tail_tokens
        # An empty bucket holds a key that belongs elsewhere.
        self.owner = ((np.arange(buckets, dtype=np.int64) + 1) % buckets) << 20
        self.id_of, counts, known = np.zeros(buckets, np.int32), np.zeros(self.size), 0
        taken = set()
        for key, n in frequent:
            bucket = (key >> 20) & (buckets - 1)
            if known < most and bucket not in taken:  # of two frequent words in a bucket the lesser is a tail word
                taken.add(bucket)
                self.owner[bucket], self.id_of[bucket], counts[known] = key, known, n
                rare[key % self.tail_tokens] -= n, 1, n == 1
                known += 1
        counts[most:] = rare[:, 0]
        self.counts = counts
        total = np.log(rare[:, 0] + rare[:, 2] + 1)
        #: A tail token of n places, d words and s words that occur once gives a word of count c the share c / (n + s + 1), and the
        #: rest in equal parts to 2 (d + 1) unseen words, so an unseen word is never likelier than half a word seen once.
        self.total, self.unseen = total, np.log(rare[:, 2] + 1) - total - np.log(2 * (rare[:, 1] + 1))

    def ids(self, keys: np.ndarray) -> np.ndarray:
        """Tokens of words.  One that merely shares the bucket of a frequent word is a tail word."""
        bucket = (keys >> 20) & (len(self.owner) - 1)
        return np.where(self.owner[bucket] == keys, self.id_of[bucket], self.most + keys % self.tail_tokens).astype(np.int32)


class Network:
    """h = tanh(sum of a vector for each neighbour's word and side); class and word-in-class by softmax of h."""

    def __init__(self, vocabulary: Vocabulary, words: DataFrame | None = None, seed: int = 1, dim: int = DIM):
        rng = np.random.default_rng(seed)
        self.vocabulary, self.words = vocabulary, words
        self.pad = size = vocabulary.size
        classes = size // PER_CLASS
        if size % PER_CLASS:
            raise ValueError(f"frequent and rare tokens must add up to a multiple of {PER_CLASS}")
        self.side = [(rng.standard_normal((size + 1, dim)) * 0.1).astype(np.float32) for _ in _OFFSETS]
        self.base = np.zeros(dim, np.float32)
        self.to_class = (rng.standard_normal((dim, classes)) * 0.1).astype(np.float32)
        self.to_word = (rng.standard_normal((classes, dim, PER_CLASS)) * 0.1).astype(np.float32)
        counts = vocabulary.counts
        share = ((counts + 1) / (counts + 1).sum()).reshape(classes, PER_CLASS)
        self.class_bias = np.log(share.sum(1)).astype(np.float32)
        self.word_bias = np.log(share / share.sum(1, keepdims=True)).astype(np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "words"}  # a table is not sent to tasks

    def copy(self) -> Network:
        own = Network.__new__(Network)
        own.__dict__ = {k: [x.copy() for x in v] if isinstance(v, list) else v.copy() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return own

    def parts(self) -> list[np.ndarray]:
        return [*self.side, self.base, self.to_class, self.to_word, self.class_bias, self.word_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for p in self.parts():
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size

    def hidden(self, framed: np.ndarray, at: np.ndarray, ones: int = 0) -> np.ndarray:
        """``ones``: so many columns of 1 follow, which meet biases."""
        h = np.tile(self.base, (len(at), 1))
        for table, o in zip(self.side, _OFFSETS, strict=True):
            h += table.take(framed[at + o], axis=0)
        np.tanh(h, out=h)
        return np.concatenate([h, np.ones((len(at), ones), h.dtype)], 1) if ones else h

    def _joined(self) -> tuple[np.ndarray, np.ndarray, bool]:
        """Weights with their biases as a last row, of classes and of words; and whether single precision holds the exponentials of
        all logits as they are: h is between -1 and 1."""
        to_class, to_word = np.concatenate([self.to_class, self.class_bias[None]]), np.concatenate([self.to_word, self.word_bias[:, None]], 1)
        return to_class, to_word, bool(max(np.abs(to_class).sum(0).max(), np.abs(to_word).sum(1).max()) < _LARGEST)

    @staticmethod
    def _softmax(logits: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials, in place of the logits, and their sums."""
        if not bounded:
            logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(logits.shape[1], logits.dtype)

    def _by_class(self, cls: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the rows by class, and (class, begin, end) of those that occur, ``most`` rows at a time."""
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        ends = np.cumsum(np.bincount(cls, minlength=len(self.class_bias))).tolist()
        return order, [(c, k, min(k + most, hi)) for c, (lo, hi) in enumerate(zip([0, *ends], ends, strict=False)) for k in range(lo, hi, most)]

    def log_probabilities(self, framed: np.ndarray, at: np.ndarray, step: int = 1 << 15, rows: int = 1 << 11) -> np.ndarray:
        """Of the words at these places, given their neighbours; logits of ``rows`` words at a time, which stay in the cache."""
        out = np.empty(len(at))
        to_class, to_word, bounded = self._joined()
        place = np.arange(rows)

        def chosen(h: np.ndarray, weights: np.ndarray, y: np.ndarray) -> np.ndarray:
            logits = h @ weights
            if not bounded:
                logits -= logits.max(1, keepdims=True)
            z = logits[place[: len(y)], y]
            return z - np.log(self._softmax(logits, True)[1])

        for i in range(0, len(at), step):
            own = at[i : i + step]
            cls, word = np.divmod(framed[own], PER_CLASS)
            order, spans = self._by_class(cls, rows)
            h, cls, word = self.hidden(framed, own[order], 1), cls[order], word[order]
            got = np.concatenate([chosen(h[k : k + rows], to_class, cls[k : k + rows]) for k in range(0, len(own), rows)])
            for c, lo, hi in spans:
                got[lo:hi] += chosen(h[lo:hi], to_word[c], word[lo:hi])
            out[i + order] = got
        return out

    def train(self, framed: np.ndarray, at: np.ndarray, memory: list[np.ndarray], rate: float = 0.1, batch: int = 4096) -> None:
        """One pass over these places; ``memory`` holds the squared gradients of Adagrad."""
        dim = len(self.base)
        for i in range(0, len(at), batch):
            own = at[i : i + batch]
            n, y = len(own), framed[own]
            cls, word = np.divmod(y, PER_CLASS)
            order, spans = self._by_class(cls, n)
            own, cls, word = own[order], cls[order], word[order]
            h, rows = self.hidden(framed, own, 1), np.arange(n)
            to_class, to_word, bounded = self._joined()
            p, total = self._softmax(h @ to_class, bounded)
            p *= (1 / total)[:, None]
            p[rows, cls] -= 1
            by_class, by_word = h.T @ p, np.zeros_like(to_word)
            dh = p @ self.to_class.T
            back = np.empty_like(dh)
            for c, lo, hi in spans:
                own_h = h[lo:hi]
                q, total = self._softmax(own_h @ to_word[c], bounded)
                q *= (1 / total)[:, None]
                q[rows[: hi - lo], word[lo:hi]] -= 1
                np.matmul(own_h.T, q, out=by_word[c])
                np.matmul(q, self.to_word[c].T, out=back[lo:hi])
            dh += back
            h = h[:, :dim]
            dh *= 1 - h * h
            k = len(self.side)
            for j, (table, o) in enumerate(zip(self.side, _OFFSETS, strict=True)):
                near = framed[own + o].astype(np.uint16 if self.pad < 1 << 16 else np.int64)
                order = np.argsort(near, kind="stable")
                near = near[order]
                first = np.flatnonzero(np.r_[True, near[1:] != near[:-1]])
                seen, g = near[first], np.add.reduceat(dh[order], first)
                m = memory[j][seen]
                m += g * g
                memory[j][seen] = m
                m += 1e-6
                g *= rate
                g /= np.sqrt(m, out=m)
                table[seen] -= g
            for part, g, m in zip(self.parts()[k:], [dh.sum(0), by_class[:dim], by_word[:, :dim], by_class[dim], by_word[:, dim]], memory[k:], strict=True):
                m += g * g
                part -= rate * g / np.sqrt(m + 1e-6)


def vocabulary(docs: DataFrame, frequent: int = FREQUENT, rare: int = RARE) -> tuple[Vocabulary, DataFrame]:
    """The words of ``docs(text)``, and the table ``(word, n)`` of all distinct ones, which stays in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b, "text")
            for i, j in batched(map(len, texts), 4_000_000):
                count = Counter(chain.from_iterable(t.lower().split() for t in texts[i:j]))
                if count:
                    yield pa.RecordBatch.from_arrays([pa.array(_keys(list(count))), pa.array(count.values(), pa.int64())], ["word", "n"])

    words = cut(docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    sums = np.zeros((rare, 3))
    for r in words.groupBy(F.pmod("word", F.lit(rare)).alias("t")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d"), F.count_if(F.col("n") == 1).alias("s")).collect():
        sums[r["t"]] = r["n"], r["d"], r["s"]
    top = [(r["word"], r["n"]) for r in words.orderBy(F.desc("n"), "word").limit(2 * frequent).collect()]
    return Vocabulary(top, sums, frequent, max(BUCKETS, 1 << (128 * frequent).bit_length())), words


_KINDS = "kind int, place long, number long, at int, h long, doc_id long, n int, x binary, y binary"
_NAMES = [x.split()[0] for x in _KINDS.split(", ")]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
#: Rows of the exchange: distinct words' gains, a batch's tail words, a document's tokens; and what comes of the tail words.
_GAINS, _TAIL, _TOKENS, _GAINED = range(4)
_TRAINING = 1 << 40  # places from here on are training slices


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), _TYPES, strict=True)], _NAMES)


def _grouped(own: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Where each value below ``size`` stands."""
    order = np.argsort(own.astype(np.uint16) if size <= 1 << 16 else own, kind="stable")
    ends = np.cumsum(np.bincount(own, minlength=size)).tolist()
    return ((k, order[i:j]) for k, (i, j) in enumerate(zip([0, *ends], ends, strict=False)) if i < j)


def tokens(rows: DataFrame, known: Vocabulary, words: DataFrame, slice_words: int = SLICE_WORDS) -> tuple[DataFrame, int]:
    """``rows(doc_id, text)`` as a stored table of documents' tokens, dealt to training slices and in the order of a hash there, and
    of what their tail words' logarithms are above unseen ones'; and the number of training slices."""
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    training = max(1, -(-total // slice_words))
    slices = _SLICES
    while slices * _SLICE_DISTINCT < distinct:
        slices *= 2
    readers = max(1, -(-total // (slices * _SLICE_READ)))
    told = rows.sparkSession.sparkContext.broadcast(known)

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every reader of a slice gets what a seen word's logarithm is above an unseen one's."""
        known = told.value
        base = known.total + known.unseen
        for b in batches:
            keys, n = (b.column(c).to_numpy() for c in ("word", "n"))
            gain = np.log(n) - base[keys % known.tail_tokens]
            found = [(_GAINS, k * readers + r, 0, 0, 0, 0, 0, keys[at].tobytes(), gain[at].tobytes()) for k, at in _grouped((keys >> 40) & (slices - 1), slices) for r in range(readers)]
            if found:
                yield _rows(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = told.value, TaskContext.get().partitionId() << 32
        small = known.size < 1 << 16
        for b in batches:
            texts, ids = utf8(b, "text"), b.column("doc_id").to_pylist()
            for i, j in batched(map(len, texts), 2_000_000):
                words, n = _split(texts[i:j])
                keys = _keys(words)
                own = known.ids(keys)
                tail = own >= known.most
                doc, keys = np.repeat(np.arange(len(n), dtype=np.int32), n)[tail], keys[tail]
                found = []
                for k, at in _grouped((keys >> 40) & (slices - 1), slices):
                    held = doc[at]
                    first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
                    runs = np.stack([held[first], np.diff(np.r_[first, len(held)])]).astype(np.int32)
                    found.append((_TAIL, k * readers + number % readers, number, 0, 0, 0, 0, keys[at].tobytes(), runs.tobytes()))
                own, ends = own.astype(np.uint16) if small else own, np.cumsum(n)
                for at, (doc_id, text, m, end) in enumerate(zip(ids[i:j], texts[i:j], n.tolist(), ends.tolist(), strict=True)):
                    h = xxhash.xxh3_64_intdigest(text, (doc_id or 0) & 0xFFFFFFFFFFFFFFFF)
                    found.append((_TOKENS, _TRAINING + (h >> 8) % training, number, at, h - (1 << 63), doc_id, m, own[end - m : end].tobytes(), b""))
                number += 1
                yield _rows(found)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tail words with the gains of their slice, summed by document; documents pass."""
        now, held, keys, gain = None, [], None, None
        for b in batches:
            kinds = b.column("kind").to_numpy()
            passing = kinds == _TOKENS
            if passing.any():
                yield b.filter(pa.array(passing))
            found = []
            others = b.filter(pa.array(~passing))
            for kind, place, number, x, y in zip(*(others.column(c).to_pylist() for c in ("kind", "place", "number", "x", "y")), strict=True):
                if place != now:
                    now, held, keys = place, [], None
                if kind == _GAINS:
                    held.append((np.frombuffer(x, np.int64), np.frombuffer(y)))
                    continue
                if keys is None:
                    keys, gain = (np.concatenate(c) for c in zip((np.zeros(0, np.int64), np.zeros(0)), *held, strict=True))
                    order = np.argsort(keys)
                    keys, gain, held = keys[order], gain[order], []
                own, (doc, m) = np.frombuffer(x, np.int64), np.frombuffer(y, np.int32).reshape(2, -1)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                got = np.where(keys[at] == own, gain[at], 0.0) if len(keys) else np.zeros(len(own))
                found.append((_GAINED, place, number, 0, 0, 0, 0, doc.tobytes(), np.add.reduceat(got, np.cumsum(m) - m).tobytes()))
            if found:
                yield _rows(found)

    both = words.mapInArrow(gains, _KINDS).union(rows.mapInArrow(run, _KINDS))
    spread = min(_MOST_TASKS, max(slices * readers + training, rows.sparkSession.sparkContext.defaultParallelism))
    return cut(both.repartition(spread, "place").sortWithinPartitions("place", "kind", "h", "doc_id").mapInArrow(meet, _KINDS)), training


def _chunks(batches: Iterator[pa.RecordBatch], most: int, wide: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple], bool]]:
    """Tokens of consecutive documents of one slice, ``most`` of them or a little more: (place, ids, words of each, the documents'
    ``(number, at, doc_id)``, hashes).  Where a chunk ends depends on the slice's documents alone."""
    now, held, size = None, [], 0

    def out():
        ids = np.frombuffer(b"".join(r[5] for r in held), np.int32 if wide else np.uint16).astype(np.int64)
        return now, ids, np.array([r[4] for r in held], np.int64), [r[:3] for r in held], np.array([r[3] for r in held], np.int64)

    for b in batches:
        for place, number, at, doc_id, h, n, x in zip(*(b.column(c).to_pylist() for c in ("place", "number", "at", "doc_id", "h", "n", "x")), strict=True):
            if held and (place != now or size >= most):
                yield out()
                held, size = [], 0
            now = place
            held.append((number, at, doc_id, h, n, x))
            size += n
    if held:
        yield out()


def _masked(h: np.ndarray, n: np.ndarray, every: int, turn: int) -> np.ndarray:
    """Which words are masked in a turn: one place in ``every`` of each text, another in each turn.  Where it begins depends
    on the document's hash, so that short ones are met as often as long ones."""
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return (place + np.repeat(h & 0xFFFF, n) + turn) % every == 0


def _averaged(rows: DataFrame, parts: int) -> dict[int, np.ndarray]:
    """``rows(block, part, weight, means)`` of the parts 0 to ``parts - 1``, averaged for each block in a tree whose nodes join ``_FAN``
    neighbours; in order of part, so that the result doesn't depend on which arrives first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, weight = None, None, 0.0

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([weight]), pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())], ["block", "part", "weight", "means"])

        for b in batches:
            for block, parent, w, means in zip(*(b.column(c).to_pylist() for c in ("block", "parent", "weight", "means")), strict=True):
                values = np.frombuffer(means, np.float32).astype(np.float64) * w
                if (block, parent) != now:
                    if now is not None:
                        yield out()
                    now, total, weight = (block, parent), values, w
                else:
                    total, weight = total + values, weight + w
        if now is not None:
            yield out()

    while True:
        up = rows.withColumn("parent", F.floor(F.col("part") / _FAN).cast("long"))
        rows = up.repartition("block", "parent").sortWithinPartitions("block", "parent", "part").mapInArrow(run, _MEANS)
        parts = -(-parts // _FAN)
        if parts <= 1:
            return {r["block"]: np.frombuffer(r["means"], np.float32) for r in rows.collect()}  # one model's size


_MEANS = "block int, part long, weight double, means binary"


def _blocks(values: np.ndarray, weight: int, part: int) -> pa.RecordBatch:
    packed = [values[i : i + _BLOCK].tobytes() for i in range(0, len(values), _BLOCK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(packed)), pa.int32()), pa.array([part] * len(packed), pa.int64()), pa.array([float(weight)] * len(packed)), pa.array(packed, pa.binary())], ["block", "part", "weight", "means"])


def _fit(net: Network, stored: DataFrame, training: int, rounds: int, mask_every: int) -> None:
    """Train ``net`` on the stored tokens."""
    sc, wide = stored.sparkSession.sparkContext, net.vocabulary.size >= 1 << 16
    for turn in range(rounds):
        told = sc.broadcast(net)

        def run(batches: Iterator[pa.RecordBatch], told=told, turn=turn) -> Iterator[pa.RecordBatch]:
            now, own, memory, seen = None, None, None, 0
            for place, ids, n, _, h in _chunks(batches, _CHUNK_WORDS, wide):
                if place != now:
                    if seen:
                        yield _blocks(own.flat(), seen, now - _TRAINING)
                    now, own, seen = place, told.value.copy(), 0
                    memory = [np.zeros_like(p) for p in own.parts()]
                framed, at = _framed(ids, n, own.pad)
                masked = at[_masked(h, n, mask_every, turn * (mask_every // max(rounds, 1)))]
                own.train(framed, masked, memory)
                seen += len(masked)
            if seen:
                yield _blocks(own.flat(), seen, now - _TRAINING)

        means = _averaged(stored.where(F.col("kind") == _TOKENS).mapInArrow(run, _MEANS), training)
        if means:
            net.load(np.concatenate([means[k] for k in sorted(means)]))


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = F.col(id_col).cast("long") if id_col in docs.columns else F.lit(None).cast("long")
    return docs.select(own.alias("doc_id"), F.col(text_col).alias("text"))


def train(docs: DataFrame, rounds: int = 2, mask_every: int | None = None, frequent: int = FREQUENT, rare: int = RARE, slice_words: int = SLICE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Fit the network, on all documents in every round.  ``mask_every`` is the number of rounds by default, so that
    the rounds together train on every word once; a larger one leaves words out.  ``frequent`` words have a token of their own.

    Null and empty texts have no words; null ids count as 0; repeated rows train as often as they occur; extra columns are
    not read; an empty table leaves the network as it began.
    """
    return _trained(_numbered(docs, id_col, text_col), rounds, mask_every, frequent, rare, slice_words)[0]


def _trained(rows: DataFrame, rounds: int, mask_every: int | None, frequent: int, rare: int, slice_words: int) -> tuple[Network, DataFrame]:
    known, words = vocabulary(rows.select("text"), frequent, rare)
    net = Network(known, words)
    stored, training = tokens(rows, known, words, slice_words)
    _fit(net, stored, training, rounds, mask_every or max(rounds, 1))
    return net, stored


def score(docs: DataFrame, net: Network | None = None, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2, frequent: int = FREQUENT, rare: int = RARE, slice_words: int = SLICE_WORDS) -> DataFrame:
    """``(doc_id, n_words, log_likelihood, per_word)``: the summed conditional log-probabilities of a text's words, and
    their mean (null without words).  Without a ``net`` one is trained on ``docs``, from the same tokens.

    Null and empty texts have no words and a sum of 0; null ids and repeated rows are scored like any row; extra
    columns are not read; an empty table gives an empty one.  A single text of any length is read whole.  Scores do not depend
    on how the rows are laid out in partitions or files.
    """
    rows = _numbered(docs, id_col, text_col)
    if net is None:
        net, stored = _trained(rows, rounds, None, frequent, rare, slice_words)
    else:
        stored, _ = tokens(rows, net.vocabulary, net.words, slice_words)
    told, wide = docs.sparkSession.sparkContext.broadcast(net), net.vocabulary.size >= 1 << 16

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = told.value
        for _, ids, n, rows, _ in _chunks(batches, 1 << 16, wide):
            framed, at = _framed(ids, n, net.pad)
            each, tail = net.log_probabilities(framed, at), ids >= net.vocabulary.most
            each[tail] += net.vocabulary.unseen[ids[tail] - net.vocabulary.most]
            own = np.bincount(np.repeat(np.arange(len(n)), n), each, len(n))
            number, place, doc_id = zip(*rows, strict=True)
            some = len(rows)
            yield pa.RecordBatch.from_arrays([pa.array([_TOKENS] * some, pa.int32()), pa.array(number, pa.int64()), pa.array(place, pa.int32()), pa.array(doc_id, pa.int64()), pa.array(n), pa.array(own), pa.nulls(some, pa.binary()), pa.nulls(some, pa.binary())], ["kind", "number", "at", "doc_id", "n_words", "sum", "x", "y"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch's documents come first, then the gains of their tail words."""
        now, held, own = None, [], None

        def out():
            ids, n = (pa.concat_arrays([b.column(c) for b in held]) for c in ("doc_id", "n_words"))
            mean = pa.array(own / np.maximum(n.to_numpy(), 1), mask=n.to_numpy() == 0)
            return pa.RecordBatch.from_arrays([ids, n, pa.array(own), mean], ["doc_id", "n_words", "log_likelihood", "per_word"])

        for b in batches:
            number, kind = b.column("number").to_numpy(), b.column("kind").to_numpy()
            edges = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])]).tolist() if len(number) else []
            for i, j in zip(edges, [*edges[1:], len(number)], strict=True):
                if number[i] != now:
                    if held:
                        yield out()
                    now, held, own = number[i], [], np.zeros(0)
                if kind[i] == _TOKENS:
                    held.append(b.slice(i, j - i))
                    own = np.concatenate([own, held[-1].column("sum").to_numpy()])
                else:
                    for x, y in zip(*(b.column(c).slice(i, j - i).to_pylist() for c in ("x", "y")), strict=True):
                        own[np.frombuffer(x, np.int32)] += np.frombuffer(y)
        if held:
            yield out()

    found = stored.where(F.col("kind") == _TOKENS).mapInArrow(sums, "kind int, number long, at int, doc_id long, n_words long, sum double, x binary, y binary")
    gained = stored.where(F.col("kind") == _GAINED).select("kind", "number", F.lit(0).alias("at"), F.col("place").alias("doc_id"), F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("sum"), "x", "y")
    met = found.union(gained).repartition("number").sortWithinPartitions("number", "kind", "at", "doc_id")
    return met.mapInArrow(total, "doc_id long, n_words long, log_likelihood double, per_word double")

"""Quality rules: statistics of each text, hard limits, and an isolation forest over the statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import batched, cut, utf8

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Trees of the forest; every labelled row grows one of them, and more where a tree would have fewer rows than ``LEAST_ROWS``.
TREES, LEAST_ROWS = 300, 64
#: Share of the labelled good rows that the threshold may cost.
MAX_GOOD_LOST = 0.004

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_stops", "n_marks", "n_distinct"]
_UPPER, _DIGITS, _MARKS = (bytes(range(65, 91)), b"0123456789", b".,;:!?")
_MIX = np.random.default_rng(20).integers(1, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more among ``words``."""
    n = len(words)
    if n <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.uint64, n) + np.uint64(1)
    ids ^= ids << np.uint64(31)
    m = n - width + 1
    h = np.zeros(m, np.uint64)
    for i in range(width):
        h = (h ^ (h >> np.uint64(29))) * _MIX[i] + ids[i : i + m] * _MIX[width - 1 - i]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(m + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    turn = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice[:m])
    turn[at] += 1
    np.add.at(turn, at + width, -1)
    return int((np.cumsum(turn[:n]) > 0).sum())


def statistics(text: bytes) -> list[int]:
    """The values of ``STATS`` for one UTF-8 text."""
    words = text.split()
    if not words:
        return [0] * len(STATS)
    joined = b"".join(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    size = len(joined)
    return [
        len(words),
        len(joined.decode("utf-8")),
        size - len(joined.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        size - len(joined.translate(None, _UPPER)),
        size - len(joined.translate(None, _DIGITS)),
        sum(len(w) <= 3 for w in words),
        size - len(joined.translate(None, _MARKS)),
        len(set(words)),
    ]


def features(stats: np.ndarray) -> np.ndarray:
    """What the forest splits on: rates, drawn towards usual ones in short texts, so that few words are no anomaly."""
    x = stats.astype(np.float64)
    n, chars = x[:, 0], x[:, 1]
    return np.column_stack(
        [
            (chars + 5 * 20) / (n + 20),
            np.log1p(100 * x[:, 2] / (n + 20)),
            x[:, 3] / (x[:, 5] + 3),
            x[:, 4] / (n + 20),
            (x[:, 6] + 2) / (chars + 100),
            np.sqrt(x[:, 7] / (chars + 100)),
            (x[:, 8] + 7) / (n + 20),
            np.log((x[:, 9] + 3) / (n + 20)),
        ]
    )


class IsolationForest:
    """Trees of random splits, kept as arrays; a row that few splits part from the rest is an anomaly (Liu et al., 2008).
    Small samples for each tree keep groups of like anomalies from hiding one another."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = LEAST_ROWS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(sample, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], rng) for _ in range(trees)] if len(rows) else []

    @classmethod
    def of(cls, trees: list[tuple[np.ndarray, ...]], size: float) -> IsolationForest:
        """A forest of grown trees, with ``size`` rows in each of them on average."""
        own = cls.__new__(cls)
        own.trees, own.size = trees, size
        return own

    @classmethod
    def dealt(cls, keys: np.ndarray, rows: np.ndarray, trees: int = TREES, least: int = LEAST_ROWS) -> IsolationForest:
        """A forest that every row has a part in, dealt to its trees by ``deal``; of rows of distinct keys."""
        times = how_often(len(keys), trees, least)
        order = np.argsort(keys)
        at, tree = deal(keys[order], trees, times)
        return cls.of([cls.grown(k, rows[order[at[tree == k]]], least) for k in np.unique(tree).tolist()], len(keys) * times / trees)

    @classmethod
    def grown(cls, tree: int, rows: np.ndarray, least: int = LEAST_ROWS, seed: int = 7) -> tuple[np.ndarray, ...]:
        """The tree of that number, of all these rows; no deeper than one of ``least`` rows, so its size is bounded.  What is left
        together counts with all its rows."""
        return cls._grow(rows, np.random.default_rng([seed, tree]), min(least, len(rows)))

    @staticmethod
    def _usual(n: float) -> float:
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    @classmethod
    def _grow(cls, rows: np.ndarray, rng: np.random.Generator, as_many: int | None = None) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(len(rows) if as_many is None else as_many, 2))))
        feature, cut, left, depth, todo = [], [], [], [], [(rows, 0, 0)]
        feature.append(-1), cut.append(0.0), left.append(0), depth.append(0.0)
        while todo:
            own, level, at = todo.pop()
            low, high = own.min(0), own.max(0)
            can = np.flatnonzero(high > low)
            if level >= limit or len(own) < 2 or not len(can):
                depth[at] = level + cls._usual(len(own))
                continue
            f = int(rng.choice(can))
            feature[at], cut[at], left[at] = f, float(rng.uniform(low[f], high[f])), len(feature)
            for _ in range(2):
                feature.append(-1), cut.append(0.0), left.append(0), depth.append(0.0)
            below = own[:, f] <= cut[at]
            todo += [(own[below], level + 1, left[at]), (own[~below], level + 1, left[at] + 1)]
        return np.array(feature), np.array(cut), np.array(left), np.array(depth)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1, the higher the more of an anomaly."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total, all_rows = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, left, depth in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                i = all_rows[inner]
                a = at[i]
                at[i] = left[a] + (rows[i, feature[a]] > cut[a])
            total += depth[at]
        return 2.0 ** (-total / len(self.trees) / max(self._usual(self.size), 1e-9))


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < MIN_WORDS) | (100 * stats[:, 4] > MAX_REPEAT_PERCENT * stats[:, 0])


def how_often(n: int, trees: int = TREES, least: int = LEAST_ROWS) -> int:
    """Trees that each of ``n`` rows is dealt to: one, or as many as give every tree about ``least`` rows."""
    return min(trees, max(1, -(-trees * least // max(n, 1))))


def deal(keys: np.ndarray, trees: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row, by its place among ``keys``, with ``times`` different trees, which a hash of its key chooses."""
    h = keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    h ^= h >> np.uint64(31)
    steps = np.array([x for x in range(1, trees + 1) if np.gcd(x, trees) == 1])
    first, step = (h >> np.uint64(32)).astype(np.int64) % trees, steps[(h & np.uint64(0xFFFFFFFF)).astype(np.int64) % len(steps)]
    return np.repeat(np.arange(len(keys)), times), ((first[:, None] + step[:, None] * np.arange(times)) % trees).ravel()


def _allowed(n: int, max_good_lost: float) -> int:
    """How many of ``n`` good rows may be lost; fewer than there are."""
    return min(int(max_good_lost * n), n - 1)


class Judge:
    """A fitted forest with its threshold."""

    def __init__(self, stats: np.ndarray, good: np.ndarray, max_good_lost: float = MAX_GOOD_LOST, trees: int = TREES, least: int = LEAST_ROWS, keys: np.ndarray | None = None):
        """The forest is fitted on all labelled rows; the threshold is the lowest score that at most
        ``max_good_lost`` of the labelled good rows exceed, of those that pass the hard limits.  Without
        labelled good rows nothing is rejected beyond the limits.  ``keys`` tell the rows apart, their places by default."""
        rows = features(stats)
        self.forest = IsolationForest.dealt(np.arange(len(rows)) if keys is None else keys, rows, trees, least)
        scores = np.sort(self.forest.score(rows[good & ~base_failed(stats)]))[::-1]
        self.threshold = float(scores[_allowed(len(scores), max_good_lost)]) if len(scores) else float("inf")

    @classmethod
    def of(cls, forest: IsolationForest, threshold: float) -> Judge:
        own = cls.__new__(cls)
        own.forest, own.threshold = forest, threshold
        return own

    def verdict(self, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and whether to keep, of rows of statistics."""
        scores = self.forest.score(features(stats))
        return scores, ~base_failed(stats) & (scores <= self.threshold)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Statistics, scores and whether to keep, of each text."""
        stats = np.array([statistics(t) for t in texts], np.int64).reshape(len(texts), len(STATS))
        return stats, *self.verdict(stats)


_MEASURED = "doc_id long, " + ", ".join(f"{x} long" for x in STATS)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(x).to_numpy() for x in STATS])


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the statistics of every row.  A null or empty text has no words; extra columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b, "text")
            for i, j in batched(map(len, texts), 16_000_000):
                stats = np.array([statistics(t) for t in texts[i:j]], np.int64).reshape(j - i, len(STATS))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), *(pa.array(x) for x in stats.T.copy())], ["doc_id", *STATS])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _MEASURED)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_good_lost: float = MAX_GOOD_LOST) -> Judge:
    """Fit on all labelled documents.

    A document labelled twice counts once, as bad if any label says so; rows that repeat an id count once.  Labels with a null in
    either column and documents with a null id are left out; a null or empty text has no words; extra columns are not read;
    with an empty table of either kind nothing is rejected beyond the hard limits.
    """
    return fit_measured(measure(docs, id_col, text_col), labels, max_good_lost)


def fit_measured(measured: DataFrame, labels: DataFrame, max_good_lost: float = MAX_GOOD_LOST, trees: int = TREES, least: int = LEAST_ROWS) -> Judge:
    """``fit`` on what ``measure`` returns.

    Only ids, labels and statistics are joined.  Each labelled row goes to the task that grows its tree, and the driver
    holds the trees, whose size is bounded; the threshold is found among all scores, by counts of their bits.
    The result equals ``Judge`` on all these rows, and doesn't depend on how they are laid out.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    once = measured.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*STATS)).alias("stats"))
    rows = cut(known.join(once.hint("merge"), "doc_id").select("doc_id", "quality", "stats.*"))
    n = rows.count()
    times = how_often(n, trees, least)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, tree = deal(b.column("doc_id").to_numpy(), trees, times)
            own = b.select(["doc_id", *STATS]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(tree, pa.int32()), *own.columns], ["tree", "doc_id", *STATS])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            grown = IsolationForest.grown(now, features(np.concatenate(held)), least)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *(pa.array([x.tolist()], pa.list_(t)) for x, t in zip(grown, (pa.int32(), pa.float64(), pa.int32(), pa.float64()), strict=True))], ["tree", "feature", "cut", "left", "depth"])

        for b in batches:
            tree, stats = b.column("tree").to_numpy(), _matrix(b)
            edges = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]).tolist() if len(tree) else []
            for i, j in zip(edges, [*edges[1:], len(tree)], strict=True):
                if held and tree[i] != now:
                    yield out()
                    held = []
                now = int(tree[i])
                held.append(stats[i:j])
        if held:
            yield out()

    met = rows.mapInArrow(dealt, f"tree int, {_MEASURED}").repartition("tree").sortWithinPartitions("tree", "doc_id")
    grown = sorted(met.mapInArrow(grow, "tree int, feature array<int>, cut array<double>, left array<int>, depth array<double>").collect())
    forest = IsolationForest.of([tuple(np.array(x) for x in r[1:]) for r in grown], n * times / trees)
    told = measured.sparkSession.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = _matrix(b)
            own = stats[(b.column("quality").to_numpy() > 0) & ~base_failed(stats)]
            yield pa.RecordBatch.from_arrays([pa.array(told.value.score(features(own)).view(np.int64))], ["bits"])

    scores = cut(rows.mapInArrow(scored, "bits long"))
    good = scores.count()
    return Judge.of(forest, _nth(scores, _allowed(good, max_good_lost)) if good else float("inf"))


def _nth(scores: DataFrame, n: int) -> float:
    """The score that ``n`` others stand before, the highest first.  ``bits`` of scores, which are not negative, are ordered as
    they are; each round counts 16 of them and knows in which of the 65,536 groups the score lies."""
    high = 0
    for shift in (48, 32, 16, 0):
        own = scores.where(F.shiftright("bits", shift + 16) == high) if shift < 48 else scores
        counts = own.groupBy(F.shiftright("bits", shift).alias("high")).count().collect()
        for high, count in sorted(((r["high"], r["count"]) for r in counts), reverse=True):
            if n < count:
                break
            n -= count
    return float(np.array([high], np.int64).view(np.float64)[0])


def assess(docs: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``score`` and ``kept`` of every row.

    A null or empty text has no words and so fails.  Null ids and repeated rows are judged like any row;
    extra columns are not read; an empty table gives an empty one.
    """
    return assess_measured(measure(docs, id_col, text_col), judge)


def assess_measured(measured: DataFrame, judge: Judge) -> DataFrame:
    """``assess`` on what ``measure`` returns."""
    told = measured.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = _matrix(b)
            scores, kept = told.value.verdict(stats)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base_failed(stats)), pa.array(scores), pa.array(kept)], [*b.schema.names, "base_failed", "score", "kept"])

    return measured.mapInArrow(run, f"{_MEASURED}, base_failed boolean, score double, kept boolean")


def keep(docs: DataFrame, judge: Judge, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the judge keeps, with all their columns.

    A null or empty text has no words and so goes; null ids and repeated rows are judged like any row; no column is read but the
    text, and none is added; an empty table gives an empty one.
    """
    told = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(told.value(utf8(b, text_col))[2]))

    return docs.mapInArrow(run, docs.schema)

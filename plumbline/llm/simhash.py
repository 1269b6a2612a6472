"""SimHash fingerprints, and near-duplicate classes found in forests of BK-trees."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, doc_key, unused, utf8
from plumbline.llm.graph import components

BITS = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_WEIGHTS = np.uint64(1) << np.arange(BITS, dtype=np.uint64)


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of UTF-8 ``text``: A-Z lower-cased, words parted by ASCII white space,
    shingles with repeats (the whole sequence if it is shorter); 0 without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = [0, *(ends[: n - shingle] + 1).tolist()]
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    m = len(hashes)
    octets = hashes.view(np.uint8).reshape(m, 8)
    if m < 48:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(_WEIGHTS[2 * ones > m].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row, fp as a signed long; a null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, shingle) for t in utf8(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKForest:
    """BK-trees over several shards at once, built and searched level by level in numpy.

    ``keys`` names the shard of each fingerprint, ascending; the first of a shard is its root.
    A child hangs from its parent by an edge that carries their Hamming distance.
    """

    def __init__(self, keys: np.ndarray, fps: np.ndarray):
        self.fps = fps
        n = len(fps)
        first = np.ones(n, bool)
        first[1:] = keys[1:] != keys[:-1]
        self.root = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        parent, label, levels = np.full(n, -1), np.zeros(n, np.int64), []
        rest, at = np.flatnonzero(~first), self.root[~first]
        while len(rest):
            d = np.bitwise_count(fps[rest] ^ fps[at]).astype(np.int64)
            slot = at * (BITS + 1) + d
            order = np.argsort(slot, kind="stable")
            rest, at, d, slot = rest[order], at[order], d[order], slot[order]
            new = np.ones(len(rest), bool)
            new[1:] = slot[1:] != slot[:-1]
            node = rest[new]
            parent[node], label[node] = at[new], d[new]
            levels.append(node)
            to = node[np.cumsum(new) - 1]
            rest, at = rest[~new], to[~new]
        nodes = np.flatnonzero(parent >= 0)
        edge = parent[nodes] * (BITS + 1) + label[nodes]
        order = np.argsort(edge, kind="stable")
        self.parent, self.levels, self.edge, self.child = parent, levels, edge[order], nodes[order]

    def search(self, queries: np.ndarray, radius: int, comp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of one shard within ``radius``.  A subtree that lies wholly in the query's own
        component (``comp``) is not entered: it can't add a link that joins two components."""
        if comp is not None:
            low, high = comp.copy(), comp.copy()
            for node in reversed(self.levels):
                np.minimum.at(low, self.parent[node], low[node])
                np.maximum.at(high, self.parent[node], high[node])
        q, at, found = queries, self.root[queries], []
        while len(q):
            if comp is not None:
                go = (low[at] != high[at]) | (low[at] != comp[q])
                q, at = q[go], at[go]
            d = np.bitwise_count(self.fps[q] ^ self.fps[at]).astype(np.int64)
            hit = (d <= radius) & (q != at)
            found.append((q[hit], at[hit]))
            lo = np.searchsorted(self.edge, at * (BITS + 1) + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.edge, at * (BITS + 1) + np.minimum(d + radius, BITS), "right")
            n = hi - lo
            q = np.repeat(q, n)
            at = self.child[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(len(q))]
        return (np.concatenate([x[i] for x in found]) if found else np.zeros(0, np.int64) for i in (0, 1))


def _union(comp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest-label components after the links (a, b)."""
    while len(a):
        la, lb = comp[a], comp[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(comp, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := comp[comp], comp):
            comp = up
    return comp


def shard_links(keys: np.ndarray, fps: np.ndarray, radius: int, work: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within ``radius`` in each shard: (fingerprint, its component's first), at most one a row."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    n = len(fps)
    comp = np.arange(n)
    sizes = np.bincount(np.cumsum(np.r_[True, keys[1:] != keys[:-1]]) - 1)
    cost = np.cumsum(np.repeat(sizes, sizes))
    alone = np.repeat(sizes, sizes) < 2
    tree, start = BKForest(keys, fps.view(np.uint64)), 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + work, "right")))
        q = np.arange(start, stop)
        a, b = tree.search(q[~alone[start:stop]], radius, comp)
        comp = _union(comp, a, b)
        start = stop
    moved = comp != np.arange(n)
    return fps[moved], fps[comp[moved]]


def _scheme(n: int, radius: int, per_shard: int) -> list[int]:
    """Bit masks such that two fingerprints within ``radius`` agree under one of them.

    The bits are cut into b blocks; within the radius at least b - radius blocks are untouched, so each
    choice of that many blocks is a mask.  b grows until a shard holds about ``per_shard`` of ``n``.
    """
    for b in range(radius + 1, radius + 5):
        if b == radius + 4 or n / 2 ** (BITS * (b - radius) // b) <= per_shard:
            break
    edges = [round(i * BITS / b) for i in range(b + 1)]
    blocks = [sum(1 << j for j in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(blocks, b - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def finer(ones: np.ndarray, n: int, radius: int) -> list[int]:
    """``radius + 1`` masks, of blocks of the bits in which ``n`` fingerprints vary (``ones`` counts each bit), about as telling
    as one another: of two fingerprints within the radius no more than that many blocks are touched, so one mask finds them equal."""
    share = ones / n
    worth = np.minimum(share, 1 - share)
    masks, load = [0] * (radius + 1), [0.0] * (radius + 1)
    for j in np.argsort(-worth, kind="stable").tolist():
        if worth[j] > 0:
            k = load.index(min(load))
            masks[k], load[k] = masks[k] | 1 << j, load[k] + float(worth[j])
    return masks


def _refined(rows: DataFrame, crowded: DataFrame, radius: int) -> DataFrame:
    """``rows(fp, key)`` of crowded keys -> rows whose keys are finer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.stack([b.column(f"b{j}").to_numpy() for j in range(BITS)], 1)
            masks = [[_signed(m) for m in finer(own, n, radius)] for own, n in zip(counts, b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(masks, pa.list_(pa.int64()))], ["key", "masks"])

    bits = [F.sum(F.shiftrightunsigned("fp", j).bitwiseAND(F.lit(1))).alias(f"b{j}") for j in range(BITS)]
    masks = cut(rows.join(crowded, "key").groupBy("key").agg(*bits, F.count(F.lit(1)).alias("n")).mapInArrow(run, "key long, masks array<long>"))
    return rows.join(masks, "key").select("fp", "key", F.explode("masks").alias("mask")).select("fp", F.xxhash64("key", "mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))


def links(fps: DataFrame, radius: int = 4, per_shard: int = 2000, hot: int = 4096) -> DataFrame:
    """``fps(fp)`` distinct -> ``(u, v)``: links whose components equal those of all pairs within ``radius``.

    Sharding by blocks of bits is lossless (pigeonhole).  A shard over ``hot`` fingerprints is cut by blocks of the bits in which its
    own vary, again while that leaves a large one: every level takes a fifth of those bits (at radius 4) for five rows a
    fingerprint, so a dense cloud of near copies is not searched all against all.  A task emits at most one link per row.
    """
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in _scheme(fps.count(), radius, per_shard)])
    rows = fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    parts = []
    while True:
        crowded = cut(rows.groupBy("key").count().where(F.col("count") > hot).select("key"))
        if crowded.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(crowded, "key", "left_anti").select("fp", "key"))
        rows = cut(_refined(rows, crowded, radius))
    rows = reduce(DataFrame.union, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, most = [], 0, 300_000

        def out(keys, vals):
            a, b = shard_links(keys, vals, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])

        for b in batches:
            held.append((b.column("key").to_numpy(), b.column("fp").to_numpy()))
            count += len(held[-1][0])
            if count >= most:  # whole shards only: the last one may go on in the next batch
                keys, vals = (np.concatenate(x) for x in zip(*held, strict=True))
                end = int(np.searchsorted(keys, keys[-1]))
                if end:
                    yield out(keys[:end], vals[:end])
                held, count = [(keys[end:], vals[end:])], len(keys) - end
        if count:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def _classes(prints: DataFrame, radius: int, hot: int = 1000) -> DataFrame:
    """``prints(fp, ident)`` -> ``(fp_, least, rows)``: the least ``ident`` of each fingerprint's component, and how many rows have
    the fingerprint."""
    nodes = prints.groupBy("fp").agg(F.min("ident").alias("least"), F.count(F.lit(1)).alias("rows"))
    near = components(links(nodes.select("fp"), radius)).select(F.col("u").alias("fp"), F.col("v").alias("top"))
    # Identifiers meet by component in partial sums first, so that a component's size weighs on no task.
    gathered = near.join(nodes.hint("merge"), "fp").groupBy("top").agg(F.min("least").alias("m"), F.count(F.lit(1)).alias("n"))
    tops = nodes.select(F.col("fp").alias("top"), F.col("least").alias("own"))
    found = cut(gathered.join(tops.hint("merge"), "top").select("top", F.least("own", "m").alias("of_all"), "n"))
    moved = _looked_up(near, "top", found, "n", hot).select("fp", "of_all").union(found.select("top", "of_all"))
    return cut(nodes.join(moved.hint("merge"), "fp", "left").select(F.col("fp").alias("fp_"), F.coalesce("of_all", "least").alias("least"), "rows"))


def _looked_up(rows: DataFrame, key: str, table: DataFrame, n: str, hot: int) -> DataFrame:
    """Stored ``rows`` with the columns of ``table`` for their key; ``n`` tells how many rows have it.  Keys of more than ``hot`` rows
    and than a ten-thousandth of all, which are at most 10,000 keys, are broadcast, so that no task gets one key's rows; the
    others meet in a merge join."""
    limit = max(hot, rows.count() // 10_000)
    hot_keys = F.broadcast(table.where(F.col(n) > limit).withColumn("_hot", F.lit(True)))
    met = rows.join(hot_keys, key, "left")
    rest = met.where("_hot is null").select(rows.columns).join(table.where(F.col(n) <= limit).hint("merge"), key)
    return met.where("_hot").drop("_hot").unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; ``component_id`` is the smallest doc_id
    reachable.  Rows without words share fingerprint 0 and so are linked.  A null doc_id takes part and
    counts as larger than any; repeated rows get the same component; an empty table gives an empty one.
    Extra columns of ``docs`` are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    least = _classes(prints.select("fp", F.col("doc_id").alias("ident")), radius).withColumnRenamed("fp_", "fp")
    return _looked_up(prints, "fp", least, "rows", 1000).select("doc_id", "fp", F.col("least").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each component: the one of the smallest id
    stays (a null id counts as larger than any).  Of rows that repeat an id and text, one stays.  Null and empty texts are near copies
    of one another; an empty table gives an empty one."""
    keys = unused(["_k_null", "_k_id", "_k_text"], docs.columns)
    keyed = docs.withColumns(dict(zip(keys, [F.col(id_col).isNull(), *doc_key(id_col, text_col)], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([simhash(t, shingle) for t in utf8(b, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keys), pa.array(fps, pa.int64())], [*keys, "fp"])

    null, k_id, k_text = keys
    prints = cut(keyed.select(*keys, F.col(text_col).alias("text")).mapInArrow(run, f"{null} boolean, {k_id} long, {k_text} long, fp long"))
    stay = cut(_classes(prints.select("fp", F.struct(*keys).alias("ident")), radius).select("least.*").distinct())
    return keyed.join(stay, keys, "left_semi").dropDuplicates(keys).select(*[F.col(f"`{c}`") for c in docs.columns])

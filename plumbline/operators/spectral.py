"""Scores from eigenvalues of the answers' graphs.

The one stage that leaves the JVM: rows carry small matrices, Arrow batches of them are stacked by size, and each
stack takes one batched eigendecomposition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The kernels' parameters.
HEAT = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7)
KAPPA, NU = (1.0, 2.0, 3.0), (1.0, 2.0, 3.0)
SMALL, TINY = 1e-10, 1e-8


def normalized_laplacian(w: np.ndarray) -> np.ndarray:
    """I - D^-1/2 W D^-1/2 of stacked matrices, with a small constant added to the degrees."""
    d = 1 / np.sqrt(w.sum(-1) + SMALL)
    return np.eye(w.shape[-1]) - w * d[..., :, None] * d[..., None, :]


def graph_laplacian(w: np.ndarray, normalized: bool) -> np.ndarray:
    """D - W; normalised by the degrees, where a node without edges has a zero row."""
    deg = w.sum(-1)
    plain = np.eye(w.shape[-1]) * deg[..., None, :] - w
    if not normalized:
        return plain
    s = np.where(deg > 0, 1 / np.sqrt(np.where(deg > 0, deg, 1)), 0)
    return plain * s[..., :, None] * s[..., None, :]


def eigen_scores(w: np.ndarray, threshold: float = 0.9) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``U_eigv, U_ecc, C_ecc`` of stacked weights.  ``U_ecc`` is free of the choice of basis; ``C_ecc``, one value a kept
    eigenvector (eigenvalue over ``threshold``), is not where eigenvalues repeat."""
    values, vectors = np.linalg.eigh(normalized_laplacian(w))
    n = w.shape[-1]
    eigv = np.maximum(0, 1 - values).sum(-1)
    kept = values > threshold
    sums = vectors.sum(-2)
    ecc = np.sqrt(np.maximum(0, (kept * (1 - sums**2 / n)).sum(-1)))
    each = -np.sqrt(np.maximum(0, 1 - sums**2 / n))
    return eigv, ecc, [e[k] for e, k in zip(each, kept, strict=True)]


def von_neumann(kernel: np.ndarray, scaled: bool) -> np.ndarray:
    """Entropy of a kernel scaled to a unit diagonal and trace 1; divided by ln n if ``scaled``."""
    n = kernel.shape[-1]
    d = np.sqrt(np.diagonal(kernel, axis1=-2, axis2=-1))
    values = np.linalg.eigvalsh(kernel / d[..., :, None] / d[..., None, :] / n)
    logs = np.where(np.abs(values) > TINY, values * np.log(np.where(np.abs(values) > TINY, np.abs(values), 1)), 0)
    out = 0.0 - logs.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return out / np.log(n) if scaled else out


def kernel_entropies(w: np.ndarray, prefix: str = "") -> dict[str, np.ndarray]:
    """64 entropies of stacked graphs: heat and Matern kernels of the plain and normalised Laplacian, scaled (``_s``) or not."""
    out: dict[str, np.ndarray] = {}
    for normalized in (False, True):
        values, vectors = np.linalg.eigh(graph_laplacian(w, normalized))
        mark = "n" if normalized else ""
        forms = {f"heat{mark}_t={t}": np.exp(-t * values) for t in HEAT}
        forms |= {f"matern{mark}_kappa={k}_nu={v}": np.maximum(2 * v / k**2 + values, SMALL) ** -v for k in KAPPA for v in NU}
        for name, f in forms.items():
            kernel = (vectors * f[..., None, :]) @ np.swapaxes(vectors, -1, -2)
            plain = von_neumann(kernel, False)
            out[f"{prefix}{name}_kernel_entropy"] = plain
            with np.errstate(divide="ignore", invalid="ignore"):
                out[f"{prefix}{name}_kernel_entropy_s"] = plain / np.log(w.shape[-1])
    return out


def _stacks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, stacked matrices) for each size of matrix in a column of lists of lists."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = column.flatten()
    if len(rows) and not np.array_equal(rows.value_lengths().to_numpy(zero_copy_only=False), np.repeat(sizes, sizes)):
        raise ValueError("a matrix is not square")
    cells = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes.astype(np.int64) ** 2) - sizes.astype(np.int64) ** 2
    for n in np.unique(sizes).tolist():
        if n:
            at = np.flatnonzero(sizes == n)
            yield at, cells[starts[at, None] + np.arange(n * n)].reshape(-1, n, n)


#: How many rows are worked on at once, and how many graphs' entropies a worker keeps.
ROWS, KEPT = 1024, 4096
_known: dict[tuple, np.ndarray] = {}


def _sorted_nodes(w: np.ndarray) -> np.ndarray:
    """Stacked matrices with their nodes in the order of the nodes' sorted weights, so that most graphs that differ in the order of
    their nodes alone become equal."""
    order = np.lexsort(np.moveaxis(np.sort(w, -1), -1, 0)[::-1], axis=-1)
    w = np.take_along_axis(w, order[..., :, None], -2)
    return np.ascontiguousarray(np.take_along_axis(w, order[..., None, :], -1))


def distinct_entropies(w: np.ndarray) -> tuple[list[str], np.ndarray]:
    """``kernel_entropies`` as names and a row a graph.  They don't depend on the order of nodes, and sets of few distinct answers
    repeat each other's graphs, so each graph is decomposed once; a worker keeps the last few thousand."""
    n = w.shape[-1]
    graphs = _sorted_nodes(w)
    _, first, which = np.unique(graphs.reshape(len(w), -1).view(np.dtype((np.void, 8 * n * n))).ravel(), return_index=True, return_inverse=True)
    keys = [(n, graphs[i].tobytes()) for i in first.tolist()]
    new = [i for i, key in enumerate(keys) if key not in _known]
    rows = {key: _known[key] for key in keys if key in _known}
    if new or not _names:
        found = kernel_entropies(graphs[first[new or [0]]])
        _names[:] = list(found)
        values = np.stack(list(found.values()), 1)
        rows |= {keys[i]: values[k] for k, i in enumerate(new)}
        if len(_known) + len(new) > KEPT:
            _known.clear()
        _known.update((keys[i], rows[keys[i]].copy()) for i in new[:KEPT])
    return _names, np.stack([rows[key] for key in keys])[which]


_names: list[str] = []


def _map(df: DataFrame, compute: Callable[[pa.RecordBatch], list[pa.Array]], names: list[str], schema: str, keep: tuple[str, ...]) -> DataFrame:
    kept = ["qid", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *compute(b)], [*kept, *names])

    return df.mapInArrow(run, ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept) + f", {schema}")


def graph_scores(df: DataFrame, threshold: float = 0.9, keep: tuple[str, ...] = ()) -> DataFrame:
    """``df(qid, weights)`` -> ``(qid, <keep>, u_eigv, u_ecc, c_ecc)``; null without answers."""

    def compute(b: pa.RecordBatch) -> list[pa.Array]:
        eigv, ecc, each = [None] * b.num_rows, [None] * b.num_rows, [None] * b.num_rows
        for at, w in _stacks(b.column("weights")):
            for i, x, y, z in zip(at.tolist(), *eigen_scores(w, threshold), strict=True):
                eigv[i], ecc[i], each[i] = float(x), float(y), z.tolist()
        return [pa.array(eigv, pa.float64()), pa.array(ecc, pa.float64()), pa.array(each, pa.list_(pa.float64()))]

    return _map(df, compute, ["u_eigv", "u_ecc", "c_ecc"], "u_eigv double, u_ecc double, c_ecc array<double>", keep)


def entropy_names() -> list[str]:
    """The names of ``kernel_entropies``, in order."""
    return list(kernel_entropies(np.zeros((1, 2, 2))))


def kernel_scores(df: DataFrame, graphs: dict[str, str], keep: tuple[str, ...] = (), first: tuple[str, ...] = ()) -> DataFrame:
    """``df(qid, <columns of graphs>)`` -> ``(qid, <keep>, entropies)``; ``graphs`` maps a column of edge weights to a name prefix.  The numbers
    in the columns ``first`` lead each map, under their columns' names."""

    def compute(b: pa.RecordBatch) -> list[pa.Array]:
        # Rows of all sizes have the same names; a row without answers has none but the first.
        blocks: dict[str, np.ndarray] = {}
        some = np.zeros(b.num_rows, bool)
        names = list(first)
        for column, prefix in graphs.items():
            for at, w in _stacks(b.column(column)):
                some[at] = True
                own, values = distinct_entropies(w)
                if prefix not in blocks:
                    blocks[prefix] = np.full((b.num_rows, len(own)), np.nan)
                    names += [prefix + name for name in own]
                blocks[prefix][at] = values
        lead = [b.column(c) for c in first]
        rows = np.concatenate([np.zeros((b.num_rows, 0)), *(c.fill_null(0).to_numpy(zero_copy_only=False)[:, None] for c in lead), *blocks.values()], 1)
        null, held = np.zeros(rows.shape, bool), np.ones(rows.shape, bool)
        for k, c in enumerate(lead):
            null[:, k] = c.is_null().to_numpy(zero_copy_only=False)
        held[~some, len(lead) :] = False
        ends = np.r_[0, np.cumsum(held.sum(1))].astype(np.int32)
        keys = pa.array(names, pa.string()).take(pa.array(np.nonzero(held)[1]))
        return [pa.MapArray.from_arrays(pa.array(ends), keys, pa.array(rows[held], mask=null[held]))]

    return _map(df, compute, ["entropies"], "entropies map<string,double>", keep)

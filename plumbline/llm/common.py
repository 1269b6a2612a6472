"""What the operators share: durable cuts of lineage, word splitting, row keys."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (a local test session) a temporary folder takes its place.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir()
        if not named:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            named = f"file://{tempfile.mkdtemp(prefix='plumbline-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, wherever Spark can reach it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's strings as bytes; null becomes empty."""
    col = batch.column(name)
    return [x or b"" for x in col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()]


def doc_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Two columns that tell rows apart: rows with equal keys have equal id and text, so equal results."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("k_id"),
        F.xxhash64(F.col(text_col), F.col(id_col).isNull(), F.col(text_col).isNull()).alias("k_text"),
    ]


def unused(names: list[str], taken: list[str]) -> list[str]:
    """The names, each with underscores before it until no column is called so."""
    low = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in low:
            name = "_" + name
        out.append(name)
    return out


def batched(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Cut a run of items into consecutive slices whose sizes sum to about ``most``; a larger item stands alone."""
    start, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if i >= start:
        yield start, i + 1

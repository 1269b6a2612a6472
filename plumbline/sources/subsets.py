"""Published subsets of confident failures: many small JSON files in folders whose names Spark's path parser rejects."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.schemas import SUBSET


def read_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, model_folder, <fields of the file>)``.  Files are listed by the driver; folder names hold colons, so the texts
    (a few kilobytes each) are handed to Spark as rows instead of paths."""
    files = sorted(Path(folder).glob("*/*.json"))
    texts = spark.createDataFrame([(f.name, f.parent.name, f.read_text("utf-8")) for f in files], "file string, model_folder string, text string")
    return texts.select("file", "model_folder", F.from_json("text", SUBSET).alias("s")).select("file", "model_folder", "s.*")

"""A stream of complete answer sets, scored batch by batch; a set needs no other, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.score import score


def score_stream(sets: DataFrame, cache: DataFrame, method: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """``sets(qid, question, answers)`` streaming -> Parquet below ``out``, one folder a batch, so that a batch that is
    run again after a failure replaces itself."""

    def sink(batch: DataFrame, number: int) -> None:
        score(batch, cache, method, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sets.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

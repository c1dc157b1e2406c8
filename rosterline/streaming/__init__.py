"""Incremental extraction of arriving messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import counters, fusion, records


def roster_stream(messages: DataFrame, path: str, checkpoint: str, gap: int = 2) -> StreamingQuery:
    """Process all messages that have arrived and stop; later runs go on from the checkpoint.

    Extraction keeps no state and does not shuffle, so the stream runs the same
    plan as a batch.  The file sink commits each micro-batch once, which makes
    a restart after lost executors exact.
    """
    finished = messages.transform(fusion.extract, gap).transform(records.process)
    return (
        finished.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def metrics_stream(messages: DataFrame, state: str, checkpoint: str, run: str, gap: int = 2) -> StreamingQuery:
    """Count all messages that have arrived and stop; :func:`rosterline.operators.counters.merged` reads the sums.

    Each micro-batch records its counters under its own number, so that a batch
    run again after a failure is not counted twice.  ``run`` names the query (one
    per checkpoint); any number of runs share a ``state``.
    """
    def step(batch: DataFrame, number: int) -> None:
        found = fusion.candidates(fusion.prepare(batch), gap)
        counters.record_batch(counters.counted(records=fusion.extract(batch, gap), candidates=found), state, run, number)

    return (
        messages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )

"""Streams of mutations: into a table, or resolved as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..table import Table


def upsert_stream(changes: DataFrame, table: Table, checkpoint: str, order: str | None = None, once: bool = False) -> StreamingQuery:
    """Write a stream of (key, value [, op]) into a table, a commit a micro-batch.

    The batch's number is recorded in its commit, so a batch that is replayed after a
    failure changes nothing: each batch takes effect exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.put_df(batch, order=order, tag=f"{checkpoint}#{number}")

    writer = changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest_state(changes: DataFrame, *order: str) -> DataFrame:
    """The newest entry of each key of a stream (key, op, value, ...), for update or complete mode.

    State is one entry a key. Late entries need no watermark: an older version never wins.
    """
    return changes.groupBy("key").agg(F.max_by(F.struct("op", "value"), F.struct(*(order or ("cv", "ord")))).alias("entry")).select("key", "entry.op", "entry.value")

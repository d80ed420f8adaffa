"""Incremental ingest: each micro-batch appends the records that the table doesn't hold yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.stores import append_unseen


def ingest(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of unseen keys of each batch, however old; starts once over what is there.

    A batch that runs again after a failure appends nothing twice, and of two ingests into one table each key stays
    once: the stored table tells what is new, not the time of a row.
    """
    writer = stream.writeStream.foreachBatch(lambda df, _: append_unseen(df, path, key)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()

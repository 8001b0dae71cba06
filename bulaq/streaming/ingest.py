"""Incremental indexing: a stream of documents into the engine's store, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def index_stream(documents: DataFrame, engine: Engine, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each batch skips the chunks the store has, so a batch that is run again after a failure adds nothing twice."""
    writer = documents.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: engine.add_documents(batch))
    return (writer.trigger(availableNow=True) if available_now else writer).start()

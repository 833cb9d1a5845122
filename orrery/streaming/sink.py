"""Streams of writes applied to a collection, each micro-batch once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orrery.plans.catalog import Collection, Files


def write_stream(stream: DataFrame, collection: Collection, checkpoint: str, op: str = "upsert", once: bool = True) -> StreamingQuery:
    """Applies (ord, id, embedding, document, uri, metadata) to the collection batch by batch.

    The number of the last applied batch of each stream, named by the query id in its checkpoint, is
    committed together with the batch's rows: a batch that is replayed after a failure is applied once, a
    batch whose write failed is applied when it comes again, and streams do not shadow each other.
    """
    files = Files(stream.sparkSession, checkpoint)

    def apply(batch: DataFrame, number: int) -> None:
        query = json.loads(files.read("metadata"))["id"]
        collection.write(op, batch, stream=(query, number))

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

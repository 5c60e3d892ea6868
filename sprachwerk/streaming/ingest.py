"""Documents from a stream into a store: each micro-batch replaces by key, so a batch that is run again changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sprachwerk.operators import tables
from sprachwerk.sources.store import Store


def ingest(documents: DataFrame, store: Store, checkpoint: str, max_tokens: int = 512, once: bool = True) -> StreamingQuery:
    """Start writing documents(doc_id, text, …) and their chunks. once: stop when what is there has been read."""

    def put(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        store.upsert("documents", batch)
        store.upsert("chunks", tables.chunk(batch, max_tokens=max_tokens))

    writer = documents.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

"""Pages as a stream: each micro-batch is chunked, without state, and appended to the chunk table. An addition of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkweave.functions.html import page_text
from sparkweave.operators.chunking import chunk_documents
from sparkweave.sources.sinks import append_chunks


def stream_chunks(pages: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that reads ``page_id, url, html`` and appends chunks; it ends when all there is has been read."""

    def write(batch: DataFrame, _: int) -> None:
        docs = batch.select("page_id", page_text(batch["html"]).alias("text"))
        append_chunks(chunk_documents(docs, "page_id"), table)

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Search for streams of queries: an extension, each micro-batch joined with a static gallery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from prismlake.operators.search import search


def serve(queries: DataFrame, gallery: DataFrame, k: int, output: str, checkpoint: str, **filters) -> StreamingQuery:
    """Write the hits of every micro-batch of ``queries(query_id, embedding, ...)`` to Parquet.

    A batch that is run again after a failure overwrites its own folder, so hits are written once.
    """

    def answer(batch: DataFrame, epoch: int) -> None:
        search(batch, gallery, k, **filters).write.mode("overwrite").parquet(f"{output}/epoch={epoch}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Decoding a stream of documents: decoding keeps no state, so every micro-batch decodes alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.decode import decode_text


def start(stream: DataFrame, table_id: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Hand each micro-batch of `stream` (doc_id, text), decoded, to `sink` with its number."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(decode_text(df, table_id), n)).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

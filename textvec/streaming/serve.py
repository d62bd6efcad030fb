"""Streams of texts or requests: stateless maps, so no watermark and no state store.

Row-preserving transforms run in the stream itself; request answering regroups the inputs of one
request, which all stand in one micro-batch, so it runs per micro-batch in foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.pipeline import Embedder, embed
from ..operators.serving import serve


def embed_stream(texts: DataFrame, embedder: Embedder, text_col: str = "text") -> DataFrame:
    return embed(texts, embedder, text_col)


def serve_stream(requests: DataFrame, embedder: Embedder, model: str, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Answers each micro-batch of (request_id, body) and hands (request_id, status, response) to the sink."""
    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(serve(df, embedder, model), n))
    return (writer.trigger(availableNow=True) if once else writer).start()

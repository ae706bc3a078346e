"""Questions that arrive as a stream, answered batch by batch against a fixed index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mathloom.operators.index import Index
from mathloom.operators.search import prepare_queries, search


def answer_stream(queries: DataFrame, index: Index, sink: Callable[[DataFrame, int], None], checkpoint: str, use_formula: bool = True) -> StreamingQuery:
    """Search every micro-batch of ``queries`` (qid, text) and hand its results to ``sink``. No state is kept
    between batches, so no watermark is needed; a batch may come again after a failure with the same number."""

    def run(batch: DataFrame, number: int) -> None:
        sink(search(index, prepare_queries(batch, use_formula), use_formula), number)

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

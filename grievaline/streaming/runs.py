"""Running a stream, to the end of what has arrived or for good."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_stream(
    rows: DataFrame,
    each: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Calls ``each`` per batch; a batch may be replayed with its number.

    Without ``every`` all arrived data is processed and the stream has ended on
    return; with it (``"1 minute"``) the running query is returned.
    """
    writer = rows.writeStream.outputMode(mode).foreachBatch(each)
    writer = writer.option("checkpointLocation", checkpoint)
    if every is not None:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query

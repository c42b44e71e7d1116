"""Request scoring as a stream; the plan is the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from grievaline.plans.complaints import unify_output
from grievaline.sources.sinks import write_batch
from grievaline.streaming.runs import run_stream


def request_stream(
    requests: DataFrame,
    replies: DataFrame,
    translations: DataFrame,
    tool_logs: DataFrame,
    target: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Unified result rows per batch of requests, under ``target``."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(unify_output(batch, replies, translations, tool_logs), target, batch_id)

    return run_stream(requests, each, checkpoint, every=every)

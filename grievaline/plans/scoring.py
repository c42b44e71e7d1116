"""The hook for a real model: a function from a frame of requests to a frame of results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

RESULT_DDL = (
    "request_id string, request_type string, status string, message string, sms_uri string, "
    "formatted_complaint string, char_count int, detected_language string, engine_notes string, "
    "journey_id string, extracted_data string, chat_reply string, tool_log string"
)


def score_frames(requests: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """Result rows from ``score``, called with one Arrow batch of requests at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield score(frame)

    return requests.mapInPandas(run, RESULT_DDL)

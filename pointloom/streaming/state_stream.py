"""The last-write-wins state on a stream of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import latest


def run_latest(events: DataFrame, key: str, value: Column, order: list[str], sink: str, checkpoint: str) -> StreamingQuery:
    """Keep the last value of each key from a streaming DataFrame in a memory table, until the input is used up.

    State is one row a key. Other sinks take latest(...) in update mode as it is.
    """
    out = latest(events, key, value, *order)
    return out.writeStream.outputMode("complete").format("memory").queryName(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

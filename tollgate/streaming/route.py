"""Route a stream of free-text questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tollgate.plans.route import route_batch
from tollgate.sources.bundle import Bundle


def route_stream(
    stream: DataFrame,
    bundle: Bundle,
    path: str,
    checkpoint: str,
    cut: float | None = None,
    text: str = "text",
    attach: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Stateless: each text is split, scored and routed as in batch, and appended."""
    routed = route_batch(stream, bundle, cut, text, attach)
    writer = routed.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)

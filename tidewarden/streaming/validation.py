"""Streaming validation with a catalog that is read again for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.validation import validate
from ..sinks.split import write_split


def validate_stream(events: DataFrame, catalog: Callable[[], DataFrame], valid_path: str, dirty_path: str, checkpoint: str, layout: str = "nested", order: str | None = None, interval: str | None = "30 seconds") -> StreamingQuery:
    """Start validation of a stream of texts.

    ``catalog`` is called for each micro-batch, so schemas load while the query runs; an
    event sees all schemas that had arrived when its batch began.  With ``order``, a column
    of events and catalog that tells when each arrived (a topic's timestamp), ``catalog``
    gives all versions and an event sees those that came before it, however the arrivals
    fall into batches.  No watermark: no event is ever dropped as late.  Without ``interval`` all that is there is read, then it ends.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_split(validate(batch, catalog(), layout, order=order), valid_path, dirty_path, batch_id)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()

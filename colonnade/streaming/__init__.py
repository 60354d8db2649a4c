"""Streams into tables. Filters and projections apply to streaming DataFrames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..errors import Conflict
from ..store import Table


def append_stream(stream: DataFrame, root: str, checkpoint: str, retries: int = 5, **trigger) -> StreamingQuery:
    """Insert each micro-batch into the table at ``root``, all or nothing.

    A batch that another writer overtakes is tried again on the newer version. The commit records the batch's number under
    the checkpoint's path, so one that Spark repeats after a failure is not inserted twice.
    """

    def insert(batch: DataFrame, number: int) -> None:
        for left in reversed(range(retries)):
            try:
                Table.open(batch.sparkSession, root).append(batch, (checkpoint.rstrip("/"), number))
                return
            except Conflict:
                if not left:
                    raise

    return stream.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

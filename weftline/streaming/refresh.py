"""Catalogue refresh: new files replace the snapshot when they are valid."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from weftline.sources.jobs import jobs_from_documents, replace_snapshot

log = logging.getLogger(__name__)


def refresh_stream(spark: SparkSession, directory: str, root: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Watch ``directory`` for catalogue documents; an invalid one is logged and leaves the old snapshot in place.

    Each micro-batch takes one file, so the newest valid document wins.
    """
    documents = (
        spark.readStream.schema("value string")
        .option("wholetext", True)
        .option("maxFilesPerTrigger", 1)
        .format("text")
        .load(directory)
    )

    def swap(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        try:
            replace_snapshot(jobs_from_documents(batch), root)
        except ValueError as problem:
            log.warning("catalogue in batch %s rejected: %s", batch_id, problem)

    return (
        documents.writeStream.foreachBatch(swap).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )

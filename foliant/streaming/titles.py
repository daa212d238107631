"""Titles of documents as they arrive. A document is whole in itself, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.titles import detect_titles
from foliant.sources.adapters import html_docs, html_lines


def stream_titles(pages: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write the titles of a stream of (page_id, url, html) to `path`, a folder for each batch.

    A batch that runs again after a failure replaces its own folder.
    """

    def batch(df: DataFrame, number: int) -> None:
        detect_titles(html_docs(df), html_lines(df)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

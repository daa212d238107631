"""The two windows that everything is over; made when asked for, as workers have no session."""

from __future__ import annotations

from pyspark.sql import Window, WindowSpec


def doc_window() -> WindowSpec:
    return Window.partitionBy("doc_id")


def page_window() -> WindowSpec:
    return Window.partitionBy("doc_id", "page")

"""Streams of incoming files: texts as they come, and counts by time of change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tables import each_file, page_texts
from ..functions import pdf


def text_stream(files: DataFrame) -> DataFrame:
    """doc_id, page_no, text of a stream made by ``stream_files``; no state is kept."""
    return page_texts(files)


def page_counts(files: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window, files, bytes by the files' time of change; files more than ``late`` behind are not counted."""
    timed = files.withWatermark("modified", late)
    return timed.groupBy(F.window("modified", window)).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


def metadata_stream(files: DataFrame) -> DataFrame:
    """doc_id, title, pages."""

    def rows(content: bytes):
        m = pdf.metadata(content)
        return [(m["info"].get("Title"), m["pages"])]

    return each_file(files, "title string, pages int", rows)

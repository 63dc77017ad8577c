"""PDF files in and out of tables.

``read_files`` goes through Spark's own file reader: any file system, splits by size,
also as a stream. ``format("pdf")`` is a Python data source for a folder that all
executors see: it plans by file size, parses in the reader, and writes one file per row.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions import pdf
from ..functions.syntax import PdfError
from ..ship import ship

#: Files are read together up to so many bytes in a task.
TASK_BYTES = 64 << 20


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """doc_id (the path), length, modified, content."""
    return _named(ship(spark).read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path))


def stream_files(spark: SparkSession, path: str, glob: str = "*.pdf", per_batch: int = 1000) -> DataFrame:
    """The same as a stream of the files that come in; the operators of tables.py apply to it."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return _named(ship(spark).readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(path))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("path").alias("doc_id"), "length", F.col("modificationTime").alias("modified"), "content")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class PdfReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.password = options["path"], options.get("password")
        self.strict = options.get("strict", "false") == "true"
        self.limit = int(options["maxDecompressedSize"]) if "maxDecompressedSize" in options else pdf.LIMIT

    def partitions(self) -> list[_Files]:
        found = sorted(os.path.join(d, n) for d, _, names in os.walk(self.path) for n in names if n.lower().endswith(".pdf"))
        out, size = [], TASK_BYTES
        for p in found:
            if size >= TASK_BYTES:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(p)
            size += os.path.getsize(p)
        return out or [_Files([])]

    def read(self, part: _Files) -> Iterator[tuple]:
        for path in part.paths:
            with open(path, "rb") as f:
                content = f.read()
            try:
                d = pdf.load(content, self.password, self.strict, self.limit)
                yield path, d.version, len(d.objects), len(pdf.pages(d)), d.encrypted, None, content
            except PdfError as x:
                if self.strict:
                    raise
                yield path, None, None, None, None, x.code, content


class PdfWriter(DataSourceWriter):
    """A row is a file ``<doc_id>.pdf`` with the id quoted; one written twice, by a task that ran again, is
    one file. Files of other ids in the folder stay, in either mode."""

    def __init__(self, options, overwrite: bool, names: list[str]):
        self.path, self.overwrite, self.names = options["path"], overwrite, names

    def write(self, rows) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        for row in rows:
            r = dict(zip(self.names, row, strict=True))
            name = quote(str(r["doc_id"]), safe="")
            target = os.path.join(self.path, f"{name}.pdf")
            part = f"{target}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, target)
        return WriterCommitMessage()


class PdfSource(DataSource):
    """Options: path, password, strict, maxDecompressedSize."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return "doc_id string, version string, objects int, pages int, encrypted boolean, error string, content binary"

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)

    def writer(self, schema, overwrite: bool) -> PdfWriter:
        return PdfWriter(self.options, overwrite, schema.names)


def register(spark: SparkSession) -> SparkSession:
    ship(spark).dataSource.register(PdfSource)
    return spark

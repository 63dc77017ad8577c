"""What the operators share: tables in the shared folder, words, letters."""

from __future__ import annotations

import contextlib
import contextvars
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: A word, for every operator that counts or shingles words: a run of bytes
#: other than ASCII white space.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a local one is set.
    """
    ship(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not path:
        path = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written in the innermost ``scratch``.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage with replicated, compressed, column-prunable files, so a
    lost executor costs a read and no recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written in it at its end, but for those passed through the function that it gives.

    What leaves the block may read kept tables only.
    """
    written: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._table_path)
        return df

    token = _written.set(written)
    try:
        yield keep
    finally:
        _written.reset(token)
        if (outer := _written.get()) is not None:
            outer.extend(kept)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in written:
            if path not in kept:
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(conf).delete(at, True)


def lower_ascii(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_of(batch, name: str):
    """The text column of an Arrow batch as one StringArray, null as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col.cast(pa.large_string()), "")


def by_bytes(batch, name: str, limit: int = 3 << 20):
    """Cuts a batch into slices of about ``limit`` bytes of text.

    A slice holds one row at least, whatever its size.
    """
    import numpy as np

    if not batch.num_rows:
        return
    texts = text_of(batch, name)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1)
        yield batch.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop

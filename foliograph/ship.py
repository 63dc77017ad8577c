"""Gives executors this package.

Python workers on other machines don't see the driver's folders, so the package
travels as a zip file through Spark's own file service.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch for Python workers: a batch of whole documents stays small whatever their length.
BATCH_BYTES = 8 << 20
_done: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the session's Python files, once per application."""
    sc = spark.sparkContext
    if int(str(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")).rstrip("b")) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId in _done:
        return spark
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="foliograph-"), "foliograph.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith((".py", ".json")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("foliograph", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _done.add(sc.applicationId)
    return spark

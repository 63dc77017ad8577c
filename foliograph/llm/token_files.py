"""Token-ID output: flat unsigned integer files with 64-bit document offsets.

A data set is a folder in a store that all machines share. Partition p of the
documents, in ascending doc_id order, is three files of little-endian integers:

* ``p.bin``  ids of its documents in a row (uint16 or uint32),
* ``p.idx``  int64: place in p.bin where each document starts, and the end,
* ``p.doc``  int64 pairs: 1 if the doc_id is null, doc_id.

``base`` of a partition, the ids of all partitions before it, comes from a
prefix sum over the partitions' totals, kept in ``manifest.json``. Readers map
the files into memory where the store is a local or mounted path and read them
through pyarrow's file systems elsewhere.

A task writes under a name of its own and renames at its end, so a task that is
run twice, or dies, leaves whole files only.

Defined results: a null text is empty and gives the end id alone; null doc_ids
come first; rows repeated with one doc_id follow each other; an empty table gives a
data set without documents.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, fresh_path
from .tokens import encoder, vocabulary

END_ID = 2
FILES = ("bin", "idx", "doc")


def _store(path: str):
    """(pyarrow file system, path in it, whether files can be mapped)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path, True
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, False


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, keeps_space: bool = False, dtype: str = "<u2", partitions: int | None = None) -> list[dict]:
    """Writes the data set and returns its manifest: one entry per partition with its base."""
    spark = docs.sparkSession
    store, inner, _ = _store(folder)
    store.create_dir(inner, recursive=True)

    def write(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fs_, root, _ = _store(folder)
        own = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
        enc = encoder(tokenizer, keeps_space)
        out = {x: fs_.open_output_stream(f"{own}.{x}") for x in FILES}
        n_docs = n_ids = 0
        top = np.iinfo(np.dtype(dtype)).max
        for batch in batches:
            for rows, texts in by_bytes(batch, "text", 6 << 20):
                ids, ends = encoder_with_end(enc, texts, end_id)
                if len(ids) and int(ids.max()) > top:
                    raise ValueError(f"an id doesn't fit {dtype}")
                out["bin"].write(ids.astype(dtype).tobytes())
                out["idx"].write((ends[:-1] + n_ids).astype("<i8").tobytes())
                doc = rows.column(0)
                pair = np.empty((len(doc), 2), "<i8")
                pair[:, 0] = doc.is_null().to_numpy(zero_copy_only=False)
                pair[:, 1] = doc.fill_null(0).to_numpy(zero_copy_only=False)
                out["doc"].write(pair.tobytes())
                n_docs += len(doc)
                n_ids += len(ids)
        out["idx"].write(np.array([n_ids], "<i8").tobytes())
        for x in FILES:
            out[x].close()
            fs_.move(f"{own}.{x}", f"{root}/{part:06d}.{x}")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [n_docs], "n_ids": [n_ids]}, schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    # one row per partition comes to the driver: their number is a setting and doesn't grow with documents
    totals = sorted(ordered.mapInArrow(write, "part int, n_docs long, n_ids long").collect())
    parts, base = [], 0
    for part, n_docs, n_ids in totals:
        parts.append({"part": part, "base": base, "n_docs": n_docs, "n_ids": n_ids})
        base += n_ids
    with store.open_output_stream(f"{inner}/manifest.json") as f:
        f.write(json.dumps({"dtype": dtype, "parts": parts}).encode())
    return parts


def encoder_with_end(enc, texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after each text, and ends."""
    ids, ends = enc.encode(texts)
    n = len(texts)
    out = np.insert(ids, ends[1:], end_id) if n else ids
    return out, ends + np.arange(n + 1)


def open_part(folder: str, part: int, dtype: str):
    """(ids, offsets, doc pairs) of a partition, memory-mapped where the store allows."""
    store, root, mapped = _store(folder)
    kinds = {"bin": dtype, "idx": "<i8", "doc": "<i8"}
    got = []
    for x in FILES:
        at = f"{root}/{part:06d}.{x}"
        if mapped:
            got.append(np.memmap(at, kinds[x], "r") if os.path.getsize(at) else np.zeros(0, kinds[x]))
        else:
            with store.open_input_file(at) as f:
                got.append(np.frombuffer(f.readall(), kinds[x]))
    return got[0], got[1], got[2].reshape(-1, 2)


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    store, inner, _ = _store(folder)
    with store.open_input_file(f"{inner}/manifest.json") as f:
        manifest = json.loads(f.readall())
    parts, dtype = {p["part"]: p["base"] for p in manifest["parts"]}, manifest["dtype"]
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids

    def read(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                ids, idx, doc = open_part(folder, part, dtype)
                for at in range(0, len(doc), 4096):
                    offsets = idx[at : at + 4097]
                    own = doc[at : at + 4096]
                    rows = [np.asarray(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                    cols = [
                        pa.array(own[:, 1], mask=own[:, 0] == 1),
                        pa.array(offsets[:-1] + parts[part]),
                        pa.array(np.diff(offsets)),
                        pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in rows], pa.int64()),
                    ] + [pa.array([r.astype(np.int64) for r in rows], pa.list_(pa.int64()))] * with_ids
                    yield pa.RecordBatch.from_arrays(cols, names=[n for n, _ in fields])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    n = max(1, len(parts))
    return spark.range(0, len(parts), 1, n).selectExpr("cast(id as int) AS part").mapInArrow(read, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir).select("doc_id", "text"), folder, vocabulary("word_bpe_49k.json"))
    return read_token_files(spark, folder)

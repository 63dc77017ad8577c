"""Best-fit packing, hierarchically over what is left.

Documents become pieces of at most ``length`` tokens. Each partition packs its
pieces by best fit, largest first, and emits the bins that are nearly full. The
others travel on as items of their own (their fill is their size, their content
a short list) and partitions merge in a tree: a few into one, best fit again,
emit, until one group is left or a round no longer saves bins. A group never
holds more than ``group_items`` items, so a task's memory has a bound whatever
the size of the corpus.

Defined results: a null text is empty and its document has the end id alone;
rows repeated with one doc_id are documents of their own; long documents are cut
from their end, so the first piece is the short one; an empty table gives no
sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, table
from .token_files import encoder_with_end
from .tokens import encoder, vocabulary

LENGTH = 2048
#: A bin with so many free tokens or fewer is emitted.
NEARLY_FULL = 4
FAN_IN = 8
GROUP_ITEMS = 200_000
PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECE_SQL = "struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>"
BIN_SQL = f"fill long, full boolean, salt long, pieces array<{PIECE_SQL}>"
BIN = pa.schema([("fill", pa.int64()), ("full", pa.bool_()), ("salt", pa.int64()), ("pieces", pa.list_(PIECE))])


def best_fit(sizes: np.ndarray, length: int) -> np.ndarray:
    """The bin of each item, by best fit with the largest items first.

    Bins are kept by their free space, in stacks, with a bit mask of the spaces
    that have any; the best bin for an item is the mask's lowest bit at its size.
    """
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    mask, n = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                mask &= ~(1 << free)
        else:
            free, b = length, n
            n += 1
        bins[i] = b
        free -= size
        stacks[free].append(b)
        mask |= 1 << free
    return bins


def _packed(fills: np.ndarray, pieces: pa.ListArray, salts: np.ndarray, length: int, nearly: int):
    """Items to bins: one Arrow batch of (fill, full, salt, pieces)."""
    bins = best_fit(fills, length)
    order = np.argsort(bins, kind="stable")
    total = np.bincount(bins, weights=fills).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    counts = np.bincount(bins, weights=np.asarray(pc_len(pieces)), minlength=len(total)).astype(np.int64) if len(bins) else np.zeros(0, np.int64)
    content = pieces.take(pa.array(order)).flatten()
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    lowest = np.full(len(total), np.iinfo(np.int64).max)
    np.minimum.at(lowest, bins, salts)
    return pa.RecordBatch.from_arrays([pa.array(total), pa.array(length - total <= nearly), pa.array(lowest), pa.ListArray.from_arrays(pa.array(offsets), content)], schema=BIN)


def pc_len(lists: pa.ListArray) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _repack(length: int, nearly: int, group_items: int):
    def repack(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= group_items:
                yield from _flush(held, length, nearly)
                held, n = [], 0
        yield from _flush(held, length, nearly)

    return repack


def _flush(held, length: int, nearly: int):
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        for b in t.to_batches():
            if b.num_rows:
                yield _packed(b.column(0).to_numpy(), b.column(3), b.column(2).to_numpy(), length, nearly)


def cut_pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, keeps_space: bool) -> DataFrame:
    """Documents to items: fill, full, salt, pieces (one each)."""

    def cut(batches):
        enc = encoder(tokenizer, keeps_space)
        for batch in batches:
            for rows, texts in by_bytes(batch, "text", 6 << 20):
                ids, ends = encoder_with_end(enc, texts, end_id)
                raw = ids.astype("<u4").view(np.uint8)
                out = []
                for doc, a, b in zip(rows.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    n = b - a
                    first = n % length or length
                    at = 0
                    for k, size in enumerate([first] + [length] * ((n - first) // length)):
                        out.append((doc, k, at, size, zlib.crc32(raw[4 * (a + at) : 4 * (a + at + size)])))
                        at += size
                doc, k, start, size, crc = (list(c) for c in zip(*out, strict=True))
                sizes = np.asarray(size, np.int64)
                pieces = pa.StructArray.from_arrays([pa.array(doc, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64())], fields=list(PIECE))
                salt = np.asarray(crc, np.int64) ^ (np.asarray([d or 0 for d in doc], np.int64) << 8)
                yield pa.RecordBatch.from_arrays([pa.array(sizes), pa.array(sizes == length), pa.array(salt), pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32)), pieces)], schema=BIN)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, BIN_SQL)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, keeps_space: bool = True, nearly: int = NEARLY_FULL, fan_in: int = FAN_IN, group_items: int = GROUP_ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # items hold a few numbers a document, so the table is small beside the texts
    items = table(cut_pieces(docs, tokenizer, length, end_id, keeps_space), "items")
    done = [items.filter("full")]
    left = items.filter("NOT full")
    n = left.count()
    groups = max(1, -(-n // (group_items // fan_in)))
    while n:
        dealt = left.repartition(groups, F.xxhash64("salt", "fill"))
        round_ = table(dealt.mapInArrow(_repack(length, nearly, group_items), BIN_SQL), "bins")
        under = round_.filter("NOT full")
        m = under.count()
        if groups == 1 or m > 0.999 * n:  # one group is left, or merging saves nothing
            done.append(round_)
            break
        done.append(round_.filter("full"))
        left, n = under, m
        groups = max(-(-n // group_items), groups // fan_in, 1)
    bins = done[0]
    for d in done[1:]:
        bins = bins.unionByName(d)
    bins = bins.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces")
    before = "aggregate(slice(pieces, 1, p.at), 0L, (s, x) -> s + x.length)"
    pieces = bins.select("sequence_id", "pieces", F.expr("explode(transform(pieces, (x, i) -> struct(x AS it, i AS at))) AS p"))
    return pieces.select("p.it.*", "sequence_id", F.expr(before).alias("offset"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))

"""Suffix-array dedup: removes bytes covered by strings of ``length`` bytes that stand elsewhere too.

Shards by content. Each window of ``length`` bytes is keyed by the smallest
hash among its ``GRAM``-byte grams; equal windows have equal keys wherever they
stand, so they meet in one shard, and every window is in one shard only. Starts
next to each other that owe their key to the same place form a run, which
travels as one piece of text.

* Runs whose key occurs once are unique and end there.
* Runs with equal pieces are repeated as a whole; one of them goes on.
* A key whose different pieces have more bytes than a shard is split: starts at
  like distances before the run's gram share a core of text, and windows that
  are equal have equal cores, so the core's hash is their new key. Cores get
  longer until they are the windows themselves (``SPLITS``), which are equal or
  don't meet. No shard outgrows its bound, however frequent a passage is.
* The pieces that share a key but differ are sorted as suffixes: external
  induced sorting with common-prefix values (``induced_sort``) marks the starts
  whose first ``length`` bytes stand elsewhere.

Then each document's marked starts become removed byte ranges.

Defined results: a null text is empty; texts shorter than ``length`` bytes lose
nothing; rows repeated with one doc_id are documents of their own, so their
long strings are repeated; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, scratch, table
from .induced_sort import MEMORY, repeated_starts

LENGTH = 400
GRAM = 32
#: Bytes of pieces that are sorted at once; a key with more is split.
SHARD = 2 << 20
#: Starts that share a core, at each split of a key that is still too large.
SPLITS = (64, 8, 1)
#: Places of the bitmap that tells which documents have runs to look at.
BITS = 1 << 26
RANGES = "array<struct<first: int, last: int>>"
_B = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) from each place."""
    h = data.astype(np.uint64) + np.uint64(1)
    power, size = _B, 1
    while size < gram:
        h = h[:-size] * power + h[size:]
        power, size = power * power, size * 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    n = len(h) - width + 1
    full = -(-len(h) // width) * width
    blocks = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(h)] = h
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1 : width - 1 + n])


def window_runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Texts in a row (ends from 0): key, text number, first and last start of each run."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return empty.view(np.uint64), empty, empty, empty
    with np.errstate(over="ignore"):
        h = gram_hashes(data, gram)
        key = sliding_min(h, length - gram + 1)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(key)]
    valid = np.flatnonzero(np.arange(len(key)) + length <= ends[doc + 1])
    if not len(valid):
        return empty.view(np.uint64), empty, empty, empty
    k, d = key[valid], doc[valid]
    # the leftmost smallest gram changes when it is the window's first: a text that repeats itself
    # has a run for each place of the gram
    new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]) | (h[valid[:-1]] == k[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(valid)] - 1
    base = ends[:-1][d[first]]
    return k[first], d[first], valid[first] - base, valid[last] - base


def _bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def _runs(length: int, gram: int):
    def run(batches):
        for batch in batches:
            for rows, texts in by_bytes(batch, "text", 2 << 20):
                data, ends = _bytes_of(texts)
                key, doc, first, last = window_runs(data, ends, length, gram)
                raw = data.tobytes()
                start = ends[:-1][doc] + first
                piece = [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), (start + last - first + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(piece, pa.binary()), rows.column(0).take(pa.array(doc)), rows.column(1).take(pa.array(doc)), pa.array(first, pa.int32()), pa.array(last, pa.int32())],
                    names=["m", "piece", "row", "id", "first", "last"],
                )

    return run


def sub_runs(raw: bytes, m: int, first: int, last: int, at: int | None, length: int, gram: int, width: int):
    """(key, first, last, place of the gram) of a run's starts, by distance to the gram in steps of ``width``."""
    if at is None:
        with np.errstate(over="ignore"):
            h = gram_hashes(np.frombuffer(raw[first : last + length], np.uint8), gram)
        at = first + int(np.argmax(h == np.int64(m).view(np.uint64)))
    for c in range((at - last) // width, (at - first) // width + 1):
        far = min((c + 1) * width - 1, length - gram)
        core = hashlib.blake2b(raw[at - c * width : at - far + length], digest_size=8, key=b"%d %d" % (m, c)).digest()
        yield int.from_bytes(core, "little", signed=True), max(first, at - far), min(last, at - c * width), at


def _resplit(length: int, gram: int, width: int):
    """Documents with runs of keys that are too large to shorter runs with finer keys."""

    def run(batches):
        for batch in batches:
            for rows, texts in by_bytes(batch, "text", 1 << 20):
                out: list[tuple] = []
                for text, row, id_, runs in zip(texts.to_pylist(), rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(3).to_pylist(), strict=True):
                    raw = text.encode()
                    for r in {r["first"]: r for r in runs}.values():
                        for m, first, last, at in sub_runs(raw, r["m"], r["first"], r["last"], r["gram"], length, gram, width):
                            out.append((m, hashlib.blake2b(raw[first : last + length], digest_size=16).digest(), row, id_, first, last, at))
                cols = list(zip(*out, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["m", "piece", "row", "id", "first", "last", "gram"])

    return run


def cover(size: int, ranges, length: int) -> tuple[np.ndarray, int]:
    """(mask of removed bytes, number of spans) for ranges of marked starts."""
    step = np.zeros(size + 1, np.int64)
    for first, last in ranges:
        step[first] += 1
        step[last + length] -= 1
    mask = np.cumsum(step[:size]) > 0
    return mask, int((mask & ~np.r_[False, mask[:-1]]).sum()) if size else 0


def _digest(data: np.ndarray, ranges, length: int) -> tuple[int, int, int, str, bytes]:
    mask, spans = cover(len(data), ranges, length)
    kept = data[~mask].tobytes()
    return len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), kept


PARTS = [("kind", pa.int8()), ("row", pa.int64()), ("id", pa.int64()), ("m", pa.int64()), ("first", pa.int32()), ("known", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("alone", pa.bool_()), ("body", pa.binary())]
PARTS_SQL = f"kind tinyint, row long, id long, m long, first int, known {RANGES}, alone boolean, body binary"


def _split(length: int):
    """Documents with their runs to: 0 documents that are decided, 1 pieces to sort, 2 documents that wait for them."""
    import zstandard

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for rows, texts in by_bytes(batch, "text", 4 << 20):
                out: dict[str, list] = {n: [] for n, _ in PARTS}

                def put(*values, out=out):
                    for col, v in zip(out.values(), values, strict=True):
                        col.append(v)

                for text, row, id_, runs in zip(texts.to_pylist(), rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(3).to_pylist(), strict=True):
                    raw = text.encode()
                    runs = runs or []
                    known = [{"first": r["first"], "last": r["last"]} for r in {(r["first"], r["last"]): r for r in runs if r["known"]}.values()]
                    ask = {r["first"]: r for r in runs if r["m"] is not None}
                    for r in ask.values():
                        put(1, row, id_, r["m"], r["first"], None, r["alone"], raw[r["first"] : r["last"] + length])
                    waits = any(r["alone"] for r in ask.values())
                    put(2 if waits else 0, row, id_, None, None, known, None, pack.compress(raw))
                yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in PARTS], names=[n for n, _ in PARTS])

    return run


def _sort(length: int, shard: int, memory: int):
    """Pieces sorted by key to the marked starts of the pieces that stand once."""

    def flush(held):
        t = pa.Table.from_batches(held)
        bodies = [b for b in t.column("body").to_pylist()]
        sizes = np.array([len(b) + 1 for b in bodies])
        ends = np.cumsum(sizes)
        text = np.zeros(int(ends[-1]), np.int16)
        for b, e in zip(bodies, ends.tolist(), strict=True):
            text[e - 1 - len(b) : e - 1] = np.frombuffer(b, np.uint8).astype(np.int16) + 1
        marks = repeated_starts(text, length, memory)
        rows, ids, firsts, alone = (t.column(c).to_pylist() for c in ("row", "id", "first", "alone"))
        got = []
        for i, (b, e) in enumerate(zip(bodies, ends.tolist(), strict=True)):
            if alone[i]:
                own = np.flatnonzero(marks[e - 1 - len(b) : e - length])
                if len(own):
                    cut = np.flatnonzero(np.diff(own) > 1)
                    for a, z in zip(own[np.r_[0, cut + 1]].tolist(), own[np.r_[cut, len(own) - 1]].tolist(), strict=True):
                        got.append((rows[i], ids[i], firsts[i] + a, firsts[i] + z))
        row, id_, first, last = ([g[k] for g in got] for k in range(4))
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(id_, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["row", "id", "first", "last"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            m = batch.column(batch.schema.get_field_index("m")).to_numpy()
            body = batch.column(batch.schema.get_field_index("body"))
            ends = np.cumsum(np.asarray(body.cast(pa.binary()).value_lengths() if hasattr(body, "value_lengths") else [len(b.as_py()) for b in body]))
            at = 0
            for cut in [*(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), len(m)]:
                held.append(batch.slice(at, cut - at))
                size += int(ends[cut - 1] - (ends[at - 1] if at else 0))
                at = cut
                # a cut only between keys: the last key of a batch may go on in the next
                if size >= shard and cut < len(m):
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def _finish(length: int, with_kept: bool):
    import zstandard

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                out = []
                for id_, body, known, more in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    ranges = [(r["first"], r["last"]) for r in (known or [])] + [(r["first"], r["last"]) for r in (more or [])]
                    data = np.frombuffer(unpack.decompress(body), np.uint8)
                    out.append((id_, *_digest(data, ranges, length)))
                cols = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_kept], names=names[: 5 + with_kept])

    return run


def _named_rows(base: DataFrame, rows: DataFrame) -> DataFrame:
    """``base`` with ``_may``: false only for documents that aren't among ``rows``.

    A bitmap of BITS places is broadcast: 8 MB at most, however many rows there
    are. Beyond some ten million it names all documents, which costs a shuffle.
    """
    place = lambda c: F.pmod(F.col(c), F.lit(BITS))
    bits = rows.select((place("row") / F.lit(1 << 15)).cast("long").alias("_part"), (place("row") % (1 << 15)).alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    at = place("row") % (1 << 15)
    octet = F.conv(F.hex(F.substring(F.col("_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(octet.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False))
    return base.withColumn("_part", (place("row") / F.lit(1 << 15)).cast("long")).join(F.broadcast(bits), "_part", "left").select(*base.columns, hit.alias("_may"))


def _met(base: DataFrame, length: int, gram: int, shard: int) -> tuple[DataFrame, DataFrame]:
    """(runs that stand elsewhere too, different pieces by key to sort: at most ``shard`` bytes of a key)."""
    runs = base.filter(F.octet_length("text") >= length).mapInArrow(_runs(length, gram), "m long, piece binary, row long, id long, first int, last int")
    runs = table(runs, "runs").withColumn("gram", F.lit(None).cast("int"))
    marks = asks = None
    for width in (*SPLITS, None):
        one = runs.groupBy("m", "piece").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "id", "first", "last", "gram")).alias("at"))
        several = one.groupBy("m").agg(F.count(F.lit(1)).alias("pieces"), F.max("n").alias("most"), F.sum(F.col("at.last") - F.col("at.first") + length).alias("bytes")).filter("pieces > 1 OR most > 1")
        pieces = table(one.join(several, "m").select("m", "piece", "n", "pieces", "bytes", "at"), "pieces")
        large = F.lit(width is not None) & (F.col("pieces") > 1) & (F.col("bytes") > shard)

        known = runs.join(pieces.filter("n > 1").select("m", "piece"), ["m", "piece"], "left_semi").select("row", "id", F.struct("first", "last", F.lit(True).alias("known"), F.lit(None).cast("long").alias("m"), F.lit(False).alias("alone")).alias("r"))
        ask = pieces.filter((F.col("pieces") > 1) & ~large).select("at.row", "at.id", F.struct("at.first", "at.last", F.lit(False).alias("known"), "m", (F.col("n") == 1).alias("alone")).alias("r"))
        marks = known if marks is None else marks.unionByName(known)
        asks = ask if asks is None else asks.unionByName(ask)
        over = pieces.filter(large)
        if width is None or over.isEmpty():
            return marks, asks
        # one of equal pieces goes on; all of them are known to be repeated
        own = over.groupBy("at.row", "at.id").agg(F.collect_list(F.struct("m", "at.first", "at.last", "at.gram")).alias("runs")).withColumnsRenamed({"row": "_row", "id": "_id"})
        once = _named_rows(base, own.select(F.col("_row").alias("row"))).filter("_may").drop("_may").join(own, (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))).dropDuplicates(["row", "id"]).select("row", "id", "text", "runs")
        runs = table(once.mapInArrow(_resplit(length, gram, width), "m long, piece binary, row long, id long, first int, last int, gram int"), "runs")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, memory: int = MEMORY, with_kept: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes)."""
    t = F.coalesce("text", F.lit(""))
    # identical rows share (row, id) and everything that follows from it
    base = docs.select(F.xxhash64("doc_id", t).alias("row"), F.col("doc_id").cast("long").alias("id"), t.alias("text"))
    with scratch(docs.sparkSession) as keep:
        marks, asks = _met(base, length, gram, shard)
        # a document's own runs: as many as its length allows
        own = keep(table(marks.unionByName(asks).groupBy("row", "id").agg(F.collect_list("r").alias("runs")), "own"))
    named = _named_rows(base, own.select("row"))
    same = (F.col("row") == F.col("_row")) & F.col("id").eqNullSafe(F.col("_id"))
    both = named.filter("_may").join(own.withColumnsRenamed({"row": "_row", "id": "_id"}), same, "left").select("row", "id", "text", "runs")
    parts = table(both.mapInArrow(_split(length), PARTS_SQL), "parts")

    asked = parts.filter("kind = 1").select("m", "row", "id", "first", "alone", "body").dropDuplicates(["m", "row", "id", "first"])
    found = asked.repartition("m").sortWithinPartitions("m").mapInArrow(_sort(length, shard, memory), "row long, id long, first int, last int")
    more = found.groupBy("row", "id").agg(F.collect_list(F.struct("first", "last")).alias("more")).withColumnsRenamed({"row": "_row", "id": "_id"})
    waiting = parts.filter("kind = 2").join(more, same, "left").select("id", "body", "known", "more")
    decided = parts.filter("kind = 0").select("id", "body", "known", F.lit(None).cast(RANGES).alias("more"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    cut = decided.unionByName(waiting).mapInArrow(_finish(length, with_kept), schema)
    # documents without a run that stands elsewhere keep all their bytes
    zero = F.lit(0).cast("long")
    whole = [F.col("id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")]
    return cut.unionByName(named.filter("NOT _may").select(*whole, *[F.col("text").cast("binary").alias("kept")] * with_kept))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))

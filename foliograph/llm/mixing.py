"""Mixing sources to target weights (DataFrame functions only).

Documents of a source, in the order of a hash of their id, form one stream of
words that is packed into blocks of a fixed number of words. The mix is a row
of slots, dealt to output shards. Every slot draws a source at random by weight
(a hash of the slot's number), so a shard's counts are a multinomial draw. The
draws of all shards miss the targets by about the root of their number; a
source's draws beyond its need, in the last shards, go to the sources that are
short, so the sums are right exactly. The slots of a source are numbered shard
by shard, and its k-th slot takes the block at place k of that source's
pseudorandom permutation of block numbers (a Feistel network with cycle
walking); slots and blocks meet in a join on (source, block). A source needed
more than once over is walked through again, and the last slot takes only the
words that are still missing.

Place numbers come from two-level prefix sums (hash bucket, then within a
bucket), so a source with a third of all rows is spread over all tasks.

Defined results: a null text has no words and is never taken; a null source is
a source of its own, last in order; rows repeated with one doc_id are documents
of their own, each with its own place; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, documents, scratch, table

BLOCK_WORDS = 1024
WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2.0
SLOTS_PER_SHARD = 4096
#: Rounds of the permutations, and the smaller of their two halves.
ROUNDS, HALF = 8, 64
#: Shards or slots whose prefix sums are taken together.
GROUP = 1024


def permuted(k: str, n: str, seed: str) -> str:
    """SQL for a pseudorandom permutation of 0 .. n-1 at place k, for any n.

    A Feistel network over pairs (below HALF, below n / HALF rounded up). Fewer
    than HALF places lie beyond n, so walking HALF steps always comes back.
    """
    high = f"greatest(1L, cast(ceil({n} / {HALF}) AS bigint))"
    low = f"pmod(t.l + pmod(xxhash64({seed}, i, t.r), {HALF}), {HALF})"
    rounds = f"aggregate(sequence(1, {ROUNDS}), struct(x % {HALF} AS l, x div {HALF} AS r), (t, i) -> struct({low} AS l, pmod(t.r + pmod(xxhash64({seed}, -i, {low}), {high}), {high}) AS r), t -> t.r * {HALF} + t.l)"
    step = rounds.replace("x %", "y %").replace("x div", "y div")
    return f"aggregate(sequence(1, {HALF}), {rounds.replace('x %', f'({k}) %').replace('x div', f'({k}) div')}, (y, z) -> CASE WHEN y < {n} THEN y ELSE {step} END)"


def running(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` in the rows before, by keys, in ``order`` (a long). In two
    levels, so that no task gets more than GROUP rows, or one row for each GROUP."""
    group = F.floor(F.col(order) / GROUP)
    sums = df.groupBy(*keys, group.alias("_g")).agg(F.sum(value).alias("_s"))
    sums = sums.select(*keys, "_g", (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_g")) - F.col("_s")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(*keys, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return df.withColumn("_g", group).withColumn(out, within).join(sums, [*keys, "_g"]).withColumn(out, F.col(out) + F.col("_before")).drop("_g", "_before")


def shard_counts(need: DataFrame, per_shard: int, seed: int) -> DataFrame:
    """shard, sid, drawn, count: the multinomial draws of each shard, and the counts whose sums are ``slots``.

    need: sid, slots.
    """
    deck = need.agg(F.sum("slots")).first()[0] or 0
    need = running(need.withColumn("_all", F.lit(0)), ["_all"], "sid", "slots", "first").drop("_all")
    cell = max(1, -(-deck // GROUP))  # draws meet the sources' ranges by cells of the deck
    ranges = need.filter("slots > 0").select("sid", "first", (F.col("first") + F.col("slots")).alias("stop"), F.explode(F.expr(f"sequence(first div {cell}L, (first + slots - 1) div {cell}L)")).alias("cell"))
    draws = need.sparkSession.range(deck).select(F.expr(f"id div {per_shard}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(1, deck))).alias("r")).withColumn("cell", F.expr(f"r div {cell}L"))
    drawn = table(draws.join(ranges, "cell").filter("r >= first AND r < stop").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("drawn")), "drawn")

    kept = running(drawn, ["sid"], "shard", "drawn", "_sofar").join(need.select("sid", "slots"), "sid")
    kept = table(kept.withColumn("kept", F.expr("greatest(0L, least(drawn, slots - _sofar))")).select("shard", "sid", "drawn", "kept"), "kept")
    free = kept.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("kept")).alias("n")).filter("n > 0")
    free = running(free.withColumn("_all", F.lit(0)), ["_all"], "shard", "n", "at")
    short = need.join(kept.groupBy("sid").agg(F.sum("kept").alias("_kept")), "sid", "left").select("sid", F.expr("slots - coalesce(_kept, 0L)").alias("n")).filter("n > 0")
    short = running(short.withColumn("_all", F.lit(0)), ["_all"], "sid", "n", "at")
    unit = lambda df, c: df.select(c, F.explode(F.expr("sequence(at, at + n - 1)")).alias("u"))
    extra = unit(free, "shard").join(unit(short, "sid"), "u").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("more"))
    both = kept.join(extra, ["shard", "sid"], "full").select("shard", "sid", F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn"), (F.coalesce("kept", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("count"))
    return table(both, "counts")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """One row per source: source, sid, source_size, target (double).

    ``share`` of all sizes is shared by weight; a target stops at ``limit`` times
    its source's size and the excess goes to the others by weight. The result is
    min(limit * size, level * weight), with the level that makes the sum right.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(order) - 1).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    per = (
        per.withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("caps", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("ws", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("caps")) / F.col("ws"))
        .withColumn("level", F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("w")))
    return per.select("source", "sid", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, block_words: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, limit: float = LIMIT, per_shard: int = SLOTS_PER_SHARD, seed: int = 1):
    """(placed, sources, slots, uses).

    placed: a row per document with its place in its source's stream.
    slots: shard, slot, sid, k, p, block, words: the mix.
    uses: shard, sid, start, p, first, last: words that a slot of pass p takes of the document there.
    """
    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    sized = table(docs.select(row.alias("_row"), "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sized")
    n = sized.count()
    sources = table(source_targets(sized, weights, share, limit).coalesce(1), "sources")

    buckets = max(1, math.isqrt(n) // 8)
    keyed = sized.join(sources.select(F.col("source").alias("_s"), "sid"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(buckets)))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("_sum"))
    before = sums.select("sid", "bucket", (F.sum("_sum").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("_sum")).alias("_base"))
    within = Window.partitionBy("sid", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("_run", F.sum("size").over(within)).join(before, ["sid", "bucket"])
    placed = table(placed.select("_row", "doc_id", "source", "size", "sid", (F.col("_base") + F.col("_run") - F.col("size")).alias("start")), "placed")

    # Slots of a source: whole passes over its n blocks, then as many blocks as the rest needs.
    t = sources.filter("source_size > 0").select("sid", "source_size", F.round("target").cast("long").alias("want"))
    t = t.withColumn("n", F.expr(f"(source_size + {block_words - 1}) div {block_words}")).withColumn("passes", F.expr("want div source_size"))
    t = t.withColumn("rest", F.expr("want - passes * source_size")).withColumn("slots", F.expr(f"passes * n + (rest + {block_words - 1}) div {block_words}"))
    t = table(t, "needs")
    counts = running(shard_counts(t.select("sid", "slots"), per_shard, seed), ["sid"], "shard", "count", "_first").filter("count > 0")
    counts = counts.withColumn("_at", F.sum("count").over(Window.partitionBy("shard").orderBy("sid")) - F.col("count"))
    slots = counts.repartition("shard").withColumn("j", F.explode(F.expr("sequence(0L, count - 1)"))).join(t.select("sid", "source_size", "n", "passes", "rest"), "sid").withColumn("k", F.expr("_first + j"))
    slots = (
        slots.withColumn("p", F.expr("k div n")).withColumn("i", F.expr("k % n"))
        # the last block may be short: it closes every pass, the others are permuted
        .withColumn("block", F.expr(f"CASE WHEN i = n - 1 THEN i ELSE {permuted('i', '(n - 1)', f'{seed}, sid, p')} END"))
        .withColumn("words", F.expr(f"least({block_words}L, source_size - block * {block_words}L, CASE WHEN p < passes THEN {block_words}L ELSE rest - i * {block_words}L END)"))
        .select("shard", F.expr(f"shard * {per_shard}L + _at + j").alias("slot"), "sid", "k", "p", "block", "words")
    )

    # Pieces of documents by block; a document of many blocks is cut into one piece for each.
    piece = placed.filter("size > 0").select("sid", "start", "size", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")).alias("block"))
    piece = piece.select("sid", "start", "block", F.expr(f"greatest(start - block * {block_words}L, 0L)").alias("lo"), F.expr(f"least(start + size - block * {block_words}L, {block_words}L)").alias("hi"))
    uses = (
        piece.join(slots.select("shard", "sid", "p", "block", "words"), ["sid", "block"])
        .filter("least(hi, words) > lo")
        .select("shard", "sid", "start", "p", F.expr(f"block * {block_words}L + lo - start").alias("first"), F.expr(f"block * {block_words}L + least(hi, words) - start").alias("last"))
    )
    return placed, sources, slots, uses


def mix_counts(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, shards (output shards with words of it)."""
    with scratch(docs.sparkSession) as keep:
        placed, sources, _, uses = mix_plan(docs, **options)
        uses = uses.groupBy("sid", "start").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.count_distinct("shard").alias("shards"))
        facts = sources.select("sid", "source_size", "target")
        out = placed.filter("size > 0").join(uses, ["sid", "start"], "left").unionByName(placed.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("shards", F.lit(0).cast("long")))
        return keep(table(out.join(facts, "sid").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.lit(0)).cast("long").alias("shards")), "mix"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents, columns as before: a row for each range of words that a pass over the
    source takes of a document. Blocks that follow each other in one document are one range, so a
    document of which a pass takes all comes whole. A range keeps the white space after its words
    (and that before the first); all ranges of a document together are its text. Documents of which
    nothing is taken go."""
    with scratch(docs.sparkSession) as keep:
        docs = keep(table(docs.withColumn("_row", F.monotonically_increasing_id()), "mixed"))
        placed, _, _, uses = mix_plan(docs, **options)
        by = Window.partitionBy("sid", "start", "p").orderBy("first")
        uses = uses.withColumn("new", F.when(F.lag("last").over(by) == F.col("first"), 0).otherwise(1)).withColumn("range", F.sum("new").over(by))
        ranges = uses.groupBy("sid", "start", "p", "range").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        ranges = ranges.groupBy("sid", "start").agg(F.collect_list(F.struct("first", "last")).alias("_ranges"))
        taken = keep(table(placed.filter("size > 0").join(ranges, ["sid", "start"]).select("_row", F.col("size").alias("_size"), "_ranges"), "taken"))
    # the words are bound to a name of a lambda, so that a text is split once for all its ranges
    split = f"regexp_extract_all(text, '(^{SPACE})?{WORD}{SPACE[:-1]}*', 0)".replace("\\", "\\\\")
    part = "CASE WHEN r.last - r.first = _size THEN text ELSE array_join(slice(w, cast(r.first + 1 AS int), cast(r.last - r.first AS int)), '') END"
    parts = f"CASE WHEN exists(_ranges, r -> r.last - r.first < _size) THEN transform(array({split}), w -> transform(_ranges, r -> {part}))[0] ELSE transform(_ranges, r -> text) END"
    out = docs.join(taken, "_row").withColumn("_text", F.explode(F.expr(parts))).withColumn("text", F.col("_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(c for c in docs.columns if c != "_row"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(documents(spark, sf_dir)).drop("source")

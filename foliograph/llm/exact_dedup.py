"""Exact dedup by deterministic block naming (DataFrame functions only).

Each text is cut into blocks of a fixed number of characters. The distinct
blocks are sorted and get integers as names; then adjacent pairs of names are
named the same way, again and again, until a document has a single name: its
identity is the number of rounds and that name. Every document gets one, and
two have the same exactly if their texts are identical.

Blocks are sorted by a 64-bit checksum, then by the block itself. A checksum
that stands once needs no text to be placed, so only blocks whose checksum comes
back travel, and they are compared in full: if several different ones share a
checksum, each gets a rank of its own among them. So no hash decides, and
nothing can collide.

Defined results: a null text is the empty text; of equal texts the largest
doc_id stays; rows repeated with one doc_id and text count in ``group_size``
and share ``kept``; a null doc_id stays only if its group has no other. Empty
tables give empty results. Only the id and text columns are read, so other
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, scratch, table

BLOCK_CHARS = 4096


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted distinct rows of integers with an increasing integer each.

    Written at once: every later read sees the same integers, also after a lost
    executor.
    """
    return table(distinct.orderBy(*keys).withColumn("_name", F.monotonically_increasing_id()), "names")


def _cut(texts: DataFrame, block_chars: int) -> DataFrame:
    """_row, _pos, _last (of its text), _sum, _block."""
    blocks = F.when(F.length("_text") <= block_chars, F.array("_text")).otherwise(F.expr(f"regexp_extract_all(_text, '(?s).{{1,{block_chars}}}', 0)"))
    cut = texts.select("_row", blocks.alias("_blocks")).select("_row", (F.size("_blocks") - 1).alias("_last"), F.posexplode("_blocks").alias("_pos", "_block"))
    return cut.select("_row", "_pos", "_last", F.xxhash64("_block").alias("_sum"), "_block")


def block_identities(texts: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(_row, _text) to (_row, _rounds, _name): equal pairs for equal texts alone. The rows' keys have to last."""
    blocks = _cut(texts, block_chars)
    sums = table(blocks.drop("_block"), "blocks")
    often = sums.groupBy("_sum").count().filter("count > 1").select("_sum")
    # different blocks that share a checksum, if any: one row for each
    several = Window.partitionBy("_sum").orderBy("_block")
    ranks = blocks.join(often, "_sum", "left_semi").select("_sum", "_block").distinct().withColumn("_tie", F.row_number().over(several) - 1)
    ranks = table(ranks.withColumn("_most", F.max("_tie").over(Window.partitionBy("_sum"))).filter("_most > 0").drop("_most"), "ranks")
    if ranks.isEmpty():
        cells = sums.withColumn("_tie", F.lit(0))
    else:
        tied = blocks.join(ranks, ["_sum", "_block"]).select("_row", "_pos", "_tie")
        cells = sums.join(tied, ["_row", "_pos"], "left").withColumn("_tie", F.coalesce("_tie", F.lit(0)))
    names = _named(cells.select("_sum", "_tie").distinct(), ["_sum", "_tie"])
    cells = table(cells.join(names, ["_sum", "_tie"]).select("_row", "_pos", "_last", "_name"), "cells")
    done, rounds = [], 0
    while True:
        done.append(cells.filter("_last = 0").select("_row", F.lit(rounds).alias("_rounds"), "_name"))
        more = cells.filter("_last > 0")
        if more.isEmpty():
            break
        pairs = (
            more.groupBy("_row", F.expr("_last div 2").cast("int").alias("_last"), F.expr("_pos div 2").cast("int").alias("_pos"))
            .agg(
                F.max(F.when(F.col("_pos") % 2 == 0, F.col("_name"))).alias("_a"),
                F.coalesce(F.max(F.when(F.col("_pos") % 2 == 1, F.col("_name"))), F.lit(-1)).alias("_b"),
            )
        )
        pairs = table(pairs, "pairs")
        names = _named(pairs.select("_a", "_b").distinct(), ["_a", "_b"])
        cells = table(pairs.join(names, ["_a", "_b"]).select("_row", "_pos", "_last", "_name"), "cells")
        rounds += 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(_row, doc_id, _text; the rows with their key), written, so that a row's key lasts."""
    rows = table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    return rows.select("_row", F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), rows


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    with scratch(docs.sparkSession) as keep:
        texts, _ = _keyed(docs.select(id_col, text_col), id_col, text_col)
        facts = texts.select("_row", "doc_id", F.sha2("_text", 256).alias("text_sha256"))
        named = keep(table(facts.join(block_identities(texts.select("_row", "_text"), block_chars), "_row"), "named"))
    groups = named.groupBy("_rounds", "_name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    shared = named.join(groups, ["_rounds", "_name"])
    return shared.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each text the row with the largest doc_id, one of them if it
    stands in several rows."""
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "_row")).alias("r")
    with scratch(docs.sparkSession) as keep:
        texts, rows = _keyed(docs, "doc_id", "text")
        keep(rows)
        named = table(texts.select("_row", "doc_id").join(block_identities(texts.select("_row", "_text")), "_row"), "named")
        stay = named.groupBy("_rounds", "_name").agg(last).select("r._row")
        out = keep(table(named.select("_row").join(stay, "_row", "left_anti"), "dropped"))
    return rows.join(out, "_row", "left_anti").select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS tx FROM documents),
g AS (SELECT tx, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY tx)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.tx) AS text_sha256
FROM t JOIN g ON t.tx = g.tx
"""

"""License scans by diagonal voting (DataFrame functions only).

Every word pair of every document is hashed and joined with the word pairs of
license templates. A hit votes for the diagonal (place in the document minus
place in the template). Votes are gathered by diagonal; diagonals next to each
other (words put in or left out) are merged into spans whose width the
template's length bounds; a span is verified by the words themselves, which the
pairs carry: its different template places are walked in order, each has to
stand behind the one before in the document, and those that do are its share of
the template. A pair that comes back again and again is one place.

The join's small side is the templates: fixed, a few hundred word pairs.

Defined results: a null text is empty; an empty text has no words, no places
and score 0; repeated rows get a row each; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, lower_ascii, table

#: Phrases whose every place counts, with their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Passages of public licenses that add labels; a span needs MIN_SHARE of the passage's pairs.
PASSAGES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("this work is licensed under a creative commons attribution", "cc-by"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
)
MIN_SHARE = 0.7
#: A span's diagonals lie within this part of its template's pairs: so many words may be put in or left out.
SLACK = 0.4
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _templates(spark: SparkSession, base, passages) -> DataFrame:
    rows = []
    for t, (phrase, label) in enumerate([*base, *passages]):
        w = phrase.split()
        rows += [(t, label, t < len(base), len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    pairs = spark.createDataFrame(rows, "t int, label string, is_base boolean, votes_all int, tpos int, w1 string, w2 string")
    # a pair's hash and, for the check, its words; all template places of a pair in one row
    return pairs.groupBy(F.xxhash64("w1", "w2").alias("h"), "w1", "w2").agg(F.collect_list(F.struct("t", "label", "is_base", "votes_all", "tpos")).alias("places"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, passages=PASSAGES, min_share: float = MIN_SHARE, slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    words = F.filter(F.split(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), NOT_WORD), lambda w: w != "")
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("words"))
    # position 0 is a row of its own for each document (no pair there), then all pairs
    shifted = F.expr("concat(array(cast(null AS string)), words)")
    pairs = d.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode(F.arrays_zip(shifted.alias("w1"), F.col("words").alias("w2"))).alias("pos", "pair"))
    pairs = pairs.select("row", "doc_id", "n_words", "pos", F.col("pair.w1").alias("w1"), F.col("pair.w2").alias("w2"))
    pairs = pairs.withColumn("h", F.when(F.col("w1").isNotNull() & F.col("w2").isNotNull(), F.xxhash64("w1", "w2")))
    hits = pairs.join(F.broadcast(_templates(spark, base, passages)), ["h", "w1", "w2"], "left").filter("places IS NOT NULL OR pos = 0")
    hits = hits.select("row", "doc_id", "n_words", (F.col("pos") - 1).alias("at"), F.explode_outer("places").alias("p"))
    template = ["row", "doc_id", "n_words", F.col("p.t").alias("t"), F.col("p.label").alias("label"), F.col("p.is_base").alias("is_base"), F.col("p.votes_all").alias("votes_all")]
    votes = hits.groupBy(*template, (F.col("at") - F.col("p.tpos")).alias("diagonal")).agg(F.count("p").alias("votes"), F.collect_list("p.tpos").alias("places"))
    votes = table(votes, "votes")  # read twice below: written, so that a row keeps its number and texts are read once
    # A base phrase stands where its diagonal has all votes. Passages: each diagonal with those up to the slack behind it is a span.
    by = Window.partitionBy("row", "t").orderBy("diagonal")
    place = F.expr("transform(places, x -> struct(x AS tpos, x + diagonal AS at))")
    spans = votes.withColumn("_run", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(by) <= F.col("votes_all") * slack, 0).otherwise(1)).over(by))
    wide = spans.filter("NOT is_base").groupBy("row", "t", "_run").agg(F.array_sort(F.flatten(F.collect_list(place))).alias("_all"))
    spans = spans.join(wide, ["row", "t", "_run"], "left").withColumn("_near", F.expr(f"filter(_all, x -> x.at - x.tpos BETWEEN diagonal AND diagonal + votes_all * {slack})"))
    enough = F.size(F.array_distinct(F.expr("transform(_near, x -> x.tpos)"))) >= F.col("votes_all") * min_share
    walked = F.expr("aggregate(_near, struct(0 AS n, -1 AS tpos, cast(-1 AS bigint) AS at), (s, x) -> CASE WHEN x.tpos > s.tpos AND x.at > s.at THEN struct(s.n + 1 AS n, x.tpos AS tpos, cast(x.at AS bigint) AS at) ELSE s END, s -> s.n)")
    share = F.when(F.col("is_base"), F.col("votes") / F.col("votes_all")).otherwise(F.coalesce(F.when(enough, walked), F.lit(0)) / F.col("votes_all"))
    spans = spans.select("row", "doc_id", "n_words", "label", "is_base", F.col("diagonal").alias("start"), F.coalesce(F.col("is_base") & (F.col("votes") >= F.col("votes_all")), F.lit(False)).alias("found"), share.alias("share"))
    spans = spans.withColumn("added", F.coalesce(F.col("share") >= min_share, F.lit(False)) & (F.col("found") | ~F.coalesce(F.col("is_base"), F.lit(False))))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        spans.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count(F.when(F.col("found"), 1)).alias("n_base"),
            F.min(F.when(F.col("found"), F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(F.col("found"), F.col("start"))).cast("long").alias("last_word"),
            labels(F.col("found")).alias("base_labels"),
            labels(F.col("added")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("added"), F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))

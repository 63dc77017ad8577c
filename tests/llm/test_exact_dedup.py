"""Block names: long texts that differ in one place, shared checksums, rows that share a doc_id."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliograph.llm import exact_dedup


def identities(spark, texts, **options):
    rows = exact_dedup.table(spark.createDataFrame(list(enumerate(texts)), "_row long, _text string"), "rows")
    return {r["_row"]: (r["_rounds"], r["_name"]) for r in exact_dedup.block_identities(rows, **options).collect()}


def test_every_text_has_one_name(spark):
    rng = np.random.default_rng(2)
    texts = ["", "a", "ä", "a" * 8, "a" * 9, "é" * 8, "\n" * 17]
    for _ in range(60):
        t = "".join(rng.choice(list("ab"), int(rng.integers(1, 70))))
        texts += [t, t, t[:-1] + "c", "c" + t[1:]]
    got = identities(spark, texts, block_chars=8)
    assert len(got) == len(texts)
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(got[i], set()).add(t)
    assert all(len(x) == 1 for x in same.values()) and len(same) == len(set(texts))


def test_shared_checksums(spark, monkeypatch):
    """With a checksum of four values blocks are told apart by themselves."""
    cut = exact_dedup._cut
    monkeypatch.setattr(exact_dedup, "_cut", lambda texts, n: cut(texts, n).withColumn("_sum", F.pmod("_sum", F.lit(4))))
    texts = ["".join(x) for x in np.random.default_rng(3).choice(list("ab"), (200, 20))] + ["", "a"]
    got = identities(spark, texts, block_chars=6)
    assert len({got[i] for i in range(len(texts))}) == len(set(texts))
    assert Counter(texts).keys() == {texts[i] for i in got}


def test_drop_by_row(spark):
    rows = [(1, "A", 1), (2, "A", 2), (1, "B", 3), (None, "C", 4), (3, "C", 5), (4, "D", 6), (4, "D", 6), (None, "E", 7), (None, "E", 7), (5, None, 8), (6, "", 9)]
    t = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = sorted(map(tuple, exact_dedup.drop_exact_duplicates(t).collect()), key=lambda r: r[2])
    assert got == [rows[1], rows[2], rows[4], rows[5], rows[7], rows[10]]
    assert exact_dedup.drop_exact_duplicates(t.limit(0)).count() == 0

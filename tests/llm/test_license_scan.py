"""Base columns against brute force; labels of the method on planted passages, and none elsewhere."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from foliograph.llm import license_scan
from foliograph.llm.common import documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text: str | None) -> tuple:
    w = [x for x in re.split(license_scan.NOT_WORD, (text or "").translate(LOWER)) if x]
    hits = [(i, label) for phrase, label in license_scan.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in hits}))


@pytest.fixture(scope="module")
def scanned(spark):
    def scan(texts):
        t = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return {r.doc_id: r for r in license_scan.scan_licenses(t).collect()}

    return scan


def test_base_columns(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    more = ["MIT License, mit license; CC-BY cc by", "the GNU General Public License\nApache License", "general public license", None, "", "é MIT\tLicense é"]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, x) for i, x in enumerate(more)] + [(10**6, more[0]), (None, "cc by")], "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan_licenses(docs).collect())
    assert got == Counter((r.doc_id, *base(r.text)) for r in docs.collect())


def test_planted(scanned):
    """Passages between other words, with words put in, left out and changed, are found; base labels stay."""
    rng = np.random.default_rng(6)
    texts, want = [], []
    for k, (passage, label) in enumerate(license_scan.PASSAGES * 3):
        w = passage.split()
        if k >= len(license_scan.PASSAGES):
            w.insert(int(rng.integers(1, len(w))), "newword")
        if k >= 2 * len(license_scan.PASSAGES) and len(w) > 14:
            del w[int(rng.integers(1, len(w) - 1))]
        noise = [" ".join(f"n{rng.integers(999)}" for _ in range(50)) for _ in range(2)]
        texts.append(f"{noise[0]} {' '.join(w).title()} {noise[1]}")
        want.append(label)
    got = scanned(texts)
    assert all(label in got[i].labels.split(",") and got[i].score >= 0.7 for i, label in enumerate(want))
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got.values())


def test_no_false_labels(scanned):
    rng = np.random.default_rng(8)
    texts = ["of the x " * 40, "free software " * 20, "terms of the " * 60, "the license you may not use " * 3]
    for passage, _ in license_scan.PASSAGES:
        w = passage.split()
        texts += [" ".join(reversed(w)), " ".join(rng.permutation(w)), " ".join(w[: len(w) // 2]), " ".join(f"{a} {b} {'pad ' * 30}" for a, b in zip(w[::2], w[1::2], strict=False))]
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        texts.append(" and then ".join(reversed(pairs)))
    got = scanned(texts)
    assert [texts[i] for i, r in got.items() if r.labels != r.base_labels] == []


def test_base_sql(spark):
    """The base columns in DuckDB's SQL, over all documents of sf0.01."""
    words = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    hits = " UNION ALL ".join(f"SELECT d.row, i AS at, '{label}' AS label FROM d, unnest(range(len(w) - {len(p.split()) - 1})) AS u(i) WHERE w[i + 1 : i + {len(p.split())}] = {p.split()}" for p, label in license_scan.BASE)
    sql = f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM '/root/testdata/sf0.01/documents.parquet'), h AS ({hits})
        SELECT doc_id, len(any_value(w)), count(h.at), min(h.at), max(h.at), coalesce(array_to_string(list_sort(list_distinct(list(h.label) FILTER (h.label IS NOT NULL))), ','), '')
        FROM d LEFT JOIN h USING (row) GROUP BY row, doc_id"""
    got = license_scan.scan_licenses(documents(spark, "/root/testdata/sf0.01")).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter(duckdb.sql(sql).fetchall())

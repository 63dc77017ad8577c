"""Every stage of the pipeline, on what its predecessor kept, against a brute-force version."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from foliograph.llm.common import documents, table
from foliograph.llm.language_id import LEAST_SCORE, fit_language_net
from foliograph.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
NAMES = ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]


@pytest.fixture(scope="module")
def stages(spark):
    """name: (rows in, rows out); the fixture adds an exact copy, a near copy, nulls and a text without letters."""
    docs = documents(spark, SF)
    base = next(r for r in docs.orderBy("doc_id").collect() if r.text and len(r.text.split()) > 200)
    top = docs.agg({"doc_id": "max"}).first()[0]
    planted = [
        (top + 1, base.text),
        (top + 2, base.text + " epilogue"),
        (top + 3, None),
        (top + 4, ""),
        (top + 5, "12 34 . ?"),
    ]
    rows = [base.asDict() | {"doc_id": d, "text": t, "n_chars": len(t or "")} for d, t in planted]
    rows[1]["source"] = rows[3]["source"] = None
    rows[4]["lang"] = None
    docs = table(docs.unionByName(spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)), "documents")
    columns, out = docs.columns, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    for name, stage in corpus_pipeline.STAGES:
        kept = table(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), kept.collect())
        if name != NAMES[-1]:
            assert kept.columns == columns
        docs = kept
    return out


def test_language_stage(spark, stages):
    before, after = stages["language_id"]
    net = fit_language_net(spark.createDataFrame(before, documents(spark, SF).schema))
    want = []
    for r in before:
        if r.text and re.search(r"[^\W\d_]", r.text):
            raw = np.frombuffer(r.text.encode(), np.uint8)
            # float32 sums differ by place in a batch: only scores clear of the limit are held to it
            if net.predict(raw, np.array([0, len(raw)])).max() >= LEAST_SCORE:
                want.append(r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(want)
    assert len(want) > 0.8 * len(before)


def test_exact_stage(stages):
    before, after = stages["exact_dedup"]
    keep = {}
    for r in before:
        keep[r.text] = max(keep.get(r.text, -1), r.doc_id)
    assert sorted(after) == sorted(r for r in before if r.doc_id == keep[r.text])
    assert len(after) < len(before)


def test_near_stage(stages):
    before, after = stages["near_dedup"]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in before:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(lower))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert sorted(after) == sorted(r for r in before if root(r.doc_id) == r.doc_id)
    assert len(after) < len(before)


def test_mixing_stage(stages):
    before, after = stages["mixing"]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    size = Counter()
    for r in before:
        size[r.source] += count(r.text)
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(size.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        for s in over or free:
            target[s] = 2.0 * size[s] if over else share[s]
            left -= target[s]
        free -= over or set(free)
    taken, by_doc = Counter(), defaultdict(list)
    for r in after:
        taken[r.source] += count(r.text)
        by_doc[r.doc_id].append(r)
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    texts = {r.doc_id: r for r in before}
    for d, rows in by_doc.items():
        own = texts[d].text.split()
        whole = [r for r in rows if r.text == texts[d].text]
        rest = [r for r in rows if r.text != texts[d].text]
        assert len(rest) <= 1 and sum(count(r.text) for r in rows) <= 2 * count(texts[d].text)
        assert len(whole) + len(rest) == len(rows)
        assert all(re.findall(r"[^\x20\x09-\x0D]+", r.text) == re.findall(r"[^\x20\x09-\x0D]+", texts[d].text)[: count(r.text)] for r in rest), own[:5]
        assert all((r.source, r.lang) == (texts[d].source, texts[d].lang) for r in rows)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    before, after = stages["packing"]
    tokenizer, want = Tokenizer.from_file(vocabulary("byte_bpe_50k.json")), Counter()
    for r in before:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = list(range(len(ids), 0, -2048))[::-1]
        at = 0
        for k, stop in enumerate(cuts):
            want[r.doc_id, k, at, stop - at, zlib.crc32(ids[at:stop].tobytes())] += 1
            at = stop
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
    sequences = defaultdict(list)
    for r in after:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.02 * sum(r.length for r in after) / 2048 + 2

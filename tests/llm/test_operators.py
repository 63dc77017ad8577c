"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foliograph.llm import ann, chat_format, exact_dedup, induced_sort, language_id, license_scan, mixing, near_dup, packing, suffix_dedup, token_files
from foliograph.llm.tokens import vocabulary

LONG = "alpha beta gamma delta epsilon zeta " * 400
TEXTS = [None, "", LONG, LONG, LONG + "eta", "Released under the MIT License.", "one two", "one two", "123 . ?", "été là où", None]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, row long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 3 else "en", None if i % 4 == 0 else f"s{i % 3}", len(t or ""), 1, 0.5, True, 9) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[2], (None, "one two", "en", "s1", 7, 1, 0.5, True, 9)], SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs, texts, empty):
    got = exact_dedup.exact_duplicates(docs, block_chars=7).collect()
    size, keep = Counter(t for _, t in texts), {}
    for d, t in texts:
        keep[t] = max(keep.get(t, -1), -1 if d is None else d)
    want = Counter((d, keep[t], size[t], d == keep[t], hashlib.sha256(t.encode()).hexdigest()) for d, t in texts)
    assert Counter(map(tuple, got)) == want
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_near_dedup(docs, texts, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs.select("doc_id", "text"), 3, 85, 100).collect()}
    assert {(2, 6, 2), (3, 6, 2), (4, 7, 2), (6, 1, 6), (7, 1, 6), (0, 0, 0), (1, 0, 1)} <= got
    assert near_dup.near_duplicates(empty.select("doc_id", "text")).count() == 0


def test_suffix_dedup(docs, texts, empty):
    got = suffix_dedup.remove_repeats(docs.select("doc_id", "text"), length=40, gram=8).collect()
    seen = Counter(b[i : i + 40] for _, t in texts for b in [t.encode()] for i in range(len(b) - 39))
    want = Counter()
    for d, t in texts:
        b, mask = t.encode(), np.zeros(len(t.encode()), bool)
        for i in range(len(b) - 39):
            if seen[b[i : i + 40]] > 1:
                mask[i : i + 40] = True
        kept = bytes(c for c, m in zip(b, mask, strict=True) if not m)
        want[d, len(b), int(mask.sum()), int((mask & ~np.r_[False, mask[:-1]][: len(mask)]).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want
    assert suffix_dedup.remove_repeats(empty.select("doc_id", "text")).count() == 0


@pytest.mark.parametrize("shared", [8, 30, 38, 60])
def test_suffix_hot_key(spark, shared):
    """A passage with other neighbours in every text: no key has more than a shard, and the result is that of one shard."""
    rng = np.random.default_rng(shared)
    word = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
    passage, ends = word(shared), [word(60) for _ in range(6)]
    rows = [(i, word(int(rng.integers(0, 60))) + (ends[i % 6] if i % 3 else word(20)) + passage + (ends[i % 5] if i % 2 else word(30))) for i in range(80)]
    docs = spark.createDataFrame([*rows, rows[3]], "doc_id long, text string")
    base = docs.selectExpr("xxhash64(doc_id, text) AS row", "doc_id AS id", "text")
    most = lambda shard: max((r[1] for r in suffix_dedup._met(base, 40, 8, shard)[1].selectExpr("r.m", "r.last - r.first + 40 AS b").groupBy("m").sum("b").collect()), default=0)
    assert most(300) <= 300 < most(1 << 30)
    seen = Counter(t[i : i + 40] for _, t in [*rows, rows[3]] for i in range(len(t) - 39))
    got = {(r.doc_id, r.n_removed, r.kept) for r in suffix_dedup.remove_repeats(docs, length=40, gram=8, shard=300, with_kept=True).collect()}
    want = set()
    for d, t in rows:
        gone = {j for i in range(len(t) - 39) if seen[t[i : i + 40]] > 1 for j in range(i, i + 40)}
        want.add((d, len(gone), "".join(c for j, c in enumerate(t) if j not in gone).encode()))
    assert {(d, n, bytes(k)) for d, n, k in got} == want


@pytest.mark.parametrize("memory", [200, 1 << 20])
def test_induced_sort(memory):
    rng = np.random.default_rng(3)
    for _ in range(200):
        t, d = rng.integers(0, 4, rng.integers(1, 80)), int(rng.integers(1, 9))
        windows = [tuple(t[i : i + d]) for i in range(len(t) - d + 1)]
        got = induced_sort.repeated_starts(t, d, memory)
        assert all(got[i] == (windows.count(w) > 1) for i, w in enumerate(windows) if 0 not in w)


def test_mixing(docs, texts, empty):
    got = mixing.mix_counts(docs, block_words=16).collect()
    assert len(got) == len(texts) and all(0 <= r.taken <= 2 * r.size for r in got)
    by = Counter()
    for r in got:
        by[r.source] += r.taken
    assert all(abs(by[r.source] - r.target) <= 1 for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert mixing.mix_documents(docs.filter("doc_id is not null")).columns == docs.columns
    assert mixing.mix_counts(empty).count() == 0


def test_mixing_ranges(spark):
    """The words of the mix are those of the drawn blocks, with their white space, and not a prefix as long."""
    rng = np.random.default_rng(11)
    gaps = [" ", "\n", "  ", "\r\n\t"]
    rows = [(i, "\n " * (i % 2) + "".join(f"d{i}w{j}{gaps[rng.integers(4)]}" for j in range(int(rng.integers(1, 200))))) for i in range(40)]
    t, texts = spark.createDataFrame([(i, x, f"s{i % 3}") for i, x in rows], "doc_id long, text string, source string"), dict(rows)
    words = lambda x: re.findall(mixing.WORD, x)
    placed, _, slots, _ = mixing.mix_plan(t, block_words=16)
    stream = {}
    for r in placed.orderBy("sid", "start").collect():
        stream.setdefault(r.sid, []).extend(words(texts[r.doc_id]))
    want = Counter(x for r in slots.collect() for x in stream[r.sid][r.block * 16 : r.block * 16 + r.words])
    got = mixing.mix_documents(t, block_words=16).collect()
    assert Counter(x for r in got for x in words(r.text)) == want
    assert all(r.text in texts[r.doc_id] for r in got)
    assert any(not texts[r.doc_id].startswith(r.text) for r in got)


def test_licenses(docs, texts, empty):
    got = license_scan.scan_licenses(docs).collect()
    words = lambda t: [w for w in re.split(license_scan.NOT_WORD, t) if w]
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((d, len(words(t.lower()))) for d, t in texts)
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels) for r in got if r.doc_id == 5] == [(1, 3, 3, "mit")]
    assert license_scan.scan_licenses(empty).count() == 0


def test_tokens(spark, docs, texts, empty, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    token_files.write_token_files(docs, f"file://{tmp_path}/t", path)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    t, at, want = Tokenizer.from_file(path), 0, []
    for d, text in sorted(texts, key=lambda x: (x[0] is not None, x[0])):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [tuple(r) for r in got] == want
    token_files.write_token_files(empty, f"file://{tmp_path}/e", path)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("name, keeps_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens(name, keeps_space):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from foliograph.llm.tokens import WordEncoder

    t = Tokenizer.from_file(vocabulary(name))
    texts = ["a<|endoftext|>b", "one two", "", "x <|startoftext|> y <|EndOfText|>\nz", "<|endoftext|>", "no <| endoftext |> here", "end"]
    ids, ends = WordEncoder(vocabulary(name), keeps_space).encode(pa.array(texts, pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_packing(docs, empty):
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json"), length=64).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length).tolist()[:-1]] and g.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 1
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json")).count() == 0


def test_language(docs, empty):
    got = language_id.identify(docs.select("doc_id", "text", "lang"), per_lang=20).collect()
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 8, 10)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert language_id.identify(empty.select("doc_id", "text", "lang")).count() == 0
    assert language_id.keep_known_language(docs).columns == docs.columns


def test_search(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(200)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [None] * 16), (206, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(v, v.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0][:2] == [200, 201]
    for q in (50, 100, 150):
        x = np.array([r[1] for r in rows[:202]])
        s = ann.exact(x[q], x)
        order = [i for i in np.lexsort((np.arange(202), -s)) if i != q][:5]
        assert [r.vec_id for r in got if r.query_id == q] == order
    assert ann.nearest(v.limit(0), v.limit(0)).count() == 0


def test_chat(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "a", "x"), (1, 2, "b", None), (1, 2, None, "z"), (2, 0, "system", "s")], "conv_id long, turn long, role string, text string")
    got = chat_format.render_dialogues(t).collect()
    assert {(r.conv_id, r.speaker) for r in got} == {(1, "a"), (1, "b"), (1, "unknown")}
    for r in got:
        assert all(r.dialogue[m.train_start : m.train_end].endswith("<|end|>") for m in r.masks)
    assert chat_format.rotate_perspectives(t.limit(0)).count() == 0


def test_chat_spans(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "SPAN", 4)
    rng = np.random.default_rng(5)
    people, turns = ["system", "ann", "bo", None], [None, -9, *range(40)]
    rows = [(int(rng.integers(3)), turns[rng.integers(len(turns))], people[rng.integers(4)], [None, "", "x" * int(rng.integers(9))][rng.integers(3)]) for _ in range(400)]
    rows += [rows[0], rows[0], (None, 1, "ann", "lost")]
    got = chat_format.rotate_perspectives(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = Counter()
    for conv in range(3):
        own = sorted((t is not None, t or 0, n or "unknown", b or "") for c, t, n, b in rows if c == conv)
        for speaker in {n for _, _, n, _ in own} - {"system"}:
            at = 0
            for seq, (known, t, n, b) in enumerate(own):
                mine = n == speaker
                head = "<|assistant|>\n" if mine else "<|system|>\n" if n == "system" else f"<|user name={n}|>\n"
                segment = f"{head}{b}<|end|>\n"
                end = at + len(segment)
                role = "assistant" if mine else "system" if n == "system" else "user"
                want[conv, speaker, t if known else None, seq, role, segment, at, end, at + len(head) if mine else None, end - 1 if mine else None, mine] += 1
                at = end
    assert Counter(map(tuple, got)) == want

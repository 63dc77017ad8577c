"""Near-dedup against brute force: groups of near copies, chains, pairs close to the threshold, repeated ids."""

import re

import numpy as np
import pytest

from foliograph.llm import near_dup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text: str | None, size: int) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple], size: int, num: int, den: int) -> set:
    sets = [shingles(t, size) for _, t in rows]
    distinct = list(dict.fromkeys(s for s in sets if s))
    ids: dict = {}
    coded = [np.unique([ids.setdefault(x, len(ids)) for x in s]) for s in distinct]
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    here = np.zeros(len(ids), bool)
    for i, x in enumerate(coded):
        here[x] = True
        for j in range(i):
            both = int(here[coded[j]].sum())
            if den * both >= num * (len(x) + len(coded[j]) - both):
                parent[root(i)] = root(j)
        here[x] = False
    at, least = {s: root(k) for k, s in enumerate(distinct)}, {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            least[at[s]] = min(least.get(at[s], d), d)
    got = set()
    for (d, _), s in zip(rows, sets, strict=True):
        c = least.get(at[s]) if s else d
        got.add((d, len(s), c, d == c))
    return got


def corpus(seed: int, copies: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(40_000)}"
    texts = []
    for n, times, edits in ((300, copies, 9), (120, copies // 4, 4), (700, copies // 8, 22), (40, 30, 1), (5, 10, 1), (2, 5, 0)):
        base = [word() for _ in range(n)]
        for _ in range(times):
            own = list(base)
            for at in rng.integers(0, n, rng.integers(0, edits + 1)):
                own[at] = word()
            texts.append(" ".join(own))
    chain = [word() for _ in range(200)]
    for _ in range(25):  # each near the one before only
        chain = chain[8:] + [word() for _ in range(8)]
        texts.append("\n".join(chain).upper())
    texts += [" ".join(word() for _ in range(rng.integers(1, 80))) for _ in range(60)] + [None, "", " \n", "\x00 \x1c"]
    ids = rng.permutation(len(texts)).tolist()
    rows = list(zip(ids, texts, strict=True))
    return [*rows, rows[0], rows[0], (None, rows[1][1]), (None, "only here without an id"), (rows[2][0], rows[3][1])]


@pytest.mark.parametrize("size, num, den, cut", [(3, 85, 100, 1024), (5, 80, 100, 24)])
def test_every_column(spark, monkeypatch, size, num, den, cut):
    """cut: small blocks, so that lists meet in many parts."""
    monkeypatch.setattr(near_dup, "LIST", cut)
    monkeypatch.setattr(near_dup, "COMMON", min(48, cut // 2))
    rows = corpus(size, 1000 if cut > 100 else 200)
    t = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in near_dup.near_duplicates(t, size, num, den).collect()}
    assert got == brute(rows, size, num, den)


def test_drop_by_row(spark):
    """Ids that stand in several rows, rows repeated whole, null ids and a clashing column."""
    a, b, c = ("alpha " * 3 + "beta gamma delta epsilon zeta eta theta iota kappa lambda " * 3, "one two three four five six seven", "")
    rows = [(1, a, 1), (1, b, 2), (None, a, 3), (2, a + "mu", 4), (2, a + "mu", 4), (4, c, 5), (4, None, 6), (None, "lone words without any id here", 7)]
    t = spark.createDataFrame(rows, "doc_id long, text string, comp long")
    got = sorted(map(tuple, near_dup.drop_near_duplicates(t, 3, 60, 100).collect()), key=lambda r: r[2])
    assert got == [rows[0], rows[1], rows[5], rows[6], rows[7]]
    assert near_dup.drop_near_duplicates(t.limit(0)).count() == 0

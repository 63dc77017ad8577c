"""Permutations, the draws of shards, and every document's taken words against a walk over the slots."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliograph.llm import mixing


@pytest.mark.parametrize("n", [1, 2, 3, 63, 64, 65, 1000, 4097])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(F.expr(mixing.permuted("id", f"{n}L", "7, id * 0"))).collect()]
    assert sorted(got) == list(range(n))
    if n >= 1000:  # steps between neighbours are as spread as those of a shuffle
        steps = np.diff(got) % n
        assert len(set(steps.tolist())) > 0.5 * n
        assert abs(np.corrcoef(range(n), got)[0, 1]) < 0.15


def test_large_numbers(spark):
    n = 1 << 50
    got = [r[0] for r in spark.range(2000).select(F.expr(mixing.permuted("id + 1000000000000", f"{n}L", "7"))).collect()]
    assert len(set(got)) == 2000 and 0 <= min(got) and max(got) < n


def test_shard_draws(spark):
    """Counts are multinomial (as spread as independent draws), and their sums are the needs exactly."""
    need = {0: 20_000, 1: 10_000, 2: 9_000, 3: 1_000, 4: 1}
    got = mixing.shard_counts(spark.createDataFrame(list(need.items()), "sid int, slots long"), 100, 3).collect()
    deck = sum(need.values())
    for sid, n in need.items():
        assert sum(r["count"] for r in got if r.sid == sid) == n
    per = Counter()
    for r in got:
        per[r.shard] += r["count"]
    assert all(per[k] == min(100, deck - 100 * k) for k in range(-(-deck // 100)))
    for sid in (0, 1, 2):
        p = need[sid] / deck
        drawn = {r.shard: r.drawn for r in got if r.sid == sid}
        draws = [drawn.get(k, 0) for k in range(deck // 100)]
        assert np.mean(draws) == pytest.approx(100 * p, rel=0.04)
        assert np.var(draws) == pytest.approx(100 * p * (1 - p), rel=0.25)
        changed = sum(r.drawn != r["count"] for r in got if r.sid == sid)
        assert changed < 0.1 * len(draws)


def test_taken(spark):
    rng = np.random.default_rng(4)
    sources = ["a", "b", None, "only one"]
    rows = [(int(i), " ".join(["w"] * int(rng.integers(0, 400))), sources[rng.integers(3)]) for i in rng.integers(0, 90, 120)]
    rows += [rows[0], (None, "x y", "a"), (None, "x y z", "a"), (1, None, "b"), (500, "once", "only one")]
    t = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"block_words": 16, "per_shard": 32}
    placed, sources_, slots, _ = mixing.mix_plan(t, **options)
    use = Counter()
    words = {}
    for r in slots.collect():
        assert r.slot // 32 == r.shard
        words[r.slot] = r.words
        for w in range(r.block * 16, r.block * 16 + r.words):
            use[r.sid, w] += 1
    assert sorted(words) == list(range(len(words)))
    docs = placed.collect()
    want = Counter((d.doc_id, d.source, d.size, sum(use[d.sid, w] for w in range(d.start, d.start + d.size))) for d in docs)
    got = mixing.mix_counts(t, **options).collect()
    assert Counter((r.doc_id, r.source, r.size, r.taken) for r in got) == want
    assert Counter((d, s, n) for d, s, n, _ in want.elements()) == Counter((d, s, len(re.findall(mixing.WORD, x or ""))) for d, x, s in rows)
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 2 * r.size and (r.shards > 0) == (r.taken > 0)
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    again = Counter(map(tuple, mixing.mix_counts(t, **options).collect()))
    assert again == Counter(map(tuple, got))
    assert sources_.count() == 4

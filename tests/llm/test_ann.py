import numpy as np

from foliograph.llm import ann

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, query, k):
    x = dict(rows)
    unit = {i: np.array(v) / np.abs(v).max() for i, v in rows}
    unit = {i: v / np.sqrt((v * v).sum()) for i, v in unit.items()}
    return [i for i, _ in sorted(((i, float(unit[i] @ unit[query])) for i in x if i != query), key=lambda p: (-p[1], p[0]))[:k]]


def test_extreme_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=16) * [1.0, 1e200, 1e-200, 1e-300][i % 4]).tolist()) for i in range(200)]
    v = spark.createDataFrame(rows, SCHEMA)
    got = ann.nearest(v, v.filter("vec_id % 10 < 4"), block=9).collect()
    for q in (i for i in range(200) if i % 10 < 4):
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == brute(rows, q, 5)
    assert all(-1 - 1e-9 <= r.score <= 1 + 1e-9 for r in got)


def test_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(300)]
    near = np.array(rows[0][1])
    rows[7] = (7, (near + 0.01).tolist())
    v = spark.createDataFrame(rows + [rows[7]] * 50, SCHEMA).coalesce(1)
    got = ann.nearest(v, v.filter("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == brute(rows, 0, 5)


def test_clashing_columns(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0], i, 0.5, i) for i in range(1, 6)], SCHEMA + ", query_id long, score double, rank int")
    got = ann.nearest(v, v.filter("vec_id = 3"), k=9).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [4, 5, 2, 1] and [r["rank"] for r in got] == [1, 2, 3, 4]

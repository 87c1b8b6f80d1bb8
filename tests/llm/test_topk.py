import random

import numpy as np
import pytest

from plainfold.llm.topk import Best, top_k


def brute(rows, k=5, every=50):
    vec = {}
    for i, x in rows:
        if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            vec[i] = [int(np.floor(256 * float(np.float32(v)))) for v in x]
    out = {}
    for q in (i for i in vec if i % every == 0):
        score = sorted((-sum(a * b for a, b in zip(vec[q], x)), i) for i, x in vec.items() if i != q)[:k]
        out |= {(q, n + 1): (i, -s) for n, (s, i) in enumerate(score)}
    return out


@pytest.mark.parametrize("seed, block, scale", [(1, 4096, 1.0), (2, 3, 1.0), (3, 4096, 1e6)])
def test_equals_brute_force(spark, seed, block, scale):
    rng = random.Random(seed)
    rows = [(i, [scale * rng.uniform(-1, 1) for _ in range(10)]) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(30)] + [(1000 + 50 * i, [0.0] * 10) for i in range(3)]
    rows += [(2000, None), (2050, [None] * 10), (2100, [float("nan")] * 10), (2150, [float("inf")] + [0.0] * 9), (None, [1.0] * 10), (2200, [0.5]), (2250, []), rows[7]]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df, block=block).collect()}
    assert got == brute(rows)


def test_fewer_than_k(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df).collect()] == [(0, 1, 1, 65536)]
    assert top_k(df.limit(0)).collect() == []


def test_the_cutoff_saves_products():
    """Of the products that every entry with every query takes, by the floor that the first entries give."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 64)) * rng.lognormal(0, 1, (20_000, 4)).repeat(16, axis=1)
    x = np.floor(256 * x / 10)
    ids, q = np.arange(len(x)), x[::400]
    cuts, whole = np.array_split(np.arange(64), 4), x.size * len(q)
    first = Best(ids[::400], 5)
    first.all_of(ids[:256], x[:256], q)
    assert first.products == 256 * q.size
    best = Best(ids[::400], 5, [s[-1] for _, s in first.kept])
    for i in range(0, len(x), 512):
        best.collect(ids[i : i + 512], x[i : i + 512], q, cuts)
    print(f"{(first.products + best.products) / whole:.2f} of the products")
    assert first.products + best.products < 0.5 * whole
    for j, i in enumerate(ids[::400]):
        score = x @ q[j]
        order = [int(v) for v in np.lexsort((ids, -score)) if v != i][:5]
        assert best.kept[j][0].tolist() == order and best.kept[j][1].tolist() == score[order].tolist()


def test_large_finite_doubles(spark):
    rows = [(0, [1e308, -3.5]), (1, [1e300, 0.25]), (2, [-1e308, 2.0]), (3, [0.5, 0.5]), (4, [2.0**44 + 0.5, 0.0])]
    vec = {i: [int(np.floor(256 * v)) if abs(v) < 1e12 else int(v) * 256 + int((v - int(v)) * 256) for v in x] for i, x in rows}
    cap = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = sorted((-cap(sum(a * b for a, b in zip(vec[0], vec[i]))), i) for i in vec if i)
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in want]

import math
import random

import pytest

from factloom.llm import topk
from factloom.llm.topk import scaled, top_k


def brute(rows, is_query, k):
    fine = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, x in fine:
        if is_query(q):
            scores = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in fine if i != q))[:k]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores)}
    return out


def data():
    rng = random.Random(6)
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), 0.0, 1.0, -1.0]) for _ in range(12)]) for i in range(700)]
    rows += [(800 + i, rows[3][1]) for i in range(60)]
    return rows + [(900, None), (920, [None] * 12), (940, [float("nan")] * 12), (960, [float("inf")] + [0.0] * 11), (980, [0.0] * 12), (None, [0.1] * 12)]


def test_equals_brute_force(spark, monkeypatch):
    rows = data()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    vectors = scaled(df)
    for k, block in ((20, 2_000_000), (3, 100)):
        monkeypatch.setattr(topk, "BLOCK_NUMBERS", block)
        query = (lambda q: q % 20 == 0) if k == 20 else (lambda q: q % 100 == 0)
        asked = vectors.where("vec_id % 20 = 0" if k == 20 else "vec_id % 100 = 0")
        got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(vectors, asked, k).collect()}
        assert got == brute(rows, query, k)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5])], "vec_id long, embedding array<float>")
    v = scaled(df)
    assert [tuple(r) for r in top_k(v, v.where("vec_id = 0"), 20).collect()] == [(0, 1, 1, 64 * 32)]
    assert top_k(v.where("false"), v.where("false"), 20).count() == 0
    assert top_k(v, v.where("false"), 20).count() == 0


def test_large_components_are_exact(spark):
    """Scores beyond 2**53, among them two that are equal as doubles, and components beyond 2**31."""
    rows = [(20, [2.0**24, 1.0]), (1, [2.0**24, 2.0**24 - 1]), (2, [2.0**24, 2.0**24 - 1 + 1 / 64]), (3, [2.0**26, 0.0]), (4, [0.0, 0.5]), (5, [-(2.0**20), 3.0]), (40, [1e-3, 2.0**50])]
    v = scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert v.count() == len(rows)
    for k in (1, 2, 20):
        got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(v, v.where("vec_id = 20"), k).collect()}
        assert got == brute(rows, lambda q: q == 20, k)
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-(2**29), 2**29) / 64 for _ in range(6)]) for i in range(300)]
    v = scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2))
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(v, v.where("vec_id % 20 = 0"), 20).collect()} == brute(rows, lambda q: q % 20 == 0, 20)


def test_beyond_a_long_raises(spark):
    v = scaled(spark.createDataFrame([(20, [2.0**40]), (1, [2.0**40])], "vec_id long, embedding array<double>"))
    with pytest.raises(Exception, match="beyond a long"):
        top_k(v, v.where("vec_id = 20"), 20).collect()
    with pytest.raises(Exception, match="beyond a long"):
        scaled(spark.createDataFrame([(20, [1e300])], "vec_id long, embedding array<double>")).collect()

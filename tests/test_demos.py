import math
import random

import numpy as np
import pytest

from factloom.demos import deduction, predictive, puzzle
from factloom.operators import aggregate, guard
from factloom.operators.tensor import derivative, deviation, einsum
from factloom.plans.fixpoint import closure, meet, naive, recursive_closure, semi_naive
from factloom.streaming.closure import StreamedClosure


def test_derivations_and_guarded_closure(spark):
    counted = deduction.count_derivations(spark, deduction.AXIOMS, 5)
    assert {r.k: int(r.n) for r in counted.groupBy("k").sum("n").toDF("k", "n").collect()} == {1: 3, 3: 6, 5: 24}
    every, kept = deduction.closure(spark, deduction.AXIOMS, 5), deduction.closure(spark, deduction.AXIOMS, 5, guarded=True)
    assert kept.count() <= every.count() and deduction.uncovered(every, kept).isEmpty()
    names = {"ax1": deduction.AXIOMS[0], "ax2": deduction.AXIOMS[1]}
    assert deduction.checks("(mp (mp ax2 ax1) ax1)", names, "(> p p)") and not deduction.checks("(mp ax1 ax1)", names, "(> p p)")


def test_puzzle_depths(spark):
    met = puzzle.solve(spark, "123456780", "120453786", 3).collect()
    assert {r.total for r in met} == {2}
    assert [r["count"] for r in puzzle.layers(spark, "123456780", 4).groupBy("depth").count().orderBy("depth").collect()] == [1, 2, 4, 8, 16]


def test_predictive_settling(spark):
    w1, w2, x, target = predictive.EXAMPLE
    e = [0.0, 0.0]
    want = []
    for _ in range(2):
        s = [sum(w * v for w, v in zip(row, x)) + e[i] for i, row in enumerate(w1)]
        phi = [math.tanh(v) for v in s]
        g = [t - sum(w * p for w, p in zip(row, phi)) for t, row in zip(target, w2)]
        b = [sum(w2[k][i] * g[k] for k in range(2)) for i in range(2)]
        e = [e[i] - 0.1 * (e[i] - (1 - phi[i] ** 2) * b[i]) for i in range(2)]
        want.append(list(e))
    for r in predictive.settle(spark, w1, w2, x, target, ticks=2).collect():
        assert abs(r.v - want[r.tick - 1][r.i]) < 5e-5


def test_training_in_both_modes(spark):
    w1, w2, x, target = predictive.EXAMPLE
    samples = [(x, target), ([1.0, 0.5], [0.0, 1.0])]
    for mode in ("m1", "m2"):
        a, b, energies, errors = np.array(w1), np.array(w2), [], []
        for u in range(2):
            inp, out = map(np.array, samples[u])
            e = np.zeros(2)
            for tick in range(2):
                phi = np.tanh(a @ inp + e)
                g = out - b @ phi
                e = e - 0.1 * (e - (1 - phi**2) * (b.T @ g))
                energies.append((e @ e + g @ g) / 2)
                errors.append(e)
                if mode == "m2" or tick == 1:
                    a, b = a + 0.05 * np.outer(e, inp), b + 0.05 * np.outer(g, phi)
        got1, got2, kept, spent = predictive.train(spark, w1, w2, samples, 2, ticks=2, weight_rate=0.05, mode=mode)
        assert all(abs(r.v - a[r.i][r.j]) < 1e-6 for r in got1.collect()) and all(abs(r.v - b[r.i][r.j]) < 1e-6 for r in got2.collect())
        assert [r.energy for r in spent.orderBy("update", "tick").collect()] == pytest.approx(energies)
        assert all(abs(r.v - errors[2 * (r.update - 1) + r.tick - 1][r.i]) < 1e-6 for r in kept.collect()) and kept.count() == 8


def test_closures_agree(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(3, 7)], "a int, b int")
    want = {(i, j) for i in range(9) for j in range(i + 1, 10)}
    pairs = lambda df: {tuple(r) for r in df.select("a", "b").collect()}
    assert pairs(closure(edges)) == pairs(closure(edges, doubling=False)) == pairs(recursive_closure(edges)) == want
    step = lambda every: every.toDF("a", "m").join(edges.toDF("m", "b"), "m").select("a", "b")
    assert pairs(naive(edges, step)) == want
    assert pairs(semi_naive(edges, lambda d, _: step(d), fuel=1)) == {p for p in want if p[1] - p[0] <= 2} | {(3, 7), (2, 7), (3, 8)}
    met = meet(edges, spark.createDataFrame([(0,)], "node int"), spark.createDataFrame([(4,)], "node int"), 2)
    assert [(r.node, r.total) for r in met.collect()] == [(2, 4)]


def test_recursive_closure_has_no_row_limit(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)], "a int, b int")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    try:
        assert recursive_closure(edges).count() == 210
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_streamed_closure_equals_batch(spark, tmp_path):
    edges = [(1, 2), (3, 4), (2, 3), (4, 1), (7, 8)]
    for i, e in enumerate(edges):
        spark.createDataFrame([e], "a int, b int").write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        """A driver that starts anew: nothing but the folders is left of the last."""
        kept = StreamedClosure(spark, str(tmp_path / "closure"))
        stream = spark.readStream.schema("a int, b int").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        kept.start(stream, str(tmp_path / "check")).awaitTermination()
        want = {tuple(r) for r in closure(spark.createDataFrame(edges, "a int, b int")).collect()}
        assert sorted(tuple(r) for r in kept.paths.collect()) == sorted(want)
        return kept

    run()
    edges.append((8, 3))
    spark.createDataFrame([edges[-1]], "a int, b int").write.mode("append").parquet(str(tmp_path / "in"))
    kept = run()
    # the last batch again
    last = max(r.batch for r in spark.read.parquet(kept.root).select("batch").distinct().collect())
    before = sorted(tuple(r) for r in kept.paths.collect())
    kept.absorb(spark.createDataFrame([edges[-1]], "a int, b int"), last)
    assert sorted(tuple(r) for r in kept.paths.collect()) == before


def test_folds_equal_listing(spark):
    rng = random.Random(9)
    rel = lambda *names: spark.createDataFrame([tuple(rng.randrange(6) for _ in names) for _ in range(30)], " int, ".join(names) + " int").distinct()
    r, s, t = rel("a", "b").cache(), rel("b", "c").cache(), rel("c", "a").cache()
    for factors in ([r, s], [r, s, t], [r, s.toDF("x", "y")], [r]):
        joined = factors[0]
        for f in factors[1:]:
            on = [c for c in joined.columns if c in f.columns]
            joined = joined.join(f, on) if on else joined.crossJoin(f)
        got, want = aggregate.fold(factors, "a").first(), joined.selectExpr("count(*)", "sum(a)", "min(a)", "max(a)").first()
        assert tuple(map(int, got)) == tuple(map(int, want))
        assert aggregate.count_join(factors) == want[0]


def test_merged_cells_of_any_value(spark):
    cells = [None, "u", "0", "1", "*", "=u", "long"]
    x = spark.createDataFrame([(i, g, c) for i, c in enumerate(cells * 2) for g in (1, 2, None)], "i int, g int, a string")
    y = spark.createDataFrame([(i, g, c) for i, c in enumerate(cells) for g in (1, 3, None)], "j int, g int, b string")
    got = guard.merged(x, y, "g", "a", "b").select("i", "j", "m").collect()
    agree = lambda a, b: b if a == "u" else a if b == "u" or a == b else None
    want = [(i, j, agree(a, b)) for i, a in enumerate(cells * 2) for j, b in enumerate(cells) if a and b and agree(a, b)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_merged_lists_longer_than_one_are_cut(spark, monkeypatch):
    """Groups and lists of a few rows, several columns with nulls, none besides key and cell, and equal rows."""
    monkeypatch.setattr(guard, "LIST", 3)
    monkeypatch.setattr(guard, "GROUP", 5)
    x = spark.createDataFrame([(i % 4, 1, "u01"[i % 3]) for i in range(12)], "i int, g int, a string")
    y = spark.createDataFrame([(1, "u01"[i % 3], i if i % 5 else None, f"t{i % 2}" if i % 7 else None) for i in range(40)], "g int, b string, j int, t string")
    got = guard.merged(x, y, "g", "a", "b")
    assert got.columns == ["g", "i", "a", "b", "j", "t", "m"]
    agree = lambda a, b: b if a == "u" else a if b == "u" or a == b else None
    want = [(1, p.i, p.a, q.b, q.j, q.t, agree(p.a, q.b)) for p in x.collect() for q in y.collect() if agree(p.a, q.b)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    bare = guard.merged(x, y.select("g", "b"), "g", "a", "b").select("g", "i", "a", "b", "m")
    assert sorted(map(tuple, bare.collect())) == sorted((g, i, a, b, m) for g, i, a, b, _, _, m in want)


def test_guards(spark):
    rows = spark.createDataFrame([(1, None), (1, 2), (None, 3), (2, 3), (2, 4)], "x int, y int")
    assert {tuple(r) for r in guard.antichain(rows, ["x", "y"]).collect()} == {(1, None), (None, 3), (2, 4)}
    every = rows.unionByName(spark.createDataFrame([(None, None)], "x int, y int"))
    assert [tuple(r) for r in guard.antichain(every, ["x", "y"]).collect()] == [(None, None)]
    new = spark.createDataFrame([("(f a)",), ("(g a)",), ("(h b)",)], "key string")
    had = spark.createDataFrame([("(f $0)",), ("(g a)",)], "key string")
    assert [r.key for r in guard.guard(new, had).collect()] == ["(h b)"]


def test_einsum_specs(spark):
    assert derivative("ab,b->a", 1) == "a,ab->b"
    m = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)], "i int, j int, v double")
    v = spark.createDataFrame([(0, 5.0), (1, 7.0)], "i int, v double")
    assert {(r.a, r.v) for r in einsum("ab,b->a", m, v).collect()} == {(0, 19.0), (1, 15.0)}
    assert tuple(deviation(v, v).first()) == (0.0, 0.0)

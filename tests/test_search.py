"""Quantified formulas against truth tables, proof search, weights, triangles, the table function and the command line."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.__main__ import main
from factloom.demos import proofs, puzzle, qbf
from factloom.demos.deduction import AXIOMS
from factloom.functions import subterms
from factloom.operators import weights
from factloom.operators.cyclic import triangles


def truth_table(prefix, clauses):
    """An axis for each variable; blocks are folded from the innermost out."""
    used = sorted({abs(x) for c in clauses for x in c} | {v for _, vs in prefix for v in vs})
    named = [v for _, vs in prefix for v in vs]
    order = [("e", v) for v in used if v not in named] + [(q, v) for q, vs in prefix for v in vs]
    at = {v: i for i, (_, v) in enumerate(order)}
    grid = np.indices((2,) * len(order)).astype(bool)
    whole = np.ones((2,) * len(order), bool)
    for clause in clauses:
        whole &= np.logical_or.reduce([grid[at[abs(x)]] == (x > 0) for x in clause]) if clause else False
    for q, _ in reversed(order):
        whole = whole.all(axis=-1) if q == "a" else whole.any(axis=-1)
    return bool(whole)


def formulas():
    draw = random.Random(12)
    for blocks in ([("e", 3)], [("a", 2), ("e", 3)], [("e", 2), ("a", 2), ("e", 2)], [("a", 1), ("e", 2), ("a", 2), ("e", 2)]):
        for n in (4, 9):
            prefix, clauses = qbf.planted(draw.randrange(10**6), blocks, n)
            yield prefix, clauses
            yield prefix, [[draw.choice((x, -x)) for x in c] for c in clauses]


def test_formulas_equal_truth_tables(spark):
    seen = set()
    for prefix, clauses in formulas():
        want = truth_table(prefix, clauses)
        seen.add(want)
        assert qbf.value(spark, prefix, clauses) == want, (prefix, clauses)
    assert seen == {True, False}
    assert qbf.value(spark, [], [[1]]) and not qbf.value(spark, [("a", [1])], [[1]]) and not qbf.value(spark, [("e", [1])], [[1], [-1]])
    assert qbf.value(spark, [("a", [1])], [[1, -1]]) and qbf.value(spark, [("a", [1])], []) and not qbf.value(spark, [], [[]])


def test_clause_helpers(spark):
    c = qbf.clauses_of([[1, 2], [2, 1], [-1, 3], [4, -4]])
    assert len(c) == 2 and qbf.assign(c, [1]) == frozenset([frozenset([3])])
    assert qbf.rename(c, {1: 7}) == qbf.clauses_of([[7, 2], [-7, 3]])
    opposite, new = qbf.negate(c, 10)
    for bits in itertools.product((1, -1), repeat=3):
        held = [v * s for v, s in zip((1, 2, 3), bits, strict=True)]
        fails = frozenset() in qbf.assign(c, held) or any(not x for x in qbf.assign(c, held))
        assert (qbf._one(spark, new, qbf.assign(opposite, held)) is not None) == fails
    # no universal literal may be innermost, units and single signs are gone
    assert qbf.prepare([("e", [1]), ("a", [2])], qbf.clauses_of([[1, 2], [-1, 3, 2], [-3, 1]]))[1] == frozenset()
    rows = qbf.assignments(spark, [1, 2, 3], c).collect()
    assert len(rows) == 4 and qbf.assignments(spark, list(range(1, 13)), qbf.clauses_of([[1], [-12]])).count() == 2**10
    assert qbf.refine(spark, [1], [2], qbf.clauses_of([[1, 2], [1, -2]])) == [-1] and qbf.refine(spark, [1], [2], qbf.clauses_of([[1, 2]])) is None


def test_proof_search_meets_at_any_cap(spark):
    found = {}
    for cap in (1, 3):
        theorems = proofs.forward(spark, AXIOMS, cap)
        size, states = proofs.search(spark, theorems, "(> p p)", 5, cap)
        found[cap] = size
        assert sum(states.values()) > 0
        assert proofs.search(spark, theorems, "(> p p)", 4, cap)[0] is None
    assert found == {1: 5, 3: 5}
    assert proofs.search(spark, theorems, "(> p (> q p))", 3, 3)[0] == 1
    assert proofs.search(spark, theorems, "(> p q)", 5, 3)[0] is None


def test_puzzle_layers_equal_a_plain_search(spark):
    layer, seen = {"123456780"}, {"123456780": 0}
    for depth in range(1, 6):
        ahead = set()
        for s in layer:
            at = s.index("0")
            for other in puzzle.BESIDE[at]:
                t = list(s)
                t[at], t[other] = t[other], t[at]
                ahead.add("".join(t))
        layer = {s for s in ahead if s not in seen}
        seen |= dict.fromkeys(layer, depth)
    got = {r.state: r.depth for r in puzzle.layers(spark, "123456780", 5).collect()}
    assert got == seen
    scrambled = puzzle.scramble("123456780", 6, seed=3)
    assert sorted(scrambled) == sorted("123456780") and puzzle.scramble("123456780", 6, seed=3) == scrambled
    assert puzzle.solve(spark, scrambled, "123456780", 3).count() > 0


def test_weights(spark):
    make = lambda rows: spark.createDataFrame(rows, weights.WEIGHTS)
    w = weights.set_weights(make([(["a"], 5), (["b"], 1)]), make([(["a", "x"], 7), (["a"], -2), (["b"], 0), (["c", "y", "z"], 4), ([], 1)]))
    assert {(tuple(r.path), r.weight) for r in w.collect()} == {(("a", "x"), 7), (("a",), -2), (("c", "y", "z"), 4), ((), 1)}
    assert weights.total(w).first().total == 12 and weights.total(w.where("false")).first().total == 0
    totals = {tuple(r.path): (r.weight, r.total) for r in weights.subtree_totals(w).collect()}
    assert totals == {(): (1, 12), ("a",): (0, 7), ("a", "x"): (7, 7), ("c",): (0, 4), ("c", "y"): (0, 4), ("c", "y", "z"): (4, 4)}
    assert [tuple(r.path) for r in weights.top_maximal(w, 5)] == [("a", "x"), ("c", "y", "z")]
    chain = make([(["p"] * n, 1000 - n) for n in range(1, 400)] + [(["q", str(n)], n) for n in range(1, 6)])
    assert [r.weight for r in weights.top_maximal(chain, 3)] == [999, 5, 4]
    with pytest.raises(Exception, match="beyond a long"):
        weights.total(make([(["a"], 2**62), (["b"], 2**62)])).collect()


def test_triangles_with_hubs(spark):
    draw = random.Random(3)
    rows = list({(draw.randrange(12) if draw.random() < 0.5 else 0, draw.randrange(12)) for _ in range(90)})
    e = spark.createDataFrame(rows, "a int, b int")
    got = sorted(tuple(r) for r in triangles(e, e.toDF("b", "c"), e.toDF("c", "a")).collect())
    assert got == sorted((a, b, c) for a, b in rows for x, c in rows if x == b and (c, a) in rows) and got


def test_table_function(spark):
    subterms.register(spark)
    got = spark.sql("SELECT path, kind, arity, sym, sub FROM subterms('(f $x (g a))')").collect()
    assert [tuple(r) for r in got][:2] == [("", "expr", 3, None, "(f $0 (g a))"), ("0", "sym", 0, "f", "f")] and len(got) == 6
    assert spark.sql("SELECT * FROM subterms('(f')").isEmpty() and spark.range(1).select(F.lit(1)).count() == 1


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.txt").write_text("(edge a b) ; one\n(edge b c)\n(exec 0 (, (edge $x $y) (edge $y $z)) (, (path $x $z)))\n")
    assert main([str(tmp_path / "p.txt"), "--steps", "5", "--count", "(path $x $y)", "--count", "$any"]) == 0
    assert capsys.readouterr().out.splitlines() == ["; 1 rules fired, 3 terms, 0 rejected", "1\t(path $x $y)", "3\t$any"]
    main([str(tmp_path / "p.txt")])
    assert "(path a c)" in capsys.readouterr().out

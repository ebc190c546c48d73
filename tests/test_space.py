import random
from collections import Counter
from itertools import product

import pytest

from factloom.operators.mining import prefix_gains, top_maximal
from factloom.operators.tabling import Tables
from factloom.plans.rules import Program, rewrite
from factloom.sources.readers import qdimacs, read_table, write_table
from factloom.space import Space
from factloom.terms import canon, parse, render, variables
from factloom.unify import apart, resolve, unify
from tests.test_terms import random_term


def brute(facts, pattern):
    """Matches of a conjunction by trying every combination, as canonical rows."""
    factors = list(pattern[1:]) if isinstance(pattern, tuple) and pattern[:1] == (",",) else [pattern]
    names, out = list(variables(pattern)), Counter()
    for combo in product(facts, repeat=len(factors)):
        bound = {}
        for i, (f, fact) in enumerate(zip(factors, combo, strict=True)):
            bound = bound if bound is None else unify(f, apart(fact, f"f{i}"), bound)
        if bound is not None:
            out[render(canon(tuple(resolve(v, bound) for v in names)))] += 1
    return out


def rows(df):
    return Counter(render(canon(parse(f"({' '.join(r)})"))) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_ground_queries_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    facts = {random_term(rng, 2, ground=True) for _ in range(14)}
    space = Space.from_text(spark, " ".join(map(render, facts))).pinned()
    for text in ("$x", "($x $y)", "($x $x)", "(a $x $y)", "(, ($x $y) ($y $z))", "(, ($x $y) (a $x))", "(($x) $y)"):
        assert rows(space.query(text)) == brute(facts, parse(text)), text
        assert space.count_matches(text) == sum(brute(facts, parse(text)).values())


def test_schematic_queries_equal_brute_force(spark):
    texts = ["$any", "(p $x $x)", "(p a b)", "(q (f $x) b)", "(q c $y)"]
    facts = [canon(parse(t)) for t in texts]
    space = Space.from_text(spark, " ".join(texts)).pinned()
    for text in ("(p $u b)", "(, (p $u $v) (q $v $w))", "(, (s) (s))", "(q (f a) $z)"):
        assert rows(space.query(text)) == brute(facts, parse(text)), text


def test_empty_conjunction_and_envelope(spark):
    space = Space.from_text(spark, "(p 1) (p 2) (q 3) (p 1) " + "x" * 64)
    assert space.query("(,)").count() == 1
    assert (space.count(), space.rejected_count()) == (3, 1)
    assert space.query("(, (p $x) (q $y))").count() == 2


def test_algebra_and_edits(spark):
    a, b = Space.from_text(spark, "(p 1) (p 2) $x"), Space.from_text(spark, "(p 2) (p 3) $other")
    terms = lambda s: sorted(r.term for r in s.atoms.collect())
    assert terms(a.union(b)) == ["$0", "(p 1)", "(p 2)", "(p 3)"]
    assert terms(a.intersect(b)) == ["$0", "(p 2)"] and terms(a.subtract(b)) == ["(p 1)"]
    assert a.remove("(p 9)")[1] is False and terms(a.remove("$z")[0]) == ["(p 1)", "(p 2)"]
    assert a.replace("(p 9)", "(p 8)")[1] is False and "(p 8)" in terms(a.replace("(p 1)", "(p 8)")[0])
    assert terms(a) == ["$0", "(p 1)", "(p 2)"]


def test_restriction_save_load(spark, tmp_path):
    space = Space.from_text(spark, "(rel a 1) (rel a 2) (rel b 3) (other a 9)")
    assert space.restrict("(rel a $x)").count() == 2 and space.restrict("$x").count() == 4
    space.save(str(tmp_path / "s"))
    assert Space.from_text(spark, "(new 1)").load(str(tmp_path / "s")).count() == 5
    write_table(space.atoms, str(tmp_path), "t")
    assert read_table(spark, str(tmp_path), "t").count() == 4


def test_transform_equals_query_then_add_and_repeats_add_nothing(spark):
    space = Space.from_text(spark, "(edge a b) (edge b c) (edge c d)")
    after, n, new = space.transform("(, (edge $x $y) (edge $y $z))", "(path $x $z)")
    assert (n, new, after.count()) == (2, True, 5)
    assert after.transform("(, (edge $x $y) (edge $y $z))", "(path $x $z)")[1:] == (2, False)
    fresh = space.transform("(edge $x b)", "(w $q $x $q)")[0]
    assert "(w $0 a $0)" in [r.term for r in fresh.atoms.collect()]


def test_rules(spark):
    text = """(n 1) (n 2) (n 3) (seen 2)
    (exec (3 c) (, (n $x)) (O (guard (seen $x) (fresh $x))))
    (exec (1 a) (, (n $x)) (O (- (n $x)) (+ (m $x))))
    (exec (2 b) (, (m $x)) (O (pure (twice $x $v) $v (i64_to_string (product_i64 (i64_from_string $x) (i64_from_string 2))))))
    (exec (4 d) (, (m $x)) (O (count (many $c) $c) (max (most $c) $c $x) (choose (idx k) (w $x)) (ACT saved (kept $x))))
    (exec (quiesce) (I (ACT saved (kept $x))) (, (back $x)))"""
    p = Program(Space.from_text(spark, text))
    assert p.step(1) == 1 and p.run(20) is p.space
    got = {r.term for r in p.space.atoms.collect()}
    assert {"(m 1)", "(m 2)", "(m 3)", "(twice 3 6)", "(many 3)", "(most 3)", "(w 1)", "(idx k)", "(back 2)"} <= got
    assert not any(t.startswith(("(n ", "(exec", "(fresh")) for t in got)


def test_rewriting_takes_all_branches(spark):
    eqs = "(= (add Z $y) $y) (= (add (S $x) $y) (add $x (S $y))) (= (coin) heads) (= (coin) tails)"
    space = Space.from_text(spark, eqs)
    assert rewrite(space, "(add (S (S Z)) (S Z))") == ["(S (S (S Z)))"]
    assert rewrite(space, "(coin)") == ["heads", "tails"] and rewrite(space, "inert") == ["inert"]


def test_mining_gain(spark):
    facts = " ".join(f"(rule (when gate) a{i:02d})" for i in range(40)) + " (fact solo)"
    top = top_maximal(prefix_gains(Space.from_text(spark, facts).atoms, 9), 1)
    assert top[0].gain == 39 * 17 - 40 * 9 and top[0].shown == "(rule (when gate) …)"


def test_tables_replay(spark):
    space, tables = Space.from_text(spark, "(f a b) (g mid c) (h mid d)").pinned(), Tables(least_seconds=0)
    first = rows(tables.query(space, "($x mid $y)"))
    assert rows(tables.query(space, "($p mid $q)")) == first and tables.hits == 1
    grown = space.add("(k mid e)")
    assert sum(rows(tables.query(grown, "($x mid $y)")).values()) == 3


def test_qdimacs(spark, tmp_path):
    (tmp_path / "f.qdimacs").write_text("c x\np cnf 4 2\na 1 0\na 2 0\ne 3 0\n1 -3 0\n-2 3 4 0\n")
    prefix, clauses = qdimacs(spark, str(tmp_path / "f.qdimacs"))
    assert sorted((r.block, r.quant, r["var"]) for r in prefix.collect()) == [(0, "e", 4), (1, "a", 1), (1, "a", 2), (2, "e", 3)]
    assert clauses.count() == 5 and clauses.select("cid").distinct().count() == 2



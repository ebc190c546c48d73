import os

import pytest

from factloom.operators.guard import guard
from factloom.operators.order import sort_by_priority
from factloom.plans.fixpoint import reduce_terms
from factloom.plans.rules import Program, rewrite_all, scheduled
from factloom.sources.generators import function_tables, tensor_facts
from factloom.sources.readers import json_rows, qdimacs
from factloom.session import cut, scratch
from factloom.space import Space, classify
from factloom.streaming.relation import StreamedRelation
from factloom.terms import Var, parse, raw, symbol


def terms(space):
    return sorted(r.term for r in space.atoms.collect())


def found(df):
    return sorted(tuple(r) for r in df.collect())


def test_classifier():
    yes = classify(parse("(edge 5 $y)"))
    assert yes == (("edge", 3), {1: "5"}, [Var("y")])
    assert classify(parse("(edge $x b)"))[1] == {2: "b"} and classify(parse("(edge a b)"))[2] == []
    for no in ("($f a)", "(edge $x $y)", "(edge $x $x a)", "(edge (f a) $x)", "(edge)", "edge", "$x"):
        assert classify(parse(no)) is None, no


def test_symbols_in_quotes():
    for text in ("a", "two words", "a)b", 'say "x"', "back\\slash y", ";", "$x", "1", 'q"'):
        assert raw(symbol(text)) == text and parse(symbol(text)) == symbol(text)
    assert symbol("a") == "a" and symbol("Brand#1") == "Brand#1"


def test_columns_are_validated_and_matched_as_typed(spark):
    rows = [(1, "UNITED STATES", 0.5), (2, "x" * 64, 1.0), (3, None, 1.0), (4, "$x", 1e20), (5, "a)", None), (6, "", 1.0), (7, "7", 2.0), (1, "UNITED STATES", 0.5)]
    space = Space.from_columns("n", spark.createDataFrame(rows, "k int, name string, v double"))
    assert space.count() == 3 and space.rejected_count() == 4 and space.is_ground()
    assert terms(space) == ['(n 1 "UNITED STATES" 0.5)', '(n 4 "$x" 1.0E20)', "(n 7 7 2.0)"]
    assert found(space.query('(n $k "UNITED STATES" $v)')) == [("1", "0.5")]
    assert found(space.values("(n 4 $n $v)")) == [("$x", 1e20)]
    # an integer and a string of the same digits are one symbol
    assert found(space.query("(n $x $x $v)")) == [("7", "2.0")]
    for nothing in ("(n 01 $x $v)", "(n (S Z) $x $v)", "(n 1 $x)", "(m 1 $x $v)", "(n 9999999999999999999999 $x $v)", '(n 7 "7" $v)', "(n x $y $z)"):
        assert space.query(nothing).isEmpty(), nothing
    with pytest.raises(ValueError):
        Space.from_columns("two words", spark.range(1))


def test_relations_and_generic_terms_are_one_set(spark):
    rel = Space.from_columns("e", spark.createDataFrame([(1, 2), (2, 3)], "a int, b int"))
    both = rel.union(Space.from_text(spark, "(e 1 2) (e 5 6) (e $x 9) (f 1 2) (e 1 2 3) (e (S Z) 3)"))
    assert both.count() == 7
    assert found(both.query("(e $a 3)")) == [("(S Z)",), ("2",)]
    assert found(both.query("(e 7 $b)")) == [("9",)] and found(both.query("($f 1 2)")) == [("e",), ("f",)]
    assert found(both.query("(, (e $a $b) (e $b $c))")) == sorted([("1", "2", "3"), *((a, b, "9") for a, b in (("1", "2"), ("2", "3"), ("5", "6"), ("(S Z)", "3"))), ("$0", "9", "9")])
    assert found(both.query("$x")) and both.count_matches("$x") == 7
    assert both.remove("(e 1 2)")[1] and both.remove("(e 1 2)")[0].count() == 6 and both.remove("(e 9 9)")[1] is False
    strings = Space.from_columns("e", spark.createDataFrame([("1", "2"), ("x", "y")], "a string, b string"))
    assert terms(rel.union(strings)) == ["(e 1 2)", "(e 2 3)", "(e x y)"]
    assert terms(rel.intersect(strings)) == ["(e 1 2)"] and terms(rel.subtract(both.restrict("(e 1 $x)"))) == ["(e 2 3)"]
    assert terms(both.restrict("(e 1 $x)")) == ["(e 1 2)"]
    promoted = Space.from_text(spark, '(p a "b c") (p a $x) (p (f) 1) (p 1 2) q').promote("p", 3)
    assert list(promoted.relations) == [("p", 3)] and promoted.count() == 5 and promoted.relations["p", 3].count() == 2
    assert found(promoted.query('(p a "b c")')) == [(), ()] and found(promoted.query("(p 1 $y)")) == [("2",)]


def test_saved_relations_stay_typed(spark, tmp_path):
    space = Space.from_columns("e", spark.range(100).selectExpr("id", "id + 1 as n")).add("(r $x)", "s")
    space.save(str(tmp_path / "s"))
    again = Space.read(spark, str(tmp_path / "s"))
    assert again.count() == 102 and found(again.query("(r 1)")) == [()]
    plan = again.values("(e 5 $y)")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c1,5)" in plan and "EvalPython" not in plan and found(again.values("(e 5 $y)")) == [(6,)]


def test_files_of_lines_and_of_terms_over_lines(spark, tmp_path):
    (tmp_path / "lines").write_text('(a 1) (a 2) ; not this (\n\n(b "x)y")\n')
    (tmp_path / "long").write_text("(a\n  1) ; )\n(b (c\n))")
    assert terms(Space.read_text(spark, str(tmp_path / "lines"))) == ["(a 1)", "(a 2)", '(b "x)y")']
    assert terms(Space.read_text(spark, str(tmp_path / "long"))) == ["(a 1)", "(b (c))"]


def test_cells_have_an_identity_and_a_value(spark):
    values = lambda **x: spark.createDataFrame(list(x.items()), "id string, value string")
    space = Space.from_text(spark, "(box A &cell:a) (box B &cell:b) (box C 0)").with_cells(values(a="0", b="0", probe="0"))
    assert space.count() == 3
    after = space.with_cells(values(a="7"))
    assert found(after.query("(box A $x)")) == [("7",)] and found(after.query("(box B $x)")) == [("0",)]
    # by current value, and only cells
    assert found(after.query("(box $k &cell:probe)")) == [("B",)]
    assert found(after.with_cells(values(probe="7")).query("(box $k &cell:probe)")) == [("A",)]
    assert found(space.query("(box $k &cell:probe)")) == [("A",), ("B",)]


def test_computed_relations(spark):
    space = Space.from_text(spark, "(n 1) (n 2) (n 10) (n x)").with_functions()
    assert found(space.query("(, (n $a) (n $b) (gtFn $a $b))")) == [("10", "1"), ("10", "2"), ("2", "1")]
    assert found(space.query("(, (n $a) (addFn $a 1 $b) (n $b))")) == [("1", "2")]
    assert found(space.query("(, (n $a) (decFn $a 9))")) == [("10",)]
    with pytest.raises(ValueError):
        space.query("(, (n $a) (gtFn $a $z))")


def test_results_in_order(spark):
    space = Space.from_text(spark, "(p $x b) (p a $y) (p a b) (p a ccc) (p a cc) (p $u $v)")
    got = [r.y for r in space.query("(p a $y)", ordered=True).collect()]
    # agreement, then a variable on one side: first in the last place, then in the one before
    assert got == ["$0", "b", "cc", "ccc", "$0", "b"]


def test_priority_as_a_sort_key(spark):
    want = ["-3", "7", "10", "Z", "abc", "(S Z)", "(S (S Z))", "(a)", "(a b)", "(a b c)", "(b)", "$x", "$y"]
    df = spark.createDataFrame([(t,) for t in reversed(want)], "term string").repartition(3)
    assert [r.term for r in sort_by_priority(df).collect()] == want


def test_guard_dominance_within_a_batch_and_bounds(spark):
    make = lambda rows, c: spark.createDataFrame(rows, c)
    batch = make([("(k $0 a)", 1), ("(k b a)", 2), ("(k b c)", 3), ("(k b c)", 4)], "key string, fact int")
    none = make([], "key string")
    assert found(guard(batch, none).select("fact")) == [(1,), (3,)]
    assert found(guard(batch, make([("(k $0 $1)",)], "key string")).select("fact")) == []
    bounded = make([("(k $0 a)", 1, 5), ("(k b a)", 2, 5), ("(k b a)", 3, 6), ("(k c a)", 4, 4)], "key string, fact int, bound long")
    stored = make([("(k b a)", 5)], "key string, bound long")
    assert found(guard(bounded, make([], "key string, bound long"), bound="bound").select("fact")) == [(1,), (3,)]
    assert found(guard(bounded, stored, bound="bound").select("fact")) == [(1,), (3,)]


def test_guard_sink(spark):
    text = """(in (k $x a) 1) (in (k b a) 2) (in (k b c) 3) (in (m z) 4) (idx (m $q) 9)
    (exec (1 g) (, (in $k $n)) (O (guard (idx $k $n) (out $n)) (guard (idx $k $n) (idx $k $n))))"""
    p = Program(Space.from_text(spark, text))
    p.run(3)
    got = terms(p.space)
    # bounds of stored keys must be as great: (k b a) has 2, the key that covers it 1
    assert [t for t in got if t.startswith("(out")] == ["(out 1)", "(out 2)", "(out 3)"]
    assert "(idx (k $0 a) 1)" in got and "(idx (m z) 4)" not in got


def test_tensor_sink(spark):
    text = """(w 0 0 1.5) (w 0 1 2) (w 1 0 -1) (x 0 4) (x 1 0.5)
    (exec 1 (, (w $i $j $w)) (O (tensor-op-f32 (op einsum ab,b->a) (inputs (w dense 2 2) (x dense 2)) (output (y dense)) (from (w $i $j $w) (x $j $x)) (backend auto))))
    (exec 2 (, (y $i $v)) (O (tensor-op-f32 (op unary tanh) (inputs (y dense 2)) (output (t dense)) (from (y $i $v)) (backend auto))))
    (exec 3 (, (x $i $v)) (O (tensor-op-f32 (op add) (inputs (x dense 2) (y dense 2)) (output (s dense)) (from (x $i $v) (y $i $w)) (backend auto))))
    (exec 4 (, (none $i)) (O (tensor-op-f32 (op add) (inputs (x dense 2) (y dense 2)) (output (u dense)) (from (x $i $v) (y $i $w)) (backend auto))))"""
    p = Program(Space.from_text(spark, text))
    p.run(9)
    assert [(r.i, float(r.v)) for r in p.space.query("(y $i $v)").orderBy("i").collect()] == [("0", 7.0), ("1", -4.0)]
    assert [round(float(r.v), 4) for r in p.space.query("(t $i $v)").orderBy("i").collect()] == [1.0, -0.9993]
    assert found(p.space.query("(s $i $v)")) == [("0", "11.0"), ("1", "-3.5")] and p.space.query("(u $i $v)").isEmpty()


def test_rules_that_write_rules(spark):
    """A scheduler with fuel arms a dormant rule each round; semi-naive or not, the closure comes out."""
    text = """(edge a b) (edge b c) (edge c d)
    (exec (A) (, (edge $x $y)) (, (path $x $y)))
    (exec (IC 0 0 (S (S Z))) (, (exec (IC $x $y (S $c)) $sp $st) ((exec $x) $p $t)) (, (exec (IC $y $x $c) $sp $st) (exec (R $x) $p $t)))
    ((exec 0) (, (edge $x $y) (path $y $z)) (, (path $x $z)))"""
    p = Program(Space.from_text(spark, text))
    p.run(12)
    assert [t for t in terms(p.space) if t.startswith("(path")] == ["(path a b)", "(path a c)", "(path a d)", "(path b c)", "(path b d)", "(path c d)"]
    assert p.fired <= 7


def test_self_arming_rule(spark):
    text = """(budget 3) (layer 3 s) (move s t) (move t u) (move u v) (move v w) (nextFn 3 2) (nextFn 2 1) (nextFn 1 0)
    (exec (go) (, ((step rule) $p $t)) (, (exec (step) $p $t)))
    ((step rule) (, ((step rule) $sp $st) (nextFn $b $n) (layer $b $x) (move $x $y)) (O (guard (seen $y) (seen $y)) (guard (seen $y) (layer $n $y)) (+ (exec (step) $sp $st))))"""
    p = Program(Space.from_text(spark, text))
    p.run(4)
    assert {"(seen t)", "(seen u)", "(seen v)", "(layer 0 v)"} <= set(terms(p.space))


def test_process_calculus(spark):
    """Messages and processes meet in a dish; 1 + 1 in numerals."""
    text = """(exec (IC 0 1 (S (S (S (S (S (S Z))))))) (, (exec (IC $x $y (S $c)) $sp $st) ((exec $x) $p $t)) (, (exec (IC $y $x $c) $sp $st) (exec (R $x) $p $t)))
    ((exec 0) (, (petri (? $channel $payload $body)) (petri (! $channel $payload))) (, (petri $body)))
    ((exec 1) (, (petri (| $l $r))) (, (petri $l) (petri $r)))
    (petri (? (add $ret) ((S $x) $y) (| (! (add (PN $x $y)) ($x $y)) (? (PN $x $y) $z (! $ret (S $z))))))
    (petri (? (add $ret) (Z $y) (! $ret $y)))
    (petri (! (add result) ((S Z) (S Z))))"""
    p = Program(Space.from_text(spark, text))
    p.run(14)
    assert found(p.space.query("(petri (! result $z))")) == [("(S (S Z))",)]


def test_rewriting_many_terms_and_chains(spark):
    eqs = Space.from_text(spark, "(= (double Z) Z) (= (double (S $x)) (twice $x)) (= (twice $x) (S (S (double $x)))) (= (loop) (loop)) (= (coin) heads) (= (coin) tails) (= (id $x) $x)")
    df = spark.createDataFrame([("(double Z)",), ("(coin)",), ("(loop)",), ("(id (f $a $b $a))",), ("plain",)], "term string")
    assert found(rewrite_all(eqs, df)) == [("(coin)", "heads"), ("(coin)", "tails"), ("(double Z)", "Z"), ("(id (f $0 $1 $0))", "(f $0 $1 $0)"), ("plain", "plain")]
    rules = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(3, 90), (50, 51), (51, 52), (52, 50)], "lhs int, rhs int")
    asked = spark.createDataFrame([(0,), (5,), (50,), (77,)], "term int")
    assert found(reduce_terms(rules, asked)) == [(0, 40), (0, 90), (5, 40), (77, 77)]


def test_scratch_tables_go(spark):
    with scratch(spark):
        kept = cut(spark.range(5))
        folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://").removeprefix("file:")
        assert os.path.isdir(folder) and kept.count() == 5
    assert not os.path.exists(folder)


def test_named_tables_on_disk(spark, tmp_path):
    first = Program(Space.from_text(spark, "(n 1) (n 2) (exec 1 (, (n $x)) (O (ACT saved (kept $x (f $x)))))"), root=str(tmp_path))
    first.run(2)
    second = Program(Space.from_text(spark, "(m 2) (exec 1 (I (ACT saved (kept $x $y)) (BTM (m $x))) (, (back $y)))"), root=str(tmp_path))
    second.run(2)
    assert "(back (f 2))" in terms(second.space)


def test_barrier_fires_once_rules_change_nothing(spark):
    text = """(n 1) (exec (1 loop) (, (n $x) ((again) $p $t)) (, (m $x) (exec (1 loop) $p $t)))
    ((again) (, (n $x) ((again) $p $t)) (, (m $x) (exec (1 loop) $p $t)))
    (exec (quiesce 1) (, (m $x)) (, (done $x)))"""
    p = Program(Space.from_text(spark, text))
    p.run(5)
    assert "(done 1)" in terms(p.space) and any(t.startswith("(exec (1 loop)") for t in terms(p.space))


def test_scheduled_bodies(spark):
    step = lambda space, body: space.transform(*body)[0]
    bodies = [("(, (e $x $y) (e $y $z))", "(e $x $z)"), ("(e $x $y)", "(r $y $x)")]
    done = scheduled(bodies, Space.from_text(spark, "(e a b) (e b c) (e c d)"), 10, step)
    assert done.restrict("(e $x $y)").count() == done.restrict("(r $x $y)").count() == 6


def test_visit_in_stored_order(spark):
    space = Space.from_text(spark, "b (p bb a) $x a (p a) (p b a) (p $y $y) ccc")
    assert list(space.visit()) == ["(p a)", "(p $0 $0)", "(p b a)", "(p bb a)", "$0", "a", "b", "ccc"]


def test_generators_and_readers(spark, tmp_path):
    assert found(tensor_facts(spark, "w", [[1, 2.5], [0, -1]]).values("(w 0 $j $v)")) == [(0, 1.0), (1, 2.5)]
    fns = function_tables(spark, 5)
    assert found(fns.values("(, (addFn $a $b 3) (gtFn $a $b) (invFn $a $i))")) == [(2, 1, 3), (3, 0, 2)]
    assert fns.values("(lte $a $b)").count() == 21 and found(fns.values("(, (incFn 5 $x) (decFn 5 $y))")) == []
    (tmp_path / "f.qdimacs").write_text("c x\np cnf 5 3\na 1 0\na 2 0\ne 3 0\n1 -3\n 0 -2 3\n4 0\n5 0\n")
    prefix, clauses = qdimacs(spark, str(tmp_path / "f.qdimacs"))
    assert found(prefix.select("block", "quant", "var")) == [(0, "e", 4), (0, "e", 5), (1, "a", 1), (1, "a", 2), (2, "e", 3)]
    assert found(clauses) == [(0, -3), (0, 1), (1, -2), (1, 3), (1, 4), (2, 5)]
    (tmp_path / "i.json").write_text('[{"name": "a", "n": 1}, {"name": "b", "n": 2}]')
    assert json_rows(spark, str(tmp_path / "i.json"), "name string, n int", ["name", "n"], "n > 0").count() == 2
    for schema, needed, check in (("name string, n int", [], "n > 1"), ("name string, n int, z int", ["z"], None)):
        with pytest.raises(ValueError):
            json_rows(spark, str(tmp_path / "i.json"), schema, needed, check)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        json_rows(spark, str(tmp_path / "i.json"), "name int, n int").collect()


def test_relation_kept_from_a_stream(spark, tmp_path):
    for rows in ([(1, "a"), (2, "b")], [(2, "b"), (3, None)], [(4, "c"), (1, "a")]):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        kept = StreamedRelation(spark, "e", str(tmp_path / "kept"), by="k")
        assert kept.space().is_empty() or kept.space().count() == 3
        stream = spark.readStream.schema("k int, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        kept.start(stream, str(tmp_path / "check")).awaitTermination()
        assert terms(kept.space()) == ["(e 1 a)", "(e 2 b)", "(e 4 c)"]
    kept.absorb(spark.createDataFrame([(1, "a"), (9, "z")], "k int, v string"), 7)
    assert found(kept.space().values("(e 9 $v)")) == [("z",)] and kept.space().count() == 4


def test_typed_values_and_cells(spark):
    space = Space.from_columns("n", spark.createDataFrame([(1, 1.5, "x"), (2, 1.5, "&cell:7")], "a int, b double, c string"))
    assert found(space.grounded()) == [("1", "int"), ("1.5", "double"), ("2", "int")]
    assert space.has_cells() and not space.restrict("(n 1 $b $c)").has_cells()

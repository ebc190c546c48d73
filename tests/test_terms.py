import random

import pytest

from factloom.terms import Var, canon, parse, parse_all, peano_depth, priority_key, render, specificity, trie_key, valid
from factloom.unify import generalizes, resolve, unify


def test_parse_and_render():
    assert parse_all("(a $x (b)) ; comment\n sym") == [("a", Var("x"), ("b",)), "sym"]
    assert render(parse("(a $x (b $x))")) == "(a $x (b $x))"
    assert parse('(s "a b;(")')[1] == '"a b;("'
    for bad in ("(a", "a)", "", "a b"):
        with pytest.raises(ValueError):
            parse(bad)


def test_alpha_equivalence_and_envelope():
    assert canon(parse("(f $y $x $y)")) == canon(parse("(f $a $b $a)")) != canon(parse("(f $a $b $b)"))
    assert not valid("x" * 64) and valid("x" * 63) and not valid("𝜑" * 16) and not valid(tuple(["a"] * 64))


def test_orders():
    terms = ["(a)", "(a b)", "$x", "a", "b", "aa"]
    assert sorted(terms, key=lambda t: trie_key(parse(t))) == ["(a)", "(a b)", "$x", "a", "b", "aa"]
    assert specificity(parse("(f $x a)"), parse("(f b $y)")) == [0, 0, 1, 1]
    assert peano_depth(parse("(S (S Z))")) == 2 and peano_depth(parse("(S a)")) is None
    assert priority_key("9") < priority_key("10") < priority_key("Z") < priority_key(parse("(S Z)")) < priority_key(parse("(a b)")) < priority_key(Var("x"))


def random_term(rng, depth=3, ground=False):
    roll = rng.random()
    if depth == 0 or roll < 0.45:
        return rng.choice("abcd") if ground or rng.random() < 0.6 else Var(rng.choice("xyz"))
    return tuple(random_term(rng, depth - 1, ground) for _ in range(rng.randint(1, 3)))


def test_unify_makes_equal_and_agrees_with_matching():
    rng = random.Random(2)
    hits = 0
    for _ in range(4000):
        a, b = random_term(rng), random_term(rng)
        bound = unify(a, b)
        if bound is not None:
            hits += 1
            assert resolve(a, bound) == resolve(b, bound)
        g = random_term(rng, ground=True)
        assert generalizes(a, g) == (unify(a, g) is not None)
    assert hits > 300
    assert unify(Var("x"), ("f", Var("x"))) is None

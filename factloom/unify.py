"""Unification of terms that may both hold variables, one-way matching, and both as vectorised column functions."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.terms import Var, canon, parse, render, specificity, substitute, variables


def walk(term, bound: dict):
    while isinstance(term, Var) and term in bound:
        term = bound[term]
    return term


def occurs(var: Var, term, bound: dict) -> bool:
    term = walk(term, bound)
    return term == var if not isinstance(term, tuple) else any(occurs(var, x, bound) for x in term)


def unify(a, b, bound: dict | None = None) -> dict | None:
    """The most general bindings that make both equal, or None; never a term inside itself."""
    bound = dict(bound or {})
    todo = [(a, b)]
    while todo:
        x, y = (walk(t, bound) for t in todo.pop())
        if x == y:
            continue
        if isinstance(x, Var) or isinstance(y, Var):
            var, term = (x, y) if isinstance(x, Var) else (y, x)
            if occurs(var, term, bound):
                return None
            bound[var] = term
        elif isinstance(x, tuple) and isinstance(y, tuple) and len(x) == len(y):
            todo += zip(x, y)
        else:
            return None
    return bound


def resolve(term, bound: dict):
    term = walk(term, bound)
    return tuple(resolve(x, bound) for x in term) if isinstance(term, tuple) else term


def apart(term, mark: str):
    """The term with its variables renamed, so that it shares none."""
    return substitute(term, {v: Var(f"{mark}.{v.name}") for v in variables(term)})


def generalizes(schema, instance, bound: dict | None = None) -> bool:
    """Whether the schema's variables alone can be bound so that it equals the instance."""
    bound = {} if bound is None else bound
    if isinstance(schema, Var):
        return bound.setdefault(schema, instance) == instance
    if isinstance(schema, tuple) and isinstance(instance, tuple):
        return len(schema) == len(instance) and all(generalizes(s, i, bound) for s, i in zip(schema, instance))
    return schema == instance


@F.pandas_udf(T.BooleanType())
def generalizes_column(schema: pd.Series, instance: pd.Series) -> pd.Series:
    return pd.Series([generalizes(parse(s), parse(i)) for s, i in zip(schema, instance, strict=True)])


@F.pandas_udf(T.StringType())
def canon_column(term: pd.Series) -> pd.Series:
    return term.map(lambda t: None if t is None else render(canon(parse(t))))


def unified(pairs: DataFrame, factor, seen: list[Var], after: list[Var], fact: str) -> DataFrame:
    """Rows of bindings, columns `seen`, and facts: those that unify with the factor, with the columns `after` as canonical strings."""
    text, names, wanted = render(factor), [v.name for v in seen], [v.name for v in after]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def solve(facts: pd.Series, *values: pd.Series) -> pd.Series:
        pattern, out = parse(text), []
        for f, *row in zip(facts, *values, strict=True):
            # variables of the row, the pattern and the fact are three kinds
            bound = {Var(n): apart(parse(v), "r") for n, v in zip(names, row, strict=True)}
            got = unify(substitute(pattern, bound), apart(parse(f), "f"))
            out.append(None if got is None else [render(x) for x in canon(tuple(resolve(bound.get(Var(n), Var(n)), got) for n in wanted))])
        return pd.Series(out, dtype=object)

    others = [c for c in pairs.columns if c not in names]
    solved = pairs.withColumn("_solved", solve(F.col(fact), *(F.col(f"`{n}`") for n in names))).where("_solved is not null")
    return solved.select(*others, *(F.col("_solved")[i].alias(n) for i, n in enumerate(wanted)))


def pair_up(left: DataFrame, a: str, right: DataFrame, b: str, also: list[str] | None = None) -> DataFrame:
    """Pairs whose terms `a` and `b` may unify, joined on their symbol or functor (and columns `also`); a variable, or an expression whose
    functor is none, meets all."""

    def shape(c):
        head = F.regexp_extract(c, r"^\(([^\s()$]+)[\s)]", 1)
        return F.when(c.startswith("("), F.when(head != "", F.concat(F.lit("("), head))).when(~c.startswith("$"), c)

    s, t = shape(F.col(f"`{a}`")), shape(F.col(f"`{b}`"))
    one = left.withColumn("_shape", F.explode(F.when(s.isNull(), F.array(F.lit(")any"))).otherwise(F.array(s, F.lit(")none")))))
    two = right.withColumn("_shape", F.explode(F.when(t.isNull(), F.array(F.lit(")any"), F.lit(")none"))).otherwise(F.array(t, F.lit(")any")))))
    return one.join(two, ["_shape", *(also or [])]).drop("_shape")


def specificity_of(pattern: str, term: Column) -> Column:
    """0 where pattern and term agree or both have a variable, 1 where just one has, in preorder."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def keys(terms: pd.Series) -> pd.Series:
        p = parse(pattern)
        return pd.Series([specificity(p, parse(t)) for t in terms], dtype=object)

    return keys(term)


def canonical(term: Column) -> Column:
    """Canonical strings; only those with variables go through Python."""
    return F.when(term.contains("$"), canon_column(term)).otherwise(term)

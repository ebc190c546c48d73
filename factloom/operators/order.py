"""Orders of terms as sort keys in columns: stored order, specificity of matches, priority."""

from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.terms import canon, parse, peano_depth, priority_key, trie_key

TRIE = T.ArrayType(T.StructType().add("rank", "integer").add("size", "integer").add("bytes", "binary"))


@F.pandas_udf(TRIE)
def trie_order(term: pd.Series) -> pd.Series:
    return pd.Series([[{"rank": r, "size": n, "bytes": b} for r, n, b in trie_key(parse(t))] for t in term], dtype=object)


@F.pandas_udf(T.LongType())
def peano(term: pd.Series) -> pd.Series:
    return term.map(lambda t: peano_depth(parse(t)) or 0).astype("int64")


def flat_specificity(pattern: list, columns: list[Column]) -> Column:
    """For flat facts with null for a variable: 1 where just one of pattern and fact has a variable, place by place."""
    return F.array(*(F.when((F.lit(p).isNull()) == c.isNull(), 0).otherwise(1) for p, c in zip(pattern, columns, strict=True)))


PRIORITY = T.StructType().add("kind", "integer").add("tuple", "integer").add("number", "decimal(38,0)").add("text", "string")


def priority_order(term: Column) -> Column:
    """A column that sorts as priorities do: an array of keys in preorder, one for each symbol, numeral or variable, and for where an expression ends."""

    @F.pandas_udf(T.ArrayType(PRIORITY))
    def keys(terms: pd.Series) -> pd.Series:
        return pd.Series([_flat_priority(parse(t)) for t in terms], dtype=object)

    return keys(term)


def _flat_priority(term) -> list[dict]:
    def key(kind, tuple_=0, number=0, text=""):
        return {"kind": kind, "tuple": tuple_, "number": Decimal(number), "text": text}

    # the end of an expression sorts before all that a longer one may hold there
    if isinstance(term, tuple) and peano_depth(term) is None:
        return [key(2, 1), *(k for x in term for k in _flat_priority(x)), key(-1)]
    kind, group, value, _ = priority_key(term)
    return [key(0, 0, group) if kind == 0 else key(2, 0, value) if kind == 2 else key(kind, 0, 0, value)]


def sort_by_priority(terms: DataFrame, column: str = "term") -> DataFrame:
    """Rows by the priority of a term."""
    return terms.orderBy(priority_order(F.col(column)))


def in_order(atoms: DataFrame) -> DataFrame:
    """Terms as they are stored: by canonical trie order."""
    return atoms.orderBy(trie_order("term"))


def rule_order(priority) -> list:
    """Rules fire by this: expressions before symbols, lower arity, shorter, then bytes."""
    return trie_key(canon(priority))

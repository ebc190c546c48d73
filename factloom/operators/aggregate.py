"""Aggregates over conjunctions without listing the matches: factors are summed up on their join keys first.

A factor is a table whose columns are variables. Factors are eliminated leaf by leaf: a factor whose shared variables all lie in one other
factor is aggregated on them and folded into that one. COUNT multiplies, SUM carries sum and count, MIN, MAX and AND need
no multiplicity. A cyclic rest is joined plainly, on columns already aggregated.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.space import natural_join

_AND = lambda c: F.min(c)


def fold(factors: list[DataFrame], value: str | None = None) -> DataFrame:
    """One row: n, the number of matches, and with `value` (a variable) also total, least and most of it."""
    tables = []
    for f in factors:
        own = value in f.columns and value is not None and not any("_sum" in t.columns for t in tables)
        cols = [F.lit(1).cast("decimal(38,0)").alias("_n")]
        if own:
            v = F.col(value).cast("double")
            cols += [v.alias("_sum"), v.alias("_min"), v.alias("_max")]
        tables.append(f.select("*", *cols))
    names = lambda t: {c for c in t.columns if not c.startswith("_")}
    while True:
        shared = [names(t) & set().union(*(names(o) for j, o in enumerate(tables) if j != i)) if len(tables) > 1 else set() for i, t in enumerate(tables)]
        tables = [_sum_up(t, sorted(s)) for t, s in zip(tables, shared, strict=True)]
        if len(tables) == 1:
            break
        leaf = next(((i, j) for i, s in enumerate(shared) for j, t in enumerate(tables) if i != j and s <= names(t)), None)
        if leaf is None:
            joined = tables[0]
            for t in tables[1:]:
                joined = _times(joined, t)
            tables = [joined]
            continue
        i, j = leaf
        merged = _times(tables[j], tables[i])
        tables = [t for k, t in enumerate(tables) if k not in (i, j)] + [merged]
    out = tables[0]
    cols = [F.coalesce("_n", F.lit(0)).cast("long").alias("n")]
    if value is not None:
        cols += [F.col("_sum").alias("total"), F.col("_min").alias("least"), F.col("_max").alias("most")]
    return out.select(*cols)


def _sum_up(t: DataFrame, keys: list[str]) -> DataFrame:
    aggs = [F.sum("_n").alias("_n")]
    if "_sum" in t.columns:
        aggs += [F.sum("_sum").alias("_sum"), F.min("_min").alias("_min"), F.max("_max").alias("_max")]
    return t.groupBy(*keys).agg(*aggs)


def _times(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = (b, a) if "_sum" in b.columns else (a, b)
    b = b.select(*[c for c in b.columns if not c.startswith("_")], F.col("_n").alias("_m"))
    joined = natural_join([a, b])
    out = joined.withColumn("_n", (F.col("_n") * F.col("_m")).cast("decimal(38,0)"))
    if "_sum" in a.columns:
        out = out.withColumn("_sum", F.col("_sum") * F.col("_m").cast("double"))
    return out.drop("_m")


def count_join(factors: list[DataFrame]) -> int:
    return fold(factors).first()["n"]


def all_hold(factors: list[DataFrame], flag: str) -> DataFrame:
    """One row, holds: whether the boolean variable `flag` is true in every match; AND needs no multiplicity."""
    return fold([f.withColumn(flag, F.col(flag).cast("int")) if flag in f.columns else f for f in factors], flag).select((F.col("least") == 1).alias("holds"))

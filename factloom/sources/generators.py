"""Facts made from arrays and from rules: tensors, and the function tables that programs match instead of computing."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.space import Space


def tensor_facts(spark: SparkSession, functor: str, values: list) -> Space:
    """(functor i … value) for each number of a nested list."""

    def walk(x, at):
        if isinstance(x, list):
            for i, y in enumerate(x):
                yield from walk(y, (*at, i))
        else:
            yield (*at, float(x))

    rows = list(walk(values, ()))
    names = [f"i{i}" for i in range(len(rows[0]) - 1)]
    return Space.from_columns(functor, spark.createDataFrame(rows, ", ".join([*(f"{n} int" for n in names), "v double"])), unique=True)


def function_tables(spark: SparkSession, most: int) -> Space:
    """addFn, gtFn, lte, incFn, decFn and invFn over 0 … most, as relations; sums and successors stay within."""
    n = F.col("id").cast("int")
    one = spark.range(most + 1).select(n.alias("a"))
    # pairs by a row each, not by a join
    side = most + 1
    pairs = spark.range(side * side).select(F.expr(f"cast(id div {side} AS int)").alias("a"), F.expr(f"cast(id % {side} AS int)").alias("b"))

    def table(functor: str, rows: DataFrame, *columns: Column) -> Space:
        return Space.from_columns(functor, rows.select(*columns), unique=True)

    a, b = F.col("a"), F.col("b")
    return (
        table("addFn", pairs.where(a + b <= most), a, b, (a + b).alias("c"))
        .union(table("gtFn", pairs.where(a > b), a, b))
        .union(table("lte", pairs.where(a <= b), a, b))
        .union(table("incFn", one.where(a < most), a, (a + 1).alias("b")))
        .union(table("decFn", one.where(a > 0), a, (a - 1).alias("b")))
        .union(table("invFn", one, a, (F.lit(most) - a).alias("b")))
    )

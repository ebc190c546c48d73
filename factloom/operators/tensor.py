"""Einsum over tensors as relations: tables of indices and v. Contraction is a join on shared indices and a sum over the lost ones."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.space import natural_join


def parse_spec(spec: str) -> tuple[list[str], str]:
    left, _, out = spec.partition("->")
    return left.split(","), out


def einsum(spec: str, *tensors: DataFrame, dtype: str = "double") -> DataFrame:
    """Columns named by the output's letters, and v. Inputs have their index columns in order, then v."""
    letters, out = parse_spec(spec)
    tables = []
    for i, (names, t) in enumerate(zip(letters, tensors, strict=True)):
        cols = [c for c in t.columns if c != "v"]
        tables.append(t.select(*(F.col(c).alias(n) for c, n in zip(cols, names, strict=True)), F.col("v").cast(dtype).alias(f"v{i}")))
    joined = natural_join(tables)
    product = F.col("v0")
    for i in range(1, len(tables)):
        product = product * F.col(f"v{i}")
    if set(out) == set("".join(letters)):
        return joined.select(*out, product.cast(dtype).alias("v"))
    return joined.groupBy(*out).agg(F.sum(product).cast(dtype).alias("v"))


def unary(function, tensor: DataFrame, dtype: str = "double") -> DataFrame:
    return tensor.withColumn("v", function(F.col("v")).cast(dtype))


def add(a: DataFrame, b: DataFrame, scale: float = 1.0, dtype: str = "double") -> DataFrame:
    """a + scale * b, by index; what only one holds counts as 0 in the other."""
    keys = [c for c in a.columns if c != "v"]
    both = a.unionByName(b.withColumn("v", F.col("v") * F.lit(scale)))
    return both.groupBy(*keys).agg(F.sum("v").cast(dtype).alias("v"))


def derivative(spec: str, of: int) -> str:
    """The spec that pulls a derivative back to input `of`: output first, then the other inputs."""
    letters, out = parse_spec(spec)
    others = [x for i, x in enumerate(letters) if i != of]
    return ",".join([out, *others]) + "->" + letters[of]


def energy(*errors: DataFrame) -> DataFrame:
    """Half the sum of squares over all tensors, in one row."""
    every = errors[0].select("v")
    for e in errors[1:]:
        every = every.unionByName(e.select("v"))
    return every.agg((F.sum(F.col("v") * F.col("v")) / 2).alias("energy"))


def deviation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Largest absolute and relative difference of two tensors."""
    keys = [c for c in a.columns if c != "v"]
    both = a.join(b.withColumnRenamed("v", "w"), keys)
    gap = F.abs(F.col("v") - F.col("w"))
    scale = F.greatest(F.abs("v"), F.abs("w"), F.lit(1e-12))
    return both.agg(F.max(gap).alias("absolute"), F.max(gap / scale).alias("relative"))

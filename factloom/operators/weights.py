"""Weighted patterns: signed weights by path, totals of subtrees, and the heaviest that hold none of each other.

A path is an array of strings, the beginning of all paths below it. Weights of 0 are not kept; negative ones are, but count as 0 in totals and are never reported.
Sums beyond a long raise an error.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHTS = "path array<string>, weight long"


def set_weights(weights: DataFrame, changes: DataFrame) -> DataFrame:
    """`weights` with those of `changes` in place of what it had; both have path and weight, changes a path once."""
    kept = weights.join(changes.select("path"), "path", "left_anti")
    return kept.unionByName(changes.select("path", F.col("weight").cast("long").alias("weight"))).where("weight <> 0")


def _sum(weight: Column) -> Column:
    """The sum of positive weights, checked."""
    total = F.sum(F.greatest(weight, F.lit(0)).cast("decimal(38,0)"))
    return F.when(total > 2**63 - 1, F.raise_error(F.lit("the weights' sum is beyond a long")).cast("long")).otherwise(total.cast("long"))


def total(weights: DataFrame) -> DataFrame:
    """One row, total: the positive weight of all."""
    return weights.agg(F.coalesce(_sum(F.col("weight")), F.lit(0).cast("long")).alias("total"))


def subtree_totals(weights: DataFrame) -> DataFrame:
    """(path, weight, total) of every path that has positive weight at or below it; weight is 0 where a path has none of its own."""
    ups = F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.struct(F.slice("path", F.lit(1), n).alias("path"), (n == F.size("path")).alias("own")))
    each = weights.where("weight > 0").select("weight", F.explode(ups).alias("up"))
    return each.groupBy("up.path").agg(F.coalesce(F.max(F.when(F.col("up.own"), F.col("weight"))), F.lit(0)).cast("long").alias("weight"), _sum(F.col("weight")).alias("total"))


def top_maximal(weights: DataFrame, k: int, weight: str = "weight", path: str = "path") -> list:
    """Greedily the k heaviest rows with a positive weight of which no path begins another's; ties go to the smaller path.

    The first rows are fetched in growing portions, mostly one, until k of them are apart or none is left.
    """
    chosen: list = []
    left, take = weights.where(F.col(weight) > 0), 64 * k
    apart = lambda a, b: a[: len(b)] != b and b[: len(a)] != a
    while len(chosen) < k:
        rows = left.orderBy(F.col(weight).desc(), path).limit(take).collect()
        for r in rows:
            if len(chosen) < k and all(apart(r[path], c[path]) for c in chosen):
                chosen.append(r)
        if len(rows) < take:
            break
        # what lies on the way of a chosen path can't follow; the rest of the portion is behind the last row
        last = rows[-1]
        left = left.where((F.col(weight) < last[weight]) | (F.col(weight) == last[weight]) & (F.col(path) > F.lit(last[path])))
        take *= 4
    return chosen

"""Proof search by detachment: forward theorems up to a size meet a backward search from the goal.

A state is a budget of size and a list of open goals, (g GOAL REST). Above the cap a goal B is split into (> $a B) and $a, for one of the budget, or closed
by an axiom; at or below it, it is closed by any forward theorem that fits. Every open goal needs one at least. A state that another of the same
budget generalizes is dropped, since whatever closes it closes the other. A higher cap moves the meeting point to the forward side, which is an antichain.
"""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.demos import deduction
from factloom.operators.guard import generalized
from factloom.session import cut
from factloom.terms import Var, canon, parse, render
from factloom.unify import apart, pair_up, resolve, unify


@F.pandas_udf(T.StructType().add("first", "string").add("split", "string"))
def _goals(goals: pd.Series) -> pd.DataFrame:
    """The first goal, and the goals after splitting it."""
    out = []
    for g in map(parse, goals):
        out.append((render(canon(g[1])), render(canon(("g", (">", Var("new"), g[1]), ("g", Var("new"), g[2]))))))
    return pd.DataFrame(out, columns=["first", "split"])


@F.pandas_udf(T.StringType())
def _closed(goals: pd.Series, theorem: pd.Series) -> pd.Series:
    """The goals left when a theorem closes the first, or null."""

    def one(g, t):
        bound = unify(g[1], apart(t, "f"))
        return None if bound is None else render(canon(resolve(g[2], bound)))

    return pd.Series([one(parse(g), parse(t)) for g, t in zip(goals, theorem, strict=True)], dtype=object)


def forward(spark: SparkSession, axioms: list[str], cap: int) -> DataFrame:
    """(k, thm): the antichain of theorems of sizes up to the cap."""
    return deduction.closure(spark, axioms, cap, guarded=True)


def search(spark: SparkSession, theorems: DataFrame, goal: str, size: int, cap: int) -> tuple[int | None, dict[int, int]]:
    """(the size of the smallest proof found, or None; the states by budget). `theorems` are those of forward() up to the cap."""
    goal = render(canon(("g", parse(goal), "nil")))
    layers = {size: spark.createDataFrame([(1, goal)], "holes int, goals string")}
    counts, best = {}, None
    for budget in range(size, 0, -1):
        if budget not in layers:
            continue
        states = cut(layers.pop(budget).groupBy("goals").agg(F.min("holes").alias("holes")))
        terms = states.select(F.col("goals").alias("key"))
        states = cut(states.join(generalized(terms, "key", terms.toDF("schema"), "schema", F.col("key") != F.col("schema")), states["goals"] == F.col("key"), "left_anti"))
        counts[budget] = states.count()
        opened = cut(states.withColumn("_g", _goals("goals")).select("goals", "holes", F.col("_g.first").alias("first"), F.col("_g.split").alias("split")))
        usable = theorems.where(F.col("k") <= (1 if budget > cap else budget))
        met = pair_up(opened, "first", usable.select("k", "thm"), "thm").where(F.col("holes") - 1 <= F.lit(budget) - F.col("k"))
        closed = cut(met.select("k", (F.col("holes") - 1).alias("holes"), _closed("goals", "thm").alias("goals")).where("goals is not null").distinct())
        done = closed.where("goals = 'nil'").agg(F.min("k").alias("k")).first().k
        if done is not None:
            found = size - budget + done
            best = found if best is None else min(best, found)
        for (k,) in closed.where("goals <> 'nil'").select("k").distinct().collect():  # at most the cap's sizes
            part = closed.where((F.col("k") == k) & (F.col("goals") != "nil")).select("holes", "goals")
            layers[budget - k] = layers[budget - k].unionByName(part) if budget - k in layers else part
        if budget > cap:
            split = opened.where(F.col("holes") + 1 <= budget - 1).select((F.col("holes") + 1).alias("holes"), F.col("split").alias("goals"))
            layers[budget - 1] = layers[budget - 1].unionByName(split) if budget - 1 in layers else split
    return best, counts

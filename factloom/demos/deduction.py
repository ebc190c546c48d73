"""Deduction by detachment: derivations counted by size, forward closure, and closure guarded by generality."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.guard import generalized
from factloom.session import cut
from factloom.terms import Var, canon, parse, render
from factloom.unify import apart, generalizes, pair_up, resolve, unify

#: The three axioms of propositional logic over implication (>) and negation (~).
AXIOMS = ["(> $a (> $b $a))", "(> (> $a (> $b $c)) (> (> $a $b) (> $a $c)))", "(> (> (~ $a) (~ $b)) (> $b $a))"]


def detach(major, minor):
    """What follows from an implication and its most general instance of the premise, canonical, or None."""
    if not (isinstance(major, tuple) and len(major) == 3 and major[0] == ">"):
        return None if not isinstance(major, Var) else Var("0")
    bound = unify(major[1], apart(minor, "m"))
    return None if bound is None else canon(resolve(major[2], bound))


@F.pandas_udf(T.StringType())
def detach_column(major: pd.Series, minor: pd.Series) -> pd.Series:
    def one(a, b):
        got = detach(parse(a), parse(b))
        return None if got is None else render(got)

    return pd.Series([one(a, b) for a, b in zip(major, minor, strict=True)], dtype=object)


def _axioms(spark: SparkSession, axioms: list[str]) -> DataFrame:
    return spark.createDataFrame([(1, render(canon(parse(a))), 1) for a in axioms], "k int, thm string, n int").withColumn("n", F.col("n").cast("decimal(38,0)"))


@F.pandas_udf(T.StringType())
def premise_column(major: pd.Series) -> pd.Series:
    """What an implication asks for; a variable may be any implication."""
    return major.map(lambda t: (lambda x: render(x[1]) if isinstance(x, tuple) and len(x) == 3 and x[0] == ">" else "$0" if isinstance(x, Var) else None)(parse(t)))


def _pairs(every: DataFrame, k: int) -> DataFrame:
    """Majors f and minors thm of sizes that make k, by an equi-join on the size and the beginnings of premise and minor."""
    majors = every.select((F.lit(k - 1) - F.col("k")).alias("k"), F.col("thm").alias("f"), *(F.col(c).alias("nf") for c in every.columns if c == "n"), premise_column("thm").alias("premise")).where("premise is not null")
    return pair_up(majors, "premise", every, "thm", ["k"])


def count_derivations(spark: SparkSession, axioms: list[str], most: int) -> DataFrame:
    """(k, thm, n): how many derivations of size k end in a theorem; sizes of both premises and 1 add up to k."""
    every = cut(_axioms(spark, axioms))
    for k in range(2, most + 1):
        made = _pairs(every, k).select(detach_column("f", "thm").alias("thm"), (F.col("nf") * F.col("n")).alias("n")).where("thm is not null")
        layer = made.groupBy("thm").agg(F.sum("n").cast("decimal(38,0)").alias("n")).select(F.lit(k).alias("k"), "thm", "n")
        every = cut(every.unionByName(layer))
    return every


def closure(spark: SparkSession, axioms: list[str], most: int, guarded: bool = False) -> DataFrame:
    """(k, thm): theorems by smallest size; guarded, only those that no theorem of that size or smaller generalizes."""
    every = cut(_axioms(spark, axioms).select("k", "thm"))
    for k in range(2, most + 1):
        made = _pairs(every, k).select(detach_column("f", "thm").alias("thm")).where("thm is not null").distinct()
        fresh = cut(made.join(every, "thm", "left_anti"))
        if guarded:
            others = every.select(F.col("thm").alias("schema")).unionByName(fresh.select(F.col("thm").alias("schema")))
            fresh = cut(fresh.join(generalized(fresh, "thm", others, "schema", F.col("schema") != F.col("thm")), "thm", "left_anti"))
        every = cut(every.unionByName(fresh.select(F.lit(k).alias("k"), "thm")))
    return every


def uncovered(every: DataFrame, kept: DataFrame) -> DataFrame:
    """Theorems of the full closure that no kept theorem of that size or smaller generalizes."""
    some = kept.toDF("sk", "schema")
    return every.join(generalized(every, "thm", some, "schema", F.col("sk") <= F.col("k")), "thm", "left_anti")


def checks(proof, axioms: dict[str, str], goal: str) -> bool:
    """Whether a proof, an axiom's name or (mp major minor), proves a goal or something more general."""

    def proved(p):
        if isinstance(p, str):
            return canon(parse(axioms[p])) if p in axioms else None
        major, minor = proved(p[1]), proved(p[2])
        return None if major is None or minor is None else detach(major, minor)

    got = proved(parse(proof) if isinstance(proof, str) else proof)
    return got is not None and generalizes(got, parse(goal))

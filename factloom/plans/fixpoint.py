"""Fixpoints: semi-naive and naive closure, a recursive query, layered search and equation rewriting.

Every round is one job that ends in a written table, so lineage stays short and a lost executor costs one round at most.
"""

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import Parts, cut


def semi_naive(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], fuel: int | None = None) -> DataFrame:
    """The least set that holds `seed` and step(delta, all): only the last round's new rows are matched, and only they are written."""
    every = Parts(seed.distinct())
    delta, rounds = every.all(), 0
    while fuel is None or rounds < fuel:
        known = every.all()
        delta = every.append(step(delta, known).select(*known.columns).distinct().join(known, known.columns, "left_anti"))
        rounds += 1
        if not every.added:
            break
    return every.all()


def naive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], fuel: int | None = None) -> DataFrame:
    every, rounds = cut(seed.distinct()), 0
    size = every.count()
    while fuel is None or rounds < fuel:
        every = cut(every.unionByName(step(every).select(*every.columns)).distinct())
        was, size, rounds = size, every.count(), rounds + 1
        if size == was:
            break
    return every


def closure(edges: DataFrame, doubling: bool = True) -> DataFrame:
    """(a, b) wherever b is reached from a. With doubling rounds grow with the log of path length: the new pairs are those whose shortest path
    is longer than half of what is known, and any pair twice as far begins with one of them.
    """
    edges = edges.select("a", "b")

    def step(delta, every):
        d, e = delta.alias("d"), (every if doubling else edges).alias("e")
        return d.join(e, F.col("d.b") == F.col("e.a")).select(F.col("d.a").alias("a"), F.col("e.b").alias("b"))

    return semi_naive(edges, step)


def recursive_closure(edges: DataFrame, levels: int = 10_000) -> DataFrame:
    """The same by a recursive query, for acyclic edges with paths of up to `levels` edges: one job. Paths are listed before pairs are taken, so
    graphs where many paths lead from one node to another are better closed by closure(). LIMIT ALL lifts the session's limit on a recursion's rows.
    """
    view = f"_factloom_edges_{uuid.uuid4().hex}"
    edges.createOrReplaceTempView(view)
    return edges.sparkSession.sql(
        f"WITH RECURSIVE p(a, b) MAX RECURSION LEVEL {levels} AS (SELECT a, b FROM {view} UNION ALL SELECT p.a, e.b FROM p JOIN {view} e ON p.b = e.a) SELECT DISTINCT a, b FROM (SELECT a, b FROM p LIMIT ALL)"
    )


def layers(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, depth): breadth-first search from `start` (node); each node once, in the first layer that meets it. A layer is written once."""
    seen = Parts(start.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, at = seen.all(), 0
    while depth is None or at < depth:
        at += 1
        ahead = frontier.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        frontier = seen.append(ahead.join(seen.all().select("node"), "node", "left_anti").withColumn("depth", F.lit(at)))
        if not seen.added:
            break
    return seen.all()


def meet(edges: DataFrame, start: DataFrame, goal: DataFrame, half: int) -> DataFrame:
    """(node, forward, backward, total): nodes that both a search from `start` and one back from `goal` meet within `half` layers."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    f = layers(edges, start, half).withColumnRenamed("depth", "forward")
    b = layers(back, goal, half).withColumnRenamed("depth", "backward")
    return f.join(b, "node").withColumn("total", F.col("forward") + F.col("backward"))


def reduce_terms(equations: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, normal): what flat equations (lhs, rhs) rewrite each term to, all branches, where no equation applies any more.

    Rewritings that aren't done are joined with all, so rounds grow with the log of their length and a chain keeps one row for each term. What only
    rewrites in a circle has no normal form: it is left after as many rounds as any other rewriting may take.
    """
    edges = cut(equations.select(F.col("lhs").alias("a"), F.col("rhs").alias("b")).distinct())
    more = edges.select(F.col("a").alias("b"), F.lit(True).alias("_more")).distinct()
    step = cut(edges.join(more, "b", "left").select("a", "b", F.col("_more").isNull().alias("done")))
    for _ in range(max(1, step.count()).bit_length() + 1):
        left = step.where("not done")
        if left.isEmpty():
            break
        x, y = left.alias("x"), step.alias("y")
        ahead = x.join(y, F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"), F.col("y.done").alias("done"))
        step = cut(step.where("done").unionByName(ahead).distinct())
    asked = terms.select(F.col("term").alias("a")).distinct()
    found = asked.join(step.where("done"), "a").select(F.col("a").alias("term"), F.col("b").alias("normal"))
    return found.unionByName(asked.join(edges, "a", "left_anti").select(F.col("a").alias("term"), F.col("a").alias("normal")))

"""A predictive-coding network (input, hidden, output) as tensor relations: errors settle over ticks, then weights are updated.

Each tick: pre = W_xh x, s_h = pre + e_h, phi = tanh s_h, s_y = W_hy phi, g_y = target - s_y, b = W_hy' g_y, and e_h moves by
-rate * (e_h - (1 - phi²) * b).
"""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.tensor import add, einsum, energy, unary
from factloom.session import cut

#: W_xh, W_hy, x, target: two units in each layer.
EXAMPLE = ([[0.5, -0.3], [0.2, 0.4]], [[0.7, -0.6], [0.1, 0.9]], [0.0, 1.0], [1.0, 0.0])


def matrix(spark: SparkSession, rows: list[list[float]] | DataFrame) -> DataFrame:
    return rows if isinstance(rows, DataFrame) else spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(rows) for j, v in enumerate(row)], "i int, j int, v double")


def vector(spark: SparkSession, values: list[float] | DataFrame) -> DataFrame:
    return values if isinstance(values, DataFrame) else spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")


def _tick(w_xh, w_hy, x, target, e_h, rate):
    pre = einsum("ab,b->a", w_xh, x)
    phi = cut(unary(F.tanh, add(pre, e_h.toDF("a", "v"))))
    out = einsum("ab,b->a", w_hy, phi)
    g_y = cut(add(target.toDF("a", "v"), out, -1.0))
    back = einsum("ab,a->b", w_hy, g_y).toDF("a", "v")
    slope = unary(lambda v: 1 - v * v, phi)
    push = einsum("a,a->a", slope, back)
    return cut(add(add(e_h.toDF("a", "v"), e_h.toDF("a", "v"), -rate), push, rate)), phi, g_y


def _rest(w_xh: DataFrame) -> DataFrame:
    """No errors yet."""
    return w_xh.select("i").distinct().withColumn("v", F.lit(0.0))


def _learn(w_xh, w_hy, x, e_h, phi, g_y, rate):
    """One local update: W_xh + rate * e_h x', W_hy + rate * g_y phi'."""
    d1 = einsum("a,b->ab", e_h, x).toDF("i", "j", "v")
    d2 = einsum("a,b->ab", g_y, phi).toDF("i", "j", "v")
    return cut(add(w_xh, d1, rate)), cut(add(w_hy, d2, rate))


def settle(spark: SparkSession, w_xh, w_hy, x, target, ticks: int = 16, rate: float = 0.1) -> DataFrame:
    """(tick, i, v): the hidden errors after each tick. Weights are lists or tables of (i, j, v), input and target lists or tables of (i, v)."""
    w1, w2, inp, out = matrix(spark, w_xh), matrix(spark, w_hy), vector(spark, x), vector(spark, target)
    e_h, history = _rest(w1), None
    for tick in range(1, ticks + 1):
        e_h, _, _ = _tick(w1, w2, inp, out, e_h, rate)
        row = e_h.select(F.lit(tick).alias("tick"), F.col("a").alias("i"), "v")
        history = row if history is None else history.unionByName(row)
    return history


def train(spark: SparkSession, w_xh, w_hy, samples: list[tuple], updates: int, ticks: int = 16, rate: float = 0.1, weight_rate: float = 0.01, mode: str = "m1"):
    """(W_xh, W_hy, errors, energies) after so many updates, each of which settles the next of `samples`, (input, target).

    Weights are updated after the last tick (m1) or after every tick (m2). errors: (update, tick, i, v) of the hidden layer; energies: (update, tick, energy),
    half the sum of squares of all errors.
    """
    w1, w2 = matrix(spark, w_xh), matrix(spark, w_hy)
    errors, energies = [], []
    for update in range(1, updates + 1):
        x, target = samples[(update - 1) % len(samples)]
        inp, out = vector(spark, x), vector(spark, target)
        e_h = _rest(w1)
        for tick in range(1, ticks + 1):
            e_h, phi, g_y = _tick(w1, w2, inp, out, e_h, rate)
            at = [F.lit(update).alias("update"), F.lit(tick).alias("tick")]
            errors.append(e_h.select(*at, F.col("a").alias("i"), "v"))
            energies.append(energy(e_h, g_y).select(*at, "energy"))
            if mode == "m2" or tick == ticks:
                w1, w2 = _learn(w1, w2, inp, e_h, phi, g_y, weight_rate)
    return w1, w2, reduce(DataFrame.unionByName, errors), reduce(DataFrame.unionByName, energies)

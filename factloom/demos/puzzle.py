"""Eight-puzzle planning: layers of states from both ends, by built-in functions, and their meeting."""

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import cut

#: Cells beside each cell of the board, row by row.
BESIDE = [[r * 3 + c for r, c in ((i // 3 - 1, i % 3), (i // 3 + 1, i % 3), (i // 3, i % 3 - 1), (i // 3, i % 3 + 1)) if 0 <= r < 3 and 0 <= c < 3] for i in range(9)]


def moves(states: DataFrame) -> DataFrame:
    """The states one move away: the blank 0 changes places with a cell beside it."""
    beside = F.array(*(F.array(*map(F.lit, cells)) for cells in BESIDE))
    swapped = F.transform(F.get(beside, F.instr("state", "0") - 1), lambda i: F.substring("state", i + 1, F.lit(1)))
    tiles = states.select("state", F.explode(swapped).alias("tile"))
    return tiles.select(F.expr("translate(state, '0' || tile, tile || '0')").alias("state"))


def layers(spark: SparkSession, start: str, depth: int) -> DataFrame:
    """(state, depth), each state in its first layer."""
    seen = frontier = cut(spark.createDataFrame([(start, 0)], "state string, depth int"))
    for at in range(1, depth + 1):
        frontier = cut(moves(frontier).distinct().join(seen, "state", "left_anti").withColumn("depth", F.lit(at)))
        seen = cut(seen.unionByName(frontier))
    return seen


def solve(spark: SparkSession, start: str, goal: str, half: int) -> DataFrame:
    """(state, forward, backward, total) of the states on shortest paths' middles; empty if the ends are further than 2 * half."""
    f = layers(spark, start, half).withColumnRenamed("depth", "forward")
    b = layers(spark, goal, half).withColumnRenamed("depth", "backward")
    met = f.join(b, "state").withColumn("total", F.col("forward") + F.col("backward"))
    least = met.agg(F.min("total").alias("total"))
    return met.join(least, "total").select("state", "forward", "backward", "total")


def scramble(state: str, moves: int, seed: int) -> str:
    """A state so many moves away at most, no move taking back the one before."""
    draw, came = random.Random(seed), None
    for _ in range(moves):
        blank = state.index("0")
        to = draw.choice([i for i in BESIDE[blank] if i != came])
        tile = state[to]
        state, came = state.translate(str.maketrans({"0": tile, tile: "0"})), blank
    return state

"""Patterns that compress a space: prefixes of terms, their gain, and the heaviest that hold none of each other.

A prefix is the beginning of a term's preorder walk, cut between two nodes; its length is that of its encoding: 1 for an expression, 1 and
its bytes for a symbol. Gain is (n - 1) * length - n * cost of a reference, for prefixes with n of 2 and more.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators import weights
from factloom.terms import nodes, parse

PREFIX = T.StructType().add("prefix", "string").add("shown", "string").add("length", "integer")


def _shown(term, budget: list[int]) -> str:
    if budget[0] <= 0:
        return "…"
    budget[0] -= 1
    if not isinstance(term, tuple):
        return str(term)
    parts = []
    for x in term:
        if budget[0] <= 0:
            parts.append("…")
            break
        parts.append(_shown(x, budget))
    return f"({' '.join(parts)})"


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = ([], [], [])
        for text in batch.column(0).to_pylist():
            term = parse(text)
            key, length = "", 0
            items = list(nodes(term))
            for i, (_, kind, arity, sym, sub) in enumerate(items[:-1]):
                key += f"[{arity}]" if kind == "expr" else f"{sub}\x1f"
                length += 1 + (len(sym.encode()) if sym else 0)
                for to, x in zip(out, (key, _shown(term, [i + 1]), length), strict=True):
                    to.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32())], PREFIX.names)


def prefix_gains(atoms: DataFrame, cost: int) -> DataFrame:
    """(prefix, shown, length, n, gain) of the prefixes that pay."""
    each = atoms.select("term").mapInArrow(_prefixes, PREFIX)
    counted = each.groupBy("prefix").agg(F.min("shown").alias("shown"), F.max("length").alias("length"), F.count("*").alias("n"))
    return counted.withColumn("gain", (F.col("n") - 1) * F.col("length") - F.col("n") * cost).where("n >= 2 and gain > 0")


def relation_gains(rows: DataFrame, functor: str, cost: int) -> DataFrame:
    """The same for the columns of a relation, without Python: (depth, n, length, gain) and the columns, null where cut."""
    names = rows.columns
    level = sum((F.when(F.grouping(c) == 0, 1).otherwise(0) for c in names), F.lit(0))
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")) + 1, F.lit(0)) for c in names), F.lit(2 + len(functor.encode())))
    counted = rows.rollup(*names).agg(F.count("*").alias("n"), level.alias("depth"))
    counted = counted.withColumn("length", size.cast("long"))
    return counted.withColumn("gain", (F.col("n") - 1) * F.col("length") - F.col("n") * cost).where(f"depth < {len(names)} and n >= 2 and gain > 0")


def top_maximal(gains: DataFrame, k: int) -> list:
    """Greedily the heaviest prefixes of which none begins another; ties go to the smaller."""
    return weights.top_maximal(gains, k, "gain", "prefix")

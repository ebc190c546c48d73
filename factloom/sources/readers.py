"""Readers and writers: named tables, QDIMACS, JSON instances."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import cut
from factloom.space import Space


def write_table(rows: DataFrame, root: str, name: str) -> None:
    """A named table (ACT) that programs can match."""
    rows.write.mode("overwrite").parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str) -> Space:
    return Space(spark.read.parquet(f"{root}/{name}"))


QDIMACS = T.StructType().add("cid", "long").add("lit", "integer").add("block", "integer").add("quant", "string")

FORMULA = pa.schema([("cid", pa.int64()), ("lit", pa.int32()), ("block", pa.int32()), ("quant", pa.string())])


def _formula(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A file's clauses, (cid, lit), and prefix, (block, quant, lit); a clause ends with its 0, wherever lines end."""
    for batch in batches:
        for text in batch.column(0).to_pylist():
            rows, cid, block, last, named, used = [], 0, 0, "e", set(), set()
            lines = [line.split() for line in text.splitlines()]
            for words in lines:
                if not words or words[0] in ("c", "p"):
                    continue
                if words[0] in ("a", "e"):
                    # neighbours of one kind are one block; free variables come outermost, with the first existential ones
                    block, last = block + (words[0] != last), words[0]
                    some = [int(x) for x in words[1:] if x != "0"]
                    named.update(some)
                    rows += [(None, v, block, last) for v in some]
                    continue
                for x in map(int, words):
                    if x:
                        used.add(abs(x))
                        rows.append((cid, x, None, None))
                    else:
                        cid += 1
            rows += [(None, v, 0, "e") for v in sorted(used - named)]
            yield pa.RecordBatch.from_pylist([dict(zip(QDIMACS.names, r, strict=True)) for r in rows], schema=FORMULA)


def qdimacs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(block, quant, var) and (cid, lit) of a formula's file: adjacent blocks of one quantifier merged, free variables existential and outermost."""
    rows = cut(spark.read.text(path, wholetext=True).mapInArrow(_formula, QDIMACS))
    prefix = rows.where("cid is null").select("block", "quant", F.col("lit").alias("var"))
    return prefix, rows.where("cid is not null").select("cid", "lit")


def json_rows(spark: SparkSession, path: str, schema: str, required: list[str] = (), check: str | None = None) -> DataFrame:
    """Instances with a declared schema. Rows that don't fit it, lack a required field or fail `check`, a condition in SQL, raise an error."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
    bad = F.lit(False)
    for name in required:
        bad = bad | F.col(name).isNull()
    if check:
        bad = bad | ~F.coalesce(F.expr(check), F.lit(False))
    wrong = rows.where(bad).limit(1).collect()
    if wrong:
        raise ValueError(f"an instance that doesn't fit: {wrong[0]}")
    return rows

"""Names of columns that no table can clash with."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(name: str, columns: list[str]) -> str:
    """A name that none of `columns` has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(rows: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with all columns but `keep` numbered, and a function that gives a table of them its names and order back."""
    inner = [c if c in keep else f"_{i}_" for i, c in enumerate(rows.columns)]
    return rows.toDF(*inner), lambda out: out.select(*(F.col(f"`{c}`") for c in inner)).toDF(*rows.columns)

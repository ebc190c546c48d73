"""Tabling: results of patterns kept by pattern and space, if they took long enough and are small enough."""

import time

from pyspark.sql import DataFrame

from factloom.session import cut
from factloom.space import Space
from factloom.terms import canon, parse, render, variables


class Tables:
    def __init__(self, least_seconds: float = 0.05, most_rows: int = 4096, most_shapes: int = 256):
        self.least_seconds, self.most_rows, self.most_shapes = least_seconds, most_rows, most_shapes
        self.kept: dict[tuple, DataFrame] = {}
        self.hits = 0

    def query(self, space: Space, pattern: str) -> DataFrame:
        term = parse(pattern)
        key = (render(canon(term)), space.id)
        if key in self.kept:
            self.hits += 1
            return self.kept[key].toDF(*(v.name for v in variables(term)))
        began = time.monotonic()
        rows = space.query(pattern)
        if not rows.columns:
            return rows
        rows = cut(rows)
        if time.monotonic() - began >= self.least_seconds and len(self.kept) < self.most_shapes and rows.limit(self.most_rows + 1).count() <= self.most_rows:
            self.kept[key] = rows
        return rows


class Prepared:
    """A pattern read once, to be run on many spaces; its plan on a space is kept while that space is asked again."""

    def __init__(self, pattern: str):
        self.pattern, self.term = pattern, parse(pattern)
        self._space, self._plan = None, None

    def query(self, space: Space) -> DataFrame:
        if self._space != space.id:
            self._space, self._plan = space.id, space.query(self.pattern)
        return self._plan

    def count(self, space: Space) -> int:
        return space.count_matches(self.pattern)

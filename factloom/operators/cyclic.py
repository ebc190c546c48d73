"""Triangles in worst-case-optimal size: keys with many rows are joined another way round than those with few.

R(a, b), S(b, c), T(c, a). A value of b is heavy if S has more than the square root of its rows with it; there are at most as many heavy values as that. For
light ones R joined with S holds at most |R| * sqrt|S| rows; for heavy ones R joined with T on a at most |T| * sqrt|S|, since each row of T meets
each heavy value once. So no intermediate result passes the largest possible number of triangles, whatever the skew.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut
from factloom.space import natural_join


def triangles(r: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    """The natural join of three sets of rows, each two of which share one column."""
    (b,) = set(r.columns) & set(s.columns)
    r, s, t = (cut(x.distinct()) for x in (r, s, t))
    per_key = s.groupBy(b).agg(F.count("*").alias("_n"))
    heavy = cut(per_key.where(F.col("_n") > math.sqrt(max(1, s.count()))).select(b))
    light = natural_join([natural_join([r, s.join(heavy, b, "left_anti")]), t])
    columns = list(dict.fromkeys([*r.columns, *s.columns, *t.columns]))
    if heavy.isEmpty():
        return light.select(*columns)
    rest = natural_join([natural_join([r.join(heavy, b, "left_semi"), t]), s.join(heavy, b, "left_semi")])
    return light.select(*columns).unionByName(rest.select(*columns))

"""Every registered query with SQL against DuckDB over whole tables, and what plans must not hold."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom.catalogue import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DIR}/{name}'")
    return con


def rows(df):
    exact = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(repr(tuple(map(exact, r))) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


#: Factors of these share no variable, so a product is what they ask for.
PRODUCTS = {"q_cross", "q_outer", "q_space_query"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql_without_products_and_row_udfs(spark, oracle, name):
    got = QUERIES[name](spark, DIR)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert name in PRODUCTS or "CartesianProduct" not in plan and "NestedLoopJoin" not in plan and "BatchEvalPython" not in plan
    want = oracle.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got.toPandas()) == rows(want)


@pytest.mark.parametrize("name, pushed", [("q_point_query", "EqualTo(o_orderkey,7)"), ("q_column_seek", "EqualTo(o_custkey,11)"), ("q_column_seek", "EqualTo(o_orderstatus,O)")])
def test_constants_of_patterns_reach_the_files(spark, name, pushed):
    plan = spark._jvm.PythonSQLUtils.explainString(QUERIES[name](spark, DIR)._jdf.queryExecution(), "formatted")
    assert pushed in plan.split("PushedFilters")[1].split("\n")[0] and "EvalPython" not in plan and "Exchange" not in plan


def test_large_sums_by_a_rule_keep_their_digits(spark, tmp_path):
    """Sums of doubles to three places, beyond what a float holds, and from 1e7 on without an exponent."""
    rows = [(i, [float(d**4 * s) for d in range(64)]) for i, s in enumerate((1, 2, -0.25))] + [(3, [0.123] * 64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {r.term for r in QUERIES["q_tensor_sink"](spark, str(tmp_path)).collect()}
    assert got == {r[0] for r in con.execute(SQL["q_tensor_sink"]).fetchall()} and "(out 63 43320642.873)" in got


def test_pairs_of_one_key_are_shared_by_tasks(spark, tmp_path):
    """All parts of one size, and some of none: cells merge as in SQL, and the pairs don't all come from one task."""
    spark.createDataFrame([(i, 1 if i % 50 else None) for i in range(400)], "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = QUERIES["q_merge_cells"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert rows(got[["k1", "k2", "m"]]) == rows(con.execute(SQL["q_merge_cells"]).df()) and got["task"].nunique() > 1


def test_pairs_take_little_disk_on_their_way(spark, tmp_path):
    """Parts of one size: what is shuffled are lists, not copies of rows, and the pairs come in an order that a file makes small."""
    n = 2000
    spark.createDataFrame([(i, 1) for i in range(n)], "p_partkey long, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = shuffled()
    QUERIES["q_merge_cells"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    shuffled, written = shuffled() - before, sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    con.execute(f"CREATE VIEW got AS SELECT k1, k2, m FROM '{tmp_path}/out/*.parquet'")
    sums = "SELECT count(*), sum(hash(k1, k2, m)::HUGEINT) FROM"
    pairs = con.execute(f"{sums} got").fetchall()
    assert pairs == con.execute(f"{sums} ({SQL['q_merge_cells']})").fetchall()
    assert shuffled < 100 * n and written < pairs[0][0] / 3

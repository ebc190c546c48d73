"""The registered queries over the driver's tables, and the same in SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.demos import deduction, predictive, puzzle, qbf
from factloom.functions import subterms
from factloom.functions.scalar import expression, tanh_prime
from factloom.operators import aggregate, cyclic, guard, mining, order, tensor, weights
from factloom.operators.tabling import Prepared, Tables
from factloom.plans import fixpoint
from factloom.plans.rules import Program, rewrite_all
from factloom.session import cut
from factloom.space import Space, natural_join
from factloom.terms import parse

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            used = [text for name, text in VIEWS.items() if f" {name} " in f"{sql} ".replace("\n", " ").replace(",", " , ").replace(")", " )")]
            SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(used)} " if used else "") + sql if "RECURSIVE" not in sql else sql.replace("WITH RECURSIVE", "WITH RECURSIVE " + "".join(u + ", " for u in used))
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- relations that stand in for the facts of a space
VIEWS = {
    "edge": "edge AS (SELECT a, b FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders) WHERE b IS NOT NULL)",
    "supplies": "supplies AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)",
    "trade": "trade AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 49.5)",
    "cellv": "cellv AS (SELECT vec_id AS i, u.d AS d, embedding[u.d + 1]::DOUBLE AS v FROM embeddings, unnest(range(64)) u(d))",
}


def edge(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b is not null")


def supplies(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()


def trade(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 49.5").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return lines.select(F.col("s_nationkey").alias("a"), F.col("c_nationkey").alias("b")).distinct()


def cells(spark, d):
    """All components of all vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("d", "v"))
    return e.withColumn("v", F.col("v").cast("double"))


def orders(spark, d) -> Space:
    return Space.from_columns("order", table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), unique=True)


def edges(spark, d) -> Space:
    return Space.from_columns("edge", edge(spark, d))


def relation(df: DataFrame, *variables: str) -> DataFrame:
    """A promoted relation matched by a flat pattern: columns named by variables."""
    return df.toDF(*variables)


# ---- patterns
@query("SELECT o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders WHERE o_orderkey = 7")
def q_point_query(spark, d):
    """The leading argument is bound: a pushed filter."""
    return orders(spark, d).values("(order 7 $cust $status $price)")


@query("SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_custkey = 11 AND o_orderstatus = 'O'")
def q_column_seek(spark, d):
    """Other arguments are bound."""
    return orders(spark, d).values("(order $k 11 O $price)")


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS x FROM lineitem WHERE l_partkey = l_suppkey")
def q_repeated_var(spark, d):
    lines = Space.from_columns("line", table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), unique=True)
    return lines.values("(line $k $n $x $x)")


@query("SELECT 1 AS hit WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = 3 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 3))")
def q_ground_membership(spark, d):
    """A pattern without variables: whether the fact is there."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    owner = o.where("o_orderkey = 3").first()
    asked = f"(owner 3 {owner.o_custkey})" if owner else "(owner 3 none)"
    return Space.from_columns("owner", o).values(asked).select(F.lit(1).alias("hit"))


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 2")
def q_space_query(spark, d):
    """The same through terms: facts, a conjunction, canonical strings."""
    nations = Space.from_columns("nation", table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("n"), "n_regionkey"))
    regions = Space.from_columns("region", table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("n")))
    found = nations.union(regions).query("(, (region 2 $region) (nation $k $name 2))")
    return found.select("name", "region")


@query("SELECT o_orderkey::VARCHAR AS k FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 = 3")
def q_nested_pattern(spark, d):
    """Compound terms: (order key (owner (mod r) status)), matched inside."""
    o = table(spark, d, "orders")
    text = F.format_string("(order %d (owner (mod %d) %s))", "o_orderkey", (F.col("o_custkey") % 7).cast("long"), "o_orderstatus")
    return Space.from_texts(o.select(text.alias("text"))).query("(order $k (owner (mod 3) F))")


@query("SELECT c_custkey AS x, 'customer' AS f FROM customer WHERE c_nationkey = 1 UNION ALL SELECT s_suppkey, 'supplier' FROM supplier WHERE s_nationkey = 1")
def q_variable_functor(spark, d):
    """A variable in the place of the functor: all relations of that arity."""
    c = Space.from_columns("customer", table(spark, d, "customer").select("c_nationkey", "c_custkey"))
    s = Space.from_columns("supplier", table(spark, d, "supplier").select("s_nationkey", "s_suppkey"))
    return c.union(s).query("($f 1 $x)").select(F.col("x").cast("bigint").alias("x"), "f")


@query("SELECT DISTINCT '(status ' || o_orderstatus || ')' AS x FROM orders")
def q_bare_variable(spark, d):
    return Space.from_columns("status", table(spark, d, "orders").select("o_orderstatus")).query("$x")


@query("SELECT o_orderkey::VARCHAR AS k FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderpriority = '1-URGENT'")
def q_schematic(spark, d):
    """Facts with variables match by unification: (of key $any) for each urgent order, beside the ground facts of all."""
    o = table(spark, d, "orders")
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.format_string("(of %d $r)", "o_orderkey").alias("text"))
    return Space.from_columns("of", o.select("o_orderkey", "o_orderstatus")).union(Space.from_texts(urgent)).query("(of $k F)")


@query("SELECT user_id AS u, v FROM (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY user_id) WHERE v > 50")
def q_live_cells(spark, d):
    """Cells show their current value."""
    return _boxes(spark, d).query("(box $u $v)").select(F.col("u").cast("bigint").alias("u"), F.col("v").cast("double").alias("v")).where("v > 50")


def _boxes(spark, d) -> Space:
    """A fact (box user cell) for each user, and the cells at the values of the last events."""
    now = table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    cell = F.concat(F.lit("&cell:"), F.col("user_id").cast("string"))
    return Space.from_columns("box", now.select("user_id", cell.alias("cell")), unique=True).with_cells(now.select(F.col("user_id").alias("id"), F.col("v").cast("string").alias("value")))


@query("""SELECT y.user_id::VARCHAR AS u FROM (SELECT user_id, floor(arg_max(value, (ts, event_id)))::BIGINT % 10 AS v FROM events GROUP BY user_id) x
JOIN (SELECT user_id, floor(arg_max(value, (ts, event_id)))::BIGINT % 10 AS v FROM events GROUP BY user_id) y ON x.v = y.v WHERE x.user_id = (SELECT min(user_id) FROM events)""")
def q_cell_probe(spark, d):
    """A cell in the pattern matches all cells of its current value, here the last digit before the point."""
    boxes = _boxes(spark, d)
    digit = (F.floor(F.col("value").cast("double")).cast("bigint") % 10).cast("string")
    boxes = boxes.with_cells(boxes.cells.select("id", digit.alias("value")))
    least = table(spark, d, "events").agg(F.min("user_id")).first()[0]
    return boxes.query(f"(box $u &cell:{least})")


@query("SELECT x.o_orderkey::VARCHAR AS k, y.o_orderkey::VARCHAR AS m, (x.o_orderkey + 1)::VARCHAR AS n FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND y.o_orderkey > x.o_orderkey AND y.o_orderstatus = 'F' WHERE x.o_orderstatus = 'O'")
def q_computed_relations(spark, d):
    """Comparison and arithmetic as relations of a pattern."""
    return orders(spark, d).with_functions().query("(, (order $k $c O $p) (order $m $c F $s) (gtFn $m $k) (incFn $k $n))").select("k", "m", "n")


@query("SELECT p_partkey AS k FROM part WHERE p_brand = 'Brand#11' OR p_brand LIKE 'Brand#1%' AND p_size = 10")
def q_restrict_predicate(spark, d):
    return table(spark, d, "part").where("p_brand = 'Brand#11' or p_brand like 'Brand#1%' and p_size = 10").select(F.col("p_partkey").alias("k"))


@query("SELECT '(part ' || replace(p_brand, ' ', '_') || ' ' || p_size || ' ' || p_partkey || ')' AS term FROM part WHERE p_size = 10 AND p_brand = (SELECT MIN(p_brand) FROM part)")
def q_restrict(spark, d):
    """Terms under the ground beginning of a pattern; what follows its first variable doesn't count."""
    p = table(spark, d, "part").select(F.regexp_replace("p_brand", " ", "_").alias("b"), "p_size", "p_partkey")
    least = p.agg(F.min("b")).first()[0]
    return Space.from_columns("part", p).restrict(f"(part {least} 10 $k)").atoms.select("term")


@query("SELECT count(*) - count(CASE WHEN octet_length(encode(text)) BETWEEN 1 AND 63 THEN 1 END) AS n FROM documents")
def q_rejected(spark, d):
    """Facts outside the envelope of 1 to 63 bytes."""
    space = Space.from_columns("text", table(spark, d, "documents").select("text"))
    return spark.createDataFrame([(space.rejected_count(),)], "n long")


# ---- joins
@query("SELECT e1.a, e1.b, e2.b AS c FROM edge e1 JOIN edge e2 ON e1.b = e2.a")
def q_two_hop(spark, d):
    return edges(spark, d).values("(, (edge $a $b) (edge $b $c))")


@query("SELECT r_name, n_name, s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey")
def q_three_way(spark, d):
    r = table(spark, d, "region").toDF("r", "r_name")
    n = table(spark, d, "nation").toDF("n", "n_name", "r")
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n"), "s_name")
    return natural_join([s, n, r]).select("r_name", "n_name", "s_name")


@query("SELECT r_name, st FROM region CROSS JOIN (SELECT DISTINCT o_orderstatus AS st FROM orders)")
def q_cross(spark, d):
    return natural_join([table(spark, d, "region").select("r_name"), table(spark, d, "orders").select(F.col("o_orderstatus").alias("st")).distinct()])


@query("SELECT 1 AS one")
def q_empty_conj(spark, d):
    return Space.from_columns("x", table(spark, d, "region").select("r_regionkey")).query("(,)").select(F.lit(1).alias("one"))


@query("SELECT x.a, x.b, y.b AS c FROM trade x JOIN trade y ON x.b = y.a JOIN trade z ON y.b = z.a AND z.b = x.a")
def q_triangle(spark, d):
    t = cut(trade(spark, d))
    return cyclic.triangles(relation(t, "a", "b"), relation(t, "b", "c"), relation(t, "c", "a")).select("a", "b", "c")


@query("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def q_theta(spark, d):
    n = table(spark, d, "nation")
    return natural_join([n.select(F.col("n_nationkey").alias("x"), "n_regionkey"), n.select(F.col("n_nationkey").alias("y"), "n_regionkey")]).where("x < y").select("x", "y")


@query("SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def q_guard_negation(spark, d):
    """Facts that none of another relation keeps out."""
    big = Space.from_columns("customer", table(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey"))
    return Space.from_columns("customer", table(spark, d, "customer").select("c_custkey"), unique=True).subtract(big).values("(customer $k)")


@query("SELECT p_brand AS b, p_partkey AS w FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 1")
def q_choose(spark, d):
    return guard.choose(table(spark, d, "part"), ["p_brand"], [F.col("p_retailprice").desc(), F.col("p_partkey")]).select(F.col("p_brand").alias("b"), F.col("p_partkey").alias("w"))


@query("""SELECT x.k AS k1, y.k AS k2, CASE WHEN x.c = 'u' THEN y.c WHEN y.c = 'u' THEN x.c WHEN x.c = y.c THEN x.c END AS m
FROM (SELECT p_partkey AS k, p_size AS g, CASE p_partkey % 3 WHEN 0 THEN 'u' WHEN 1 THEN '0' ELSE '1' END AS c FROM part) x
JOIN (SELECT p_partkey AS k, p_size AS g, CASE p_partkey % 5 WHEN 0 THEN 'u' WHEN 1 THEN '0' ELSE '1' END AS c FROM part) y ON x.g = y.g
WHERE x.c = 'u' OR y.c = 'u' OR x.c = y.c""")
def q_merge_cells(spark, d):
    p = table(spark, d, "part")
    cell = lambda n: F.when(F.col("p_partkey") % n == 0, "u").when(F.col("p_partkey") % n == 1, "0").otherwise("1")
    x, y = p.select(F.col("p_partkey").alias("k1"), "p_size", cell(3).alias("c1")), p.select(F.col("p_partkey").alias("k2"), "p_size", cell(5).alias("c2"))
    return guard.merged(x, y, "p_size", "c1", "c2").select("k1", "k2", "m")


# ---- aggregates
@query("SELECT count(*) AS n FROM supplies x JOIN supplies y ON x.p = y.p")
def q_count_enum(spark, d):
    s = supplies(spark, d)
    return natural_join([s.toDF("x", "p"), s.toDF("y", "p")]).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM supplies x JOIN supplies y ON x.p = y.p")
def q_count_factorized(spark, d):
    space = Space.from_columns("supplies", supplies(spark, d), unique=True)
    return aggregate.fold(space.tables("(, (supplies $x $p) (supplies $y $p))"))


@query("SELECT count(*) AS n FROM edge x JOIN edge y ON x.b = y.a JOIN edge z ON y.b = z.a")
def q_count_chain(spark, d):
    e = edge(spark, d)
    return aggregate.fold([e.toDF("a", "b"), e.toDF("b", "c"), e.toDF("c", "d")])


@query("SELECT count(*) AS n FROM trade x JOIN trade y ON x.b = y.a JOIN trade z ON y.b = z.a AND z.b = x.a")
def q_count_cyclic(spark, d):
    t = trade(spark, d)
    return aggregate.fold([t.toDF("a", "b"), t.toDF("b", "c"), t.toDF("c", "a")])


@query("SELECT count(*) AS n, sum(l.s)::DOUBLE AS total, min(l.s)::DOUBLE AS least, max(l.s)::DOUBLE AS most FROM supplies l JOIN supplies r ON l.p = r.p")
def q_fact_sum_min(spark, d):
    s = supplies(spark, d)
    return aggregate.fold([s.toDF("s", "p"), s.toDF("t", "p")], "s")


@query("SELECT bool_and(l_quantity <= 50) AS holds FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def q_fact_and(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity") <= 50).alias("ok"))
    return aggregate.all_hold([lines, table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))], "ok")


@query("WITH RECURSIVE p(node, depth) AS (SELECT a, 0 FROM edge WHERE a NOT IN (SELECT b FROM edge) UNION SELECT e.b, p.depth + 1 FROM p JOIN edge e ON p.node = e.a) SELECT depth::INT AS depth, count(*) AS n FROM (SELECT node, min(depth) AS depth FROM p GROUP BY node) GROUP BY 1")
def q_layer_counts(spark, d):
    return q_bfs_layers(spark, d).groupBy("depth").agg(F.count("*").alias("n"))


@query("SELECT s FROM (SELECT DISTINCT l_suppkey AS s, l_returnflag AS f FROM lineitem) GROUP BY s HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)")
def q_forall(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"))
    return guard.divide(lines, "s", "f", lines)


@query("""SELECT b, t, n, len, gain FROM (SELECT b, t, n, len, ((n - 1) * len - n * 9)::BIGINT AS gain FROM (
SELECT p_brand AS b, p_type AS t, count(*) AS n, (6 + COALESCE(strlen(p_brand) + 1, 0) + COALESCE(strlen(p_type) + 1, 0))::BIGINT AS len, grouping(p_type) AS g
FROM part GROUP BY ROLLUP (p_brand, p_type, p_size) HAVING grouping(p_size) = 1)) WHERE n >= 2 AND gain > 0""")
def q_prefix_gain(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_type", "p_size")
    return mining.relation_gains(rows, "part", 9).select(F.col("p_brand").alias("b"), F.col("p_type").alias("t"), "n", F.col("length").alias("len"), "gain")


@query("SELECT COALESCE(p_brand, '*') AS b, COALESCE(p_size, -1) AS s, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_size)")
def q_rollup(spark, d):
    return table(spark, d, "part").rollup("p_brand", "p_size").agg(F.count("*").alias("n")).select(F.coalesce("p_brand", F.lit("*")).alias("b"), F.coalesce("p_size", F.lit(-1)).alias("s"), "n")


PREFIXES = """c0 AS (SELECT prefix, any_value(shown) AS shown, any_value(len) AS len, count(*) AS n FROM (SELECT u.* FROM
(SELECT replace(p_brand, ' ', '_') AS b, replace(p_type, ' ', '_') AS t, p_size FROM part GROUP BY ALL) p, LATERAL (VALUES
('[4]', '(…)', 1), ('[4]part' || chr(31), '(part …)', 6), ('[4]part' || chr(31) || b || chr(31), '(part ' || b || ' …)', 7 + strlen(b)),
('[4]part' || chr(31) || b || chr(31) || t || chr(31), '(part ' || b || ' ' || t || ' …)', 8 + strlen(b) + strlen(t))) u(prefix, shown, len)) GROUP BY prefix)"""
#: Five times the heaviest of what is left.
PICKS = ", ".join(
    f"t{i} AS (SELECT * FROM g{i} ORDER BY gain DESC, prefix LIMIT 1), g{i + 1} AS (SELECT g.* FROM g{i} g, t{i} t WHERE NOT starts_with(g.prefix, t.prefix) AND NOT starts_with(t.prefix, g.prefix))"
    for i in range(5)
)


@query(f"WITH {PREFIXES}, g0 AS (SELECT prefix, shown, (n - 1) * len - n * 9 AS gain FROM c0 WHERE n >= 2 AND (n - 1) * len - n * 9 > 0), {PICKS} SELECT shown AS pattern, gain::BIGINT AS gain FROM ({' UNION ALL '.join(f'SELECT * FROM t{i}' for i in range(5))})")
def q_topk_maximal(spark, d):
    space = Space.from_columns("part", table(spark, d, "part").select(F.regexp_replace("p_brand", " ", "_").alias("b"), F.regexp_replace("p_type", " ", "_").alias("t"), "p_size"))
    top = mining.top_maximal(cut(mining.prefix_gains(space.atoms, 9)), 5)
    return spark.createDataFrame([(r.shown, r.gain) for r in top], "pattern string, gain long")


@query("""SELECT COALESCE(p_brand, '*') AS b, COALESCE(p_type, '*') AS t, (CASE WHEN grouping(p_brand) = 0 AND grouping(p_type) = 0 THEN sum(w) ELSE 0 END)::BIGINT AS own, sum(greatest(w, 0))::BIGINT AS total
FROM (SELECT p_brand, p_type, sum(p_size - 10)::BIGINT AS w FROM part GROUP BY 1, 2) WHERE w > 0 GROUP BY ROLLUP (p_brand, p_type)""")
def q_weights(spark, d):
    """Signed weights of (brand, type) paths and the positive weight at or below each path."""
    own = table(spark, d, "part").groupBy(F.array("p_brand", "p_type").alias("path")).agg(F.sum(F.col("p_size") - 10).cast("long").alias("weight"))
    totals = weights.subtree_totals(weights.set_weights(spark.createDataFrame([], weights.WEIGHTS), own))
    return totals.select(F.coalesce(F.get("path", F.lit(0)), F.lit("*")).alias("b"), F.coalesce(F.get("path", F.lit(1)), F.lit("*")).alias("t"), F.col("weight").alias("own"), "total")


@query("SELECT p_brand AS b, p_type AS t, w FROM (SELECT p_brand, p_type, sum(p_size - 10)::BIGINT AS w FROM part GROUP BY 1, 2) WHERE w > 0 ORDER BY w DESC, p_brand, p_type LIMIT 5")
def q_top_weights(spark, d):
    """The five heaviest paths that begin none of each other; here all have one length."""
    own = table(spark, d, "part").groupBy(F.array("p_brand", "p_type").alias("path")).agg(F.sum(F.col("p_size") - 10).cast("long").alias("weight"))
    return spark.createDataFrame([(*r.path, r.weight) for r in weights.top_maximal(own, 5)], "b string, t string, w long")


@query("SELECT count(*) AS n FROM edge")
def q_shard_counts(spark, d):
    """Shards counted one by one add up to the space."""
    return edges(spark, d).shard_counts(7).agg(F.sum("n").alias("n"))


@query("""SELECT kind, count(*) AS n FROM (SELECT 'expr' AS kind FROM orders UNION ALL SELECT 'sym' FROM orders, range(3)) GROUP BY 1""")
def q_subterms(spark, d):
    """The nodes of terms by a table function."""
    subterms.register(spark)
    table(spark, d, "orders").select(F.format_string("(o %d %s)", "o_orderkey", "o_orderstatus").alias("term")).createOrReplaceTempView("_factloom_terms")
    return spark.sql("SELECT s.kind, count(*) AS n FROM _factloom_terms, LATERAL subterms(term) s GROUP BY s.kind")


# ---- set algebra, storage
@query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def q_union(spark, d):
    return _keys(table(spark, d, "customer").select("c_custkey")).union(_keys(table(spark, d, "orders").select("o_custkey"))).values("(key $k)")


def _keys(rows) -> Space:
    return Space.from_columns("key", rows)


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 50000")
def q_intersect(spark, d):
    return _keys(table(spark, d, "customer").select("c_custkey")).intersect(_keys(table(spark, d, "orders").where("o_totalprice > 50000").select("o_custkey"))).values("(key $k)")


@query("SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def q_subtract(spark, d):
    return _keys(table(spark, d, "orders").select("o_custkey")).subtract(_keys(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey"))).values("(key $k)")


def _nations(spark, d) -> Space:
    return Space.from_columns("of", table(spark, d, "nation").select("n_nationkey", "n_regionkey"))


def _owners(spark, d) -> Space:
    return Space.from_columns("of", table(spark, d, "orders").select("o_orderkey", "o_custkey"), unique=True)


@query("SELECT '(of ' || o_orderkey || ' ' || o_custkey || ')' AS term FROM orders WHERE o_orderkey <> 4")
def q_remove(spark, d):
    o = table(spark, d, "orders").where("o_orderkey = 4").first()
    return _owners(spark, d).remove(f"(of 4 {o.o_custkey if o else 0})")[0].atoms.select("term")


@query("SELECT '(of ' || o_orderkey || ' ' || CASE WHEN o_orderkey = 4 THEN -99 ELSE o_custkey END || ')' AS term FROM orders")
def q_replace(spark, d):
    o = table(spark, d, "orders").where("o_orderkey = 4").first()
    return _owners(spark, d).replace(f"(of 4 {o.o_custkey if o else 0})", "(of 4 -99)")[0].atoms.select("term")


@query("SELECT '(of ' || o_orderstatus || ' ' || o_orderkey || ')' AS term FROM orders WHERE o_orderstatus IN ('O', 'P')")
def q_space_algebra(spark, d):
    every = Space.from_columns("of", table(spark, d, "orders").select("o_orderstatus", "o_orderkey"))
    some = every.restrict("(of O $k)").union(every.restrict("(of F $k)")).union(every.restrict("(of P $k)"))
    return every.intersect(some).subtract(every.restrict("(of F $k)")).atoms.select("term")


@query("SELECT count(DISTINCT (l_suppkey, l_partkey)) AS n FROM lineitem")
def q_space_count(spark, d):
    space = Space.from_columns("supplies", table(spark, d, "lineitem").select("l_suppkey", "l_partkey"))
    return spark.createDataFrame([(space.count(),)], "n long")


@query("SELECT count(*) AS n FROM edge x JOIN edge y ON x.b = y.a")
def q_sharded_count(spark, d):
    """A space dealt over shards; the count is exact for any pattern, since joins cross shards."""
    return spark.createDataFrame([(edges(spark, d).sharded(16).count_matches("(, (edge $a $b) (edge $b $c))"),)], "n long")


# ---- rewriting
@query("SELECT DISTINCT x.a, y.b FROM edge x JOIN edge y ON x.b = y.a EXCEPT SELECT a, b FROM edge")
def q_transform(spark, d):
    """What a transform adds: instances of its template that weren't there."""
    before = edges(spark, d).pinned()
    after, _, _ = before.transform("(, (edge $x $m) (edge $m $y))", "(edge $x $y)")
    return after.subtract(before).values("(edge $a $b)")


@query("SELECT DISTINCT '(hop ' || x.a || ' (by ' || x.b || '))' AS term FROM edge x JOIN edge y ON x.b = y.a")
def q_space_transform(spark, d):
    """A template of compound terms."""
    return edges(spark, d).pinned().transform("(, (edge $x $m) (edge $m $y))", "(hop $x (by $m))")[0].restrict("(hop $x $y)").atoms.select("term")


@query("WITH RECURSIVE p(a, b) AS (SELECT a, b FROM edge UNION SELECT p.a, e.b FROM p JOIN edge e ON p.b = e.a) SELECT a, b FROM p")
def q_closure(spark, d):
    return fixpoint.closure(edge(spark, d))


@query("WITH RECURSIVE p(a, b) AS (SELECT a, b FROM edge UNION SELECT p.a, e.b FROM p JOIN edge e ON p.b = e.a) SELECT a, b FROM p")
def q_closure_recursive(spark, d):
    return fixpoint.recursive_closure(cut(edge(spark, d)))


@query("WITH RECURSIVE p(a, b) AS (SELECT a, b FROM trade UNION SELECT p.a, e.b FROM p JOIN trade e ON p.b = e.a) SELECT a, b FROM p")
def q_closure_cyclic(spark, d):
    return fixpoint.closure(trade(spark, d))


@query("WITH RECURSIVE p(term, normal) AS (SELECT a, b FROM edge UNION SELECT p.term, e.b FROM p JOIN edge e ON p.normal = e.a) SELECT term, normal FROM p WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.a = normal)")
def q_reduce(spark, d):
    """Chains as equations: a term's normal form is where no equation applies."""
    e = cut(edge(spark, d))
    return fixpoint.reduce_terms(e.toDF("lhs", "rhs"), e.select(F.col("a").alias("term")))


@query("SELECT '(add ' || repeat('(S ', x) || 'Z' || repeat(')', x) || ' ' || repeat('(S ', y) || 'Z' || repeat(')', y) || ')' AS term, repeat('(S ', x + y) || 'Z' || repeat(')', x + y) AS normal FROM (SELECT DISTINCT p_partkey % 7 AS x, p_size % 5 AS y FROM part)")
def q_reduce_terms(spark, d):
    """Sums of numerals by equations with variables."""
    rules = Space.from_text(spark, "(= (add Z $y) $y) (= (add (S $x) $y) (add $x (S $y)))")
    numeral = lambda n: F.concat(F.repeat(F.lit("(S "), n), F.lit("Z"), F.repeat(F.lit(")"), n))
    x, y = (F.col("p_partkey") % 7).cast("int"), (F.col("p_size") % 5).cast("int")
    terms = table(spark, d, "part").select(F.concat(F.lit("(add "), numeral(x), F.lit(" "), numeral(y), F.lit(")")).alias("term"))
    return rewrite_all(rules, terms)


@query("SELECT DISTINCT '(path ' || x.a || ' ' || y.b || ')' AS term FROM edge x JOIN edge y ON x.b = y.a")
def q_rule_step(spark, d):
    program = Program(edges(spark, d).add("(exec (1 hop) (, (edge $x $m) (edge $m $y)) (, (path $x $y)))"))
    program.run(5)
    return program.space.restrict("(path $x $y)").atoms.select("term")


@query("SELECT '(total ' || c_nationkey || ' ' || sum(c_custkey) || ')' AS term FROM customer GROUP BY c_nationkey UNION ALL SELECT '(double ' || c_custkey || ' ' || 2 * c_custkey || ')' FROM customer")
def q_rule_sinks(spark, d):
    """Folding and pure sinks."""
    rules = (
        "(exec (1 a) (, (of $n $r)) (O (sum (total $r $s) $s $n)))"
        "(exec (1 b) (, (of $n $r)) (O (pure (double $n $v) $v (i64_to_string (product_i64 (i64_from_string $n) (i64_from_string 2))))))"
    )
    program = Program(Space.from_columns("of", table(spark, d, "customer").select("c_custkey", "c_nationkey")).add(rules))
    program.run(5)
    return program.space.restrict("(total $r $s)").union(program.space.restrict("(double $n $v)")).atoms.select("term")


@query("""SELECT '(kept ' || min_by(p_partkey, (length(p_partkey::VARCHAR), p_partkey)) || ')' AS term FROM part
WHERE p_brand <> (SELECT min(p_brand) FROM part) AND p_size <> 10 GROUP BY p_brand, p_size""")
def q_guard_sink(spark, d):
    """A guard keeps one fact for each key that no stored key generalizes: stored are (item brand $size) of a brand and (item $brand 10)."""
    p = table(spark, d, "part").select(F.regexp_replace("p_brand", " ", "_").alias("b"), "p_size", "p_partkey")
    least = p.agg(F.min("b")).first()[0]
    rules = f"(seen (item {least} $s)) (seen (item $b 10)) (exec (1 g) (, (part $b $s $k)) (O (guard (seen (item $b $s)) (kept $k))))"
    program = Program(Space.from_columns("part", p).add(rules))
    program.run(2)
    return program.space.restrict("(kept $k)").atoms.select("term")


@query("SELECT '(out ' || d || ' ' || (round(sum(v), 3) + 0.0) || ')' AS term FROM cellv GROUP BY d")
def q_tensor_sink(spark, d):
    """An einsum written by a rule: the sums of all vectors, as facts (out dimension value). In doubles: a float's digits don't reach three places of large sums."""
    space = Space.from_columns("x", cells(spark, d).select("i", "d", "v"), unique=True)
    ones = Space.from_columns("w", table(spark, d, "embeddings").select("vec_id", F.lit(1.0)), unique=True)
    rule = "(exec 1 (, (w $i $one)) (O (tensor-op-f64 (op einsum ab,a->b) (inputs (x dense) (w dense)) (output (out dense)) (from (x $i $d $v) (w $i $o)) (backend auto))))"
    program = Program(space.union(ones).add(rule))
    program.run(2)
    made = program.space.values("(out $d $v)")
    v = F.round(F.col("v").cast("double"), 3) + 0.0
    # from 1e7 on Spark writes doubles with an exponent, SQL from 1e16 on
    plain = F.regexp_replace(v.cast("decimal(38,3)").cast("string"), r"(\.\d+?)0+$", "$1")
    shown = F.when((F.abs(v) >= 1e7) & (F.abs(v) < 1e16), plain).otherwise(v.cast("string"))
    return made.select(F.concat(F.lit("(out "), "d", F.lit(" "), shown, F.lit(")")).alias("term"))


@query("WITH RECURSIVE p(node, depth) AS (SELECT a, 0 FROM edge WHERE a NOT IN (SELECT b FROM edge) UNION SELECT e.b, p.depth + 1 FROM p JOIN edge e ON p.node = e.a) SELECT node, min(depth)::INT AS depth FROM p GROUP BY node")
def q_bfs_layers(spark, d):
    """From every node without a predecessor."""
    e = cut(edge(spark, d))
    first = e.join(e.select(F.col("b").alias("a")), "a", "left_anti")
    return fixpoint.layers(e, first.select(F.col("a").alias("node")))


@query("SELECT x.a, m.b AS mid, z.b FROM edge x JOIN edge m ON x.b = m.a JOIN edge y ON m.b = y.a JOIN edge z ON y.b = z.a")
def q_mitm(spark, d):
    """Paths of four by their middles: two forward meet two backward."""
    e = cut(edge(spark, d))
    half = cut(natural_join([e.toDF("a", "x"), e.toDF("x", "mid")]).select("a", "mid"))
    return natural_join([half, half.toDF("mid", "b")]).select("a", "mid", "b")


# ---- guards and covers
PATTERNS = "SELECT DISTINCT CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS b, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS s, CASE WHEN p_partkey % 5 = 0 THEN p_type END AS t FROM part WHERE NOT (p_partkey % 12 = 0 AND p_partkey % 5 <> 0)"


def _patterns(spark, d):
    """Wildcards in places that hang on the key; a key of wildcards alone would cover all others."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").where("not (p_partkey % 12 = 0 and p_partkey % 5 <> 0)")
    return p.select(F.when(k % 4 != 0, F.col("p_brand")).alias("b"), F.when(k % 3 != 0, F.col("p_size")).alias("s"), F.when(k % 5 == 0, F.col("p_type")).alias("t")).distinct()


COVER = "(g.b IS NULL OR g.b = x.b) AND (g.s IS NULL OR g.s = x.s) AND (g.t IS NULL OR g.t = x.t)"


@query(f"SELECT COALESCE(x.b, '*') AS b, COALESCE(x.s, -1) AS s, COALESCE(x.t, '*') AS t FROM ({PATTERNS}) x WHERE NOT EXISTS (SELECT 1 FROM ({PATTERNS}) g WHERE (g.b, g.s, g.t) IS DISTINCT FROM (x.b, x.s, x.t) AND {COVER})")
def q_antichain(spark, d):
    kept = guard.antichain(_patterns(spark, d), ["b", "s", "t"])
    return kept.select(F.coalesce("b", F.lit("*")).alias("b"), F.coalesce("s", F.lit(-1)).alias("s"), F.coalesce("t", F.lit("*")).alias("t"))


@query(f"WITH x AS ({PATTERNS}), k AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x g WHERE (g.b, g.s, g.t) IS DISTINCT FROM (x.b, x.s, x.t) AND {COVER})) SELECT (SELECT count(*) FROM x) AS patterns, (SELECT count(*) FROM k) AS kept, (SELECT count(*) FROM x WHERE NOT EXISTS (SELECT 1 FROM k g WHERE {COVER})) AS uncovered")
def q_coverage(spark, d):
    """Every pattern is generalized by one of the antichain's: none is left uncovered."""
    rows = cut(_patterns(spark, d))
    kept = cut(guard.antichain(rows, ["b", "s", "t"]))
    left = guard.uncovered(rows, kept, ["b", "s", "t"])
    return left.agg(F.count("*").alias("uncovered")).select(F.lit(rows.count()).cast("long").alias("patterns"), F.lit(kept.count()).cast("long").alias("kept"), "uncovered")


# ---- orders
@query("SELECT k, row_number() OVER (ORDER BY s, length(k), k)::INT AS rank FROM (SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS s FROM orders WHERE o_orderpriority < '3') ORDER BY 2 LIMIT 100")
def q_specificity(spark, d):
    """The first hundred matches of (order 1-URGENT $k): facts that agree before facts with a variable in that place."""
    o = table(spark, d, "orders").where("o_orderpriority < '3'")
    place = F.when(F.col("o_orderpriority") == "1-URGENT", "1-URGENT").otherwise("$any")
    space = Space.from_texts(o.select(F.format_string("(order %s %d)", place, "o_orderkey").alias("text")))
    first = space.query("(order 1-URGENT $k)", ordered=True).limit(100).collect()
    return spark.createDataFrame([(r.k, i + 1) for i, r in enumerate(first)], "k string, rank int")


@query("""SELECT term, row_number() OVER (ORDER BY kind, number, depth, name)::INT AS rank FROM (
SELECT n_nationkey::VARCHAR AS term, 0 AS kind, n_nationkey AS number, 0 AS depth, '' AS name FROM nation UNION ALL SELECT n_name, 1, 0, 0, n_name FROM nation
UNION ALL SELECT repeat('(S ', n_nationkey + 1) || 'Z' || repeat(')', n_nationkey + 1), 2, 0, n_nationkey, '' FROM nation
UNION ALL SELECT '(pair ' || n_name || ')', 3, 0, 0, n_name FROM nation UNION ALL SELECT '$' || n_name, 4, 0, 0, n_name FROM nation)""")
def q_priority(spark, d):
    """Numbers, symbols, numerals, other expressions, variables."""
    n, name = F.col("n_nationkey"), F.col("n_name")
    depth = (n + 1).cast("int")
    forms = [n.cast("string"), name, F.concat(F.repeat(F.lit("(S "), depth), F.lit("Z"), F.repeat(F.lit(")"), depth)), F.concat(F.lit("(pair "), name, F.lit(")")), F.concat(F.lit("$"), name)]
    terms = table(spark, d, "nation").select(F.explode(F.array(*forms)).alias("term"))
    ranked = order.sort_by_priority(terms).collect()
    return spark.createDataFrame([(r.term, i + 1) for i, r in enumerate(ranked)], "term string, rank int")


@query("SELECT term, row_number() OVER (PARTITION BY a ORDER BY length(b), b)::INT AS rank FROM (SELECT '(of ' || p_size || ' ' || p_partkey || ')' AS term, p_size AS a, p_partkey::VARCHAR AS b FROM part)")
def q_trie_order(spark, d):
    """The stored order among the parts of a size."""
    atoms = Space.from_columns("of", table(spark, d, "part").select("p_size", "p_partkey")).atoms
    keyed = atoms.select("term", F.element_at("node", F.lit("1"))["sym"].alias("size"), order.trie_order("term").alias("key"))
    return keyed.select("term", F.row_number().over(Window.partitionBy("size").orderBy("key")).alias("rank"))


# ---- tensors and functions
@query("SELECT x.d AS a, y.d AS b, round(sum(x.v * y.v), 4) AS v FROM cellv x JOIN cellv y ON x.i = y.i GROUP BY 1, 2")
def q_einsum_matmul(spark, d):
    """The Gram matrix of the components: all vectors against themselves."""
    c = cells(spark, d)
    return tensor.einsum("ia,ib->ab", c, c).select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), F.round("v", 4).alias("v"))


@query("SELECT x.i AS a, y.d AS b, round(x.v * y.v, 4) + 0.0 AS v FROM (SELECT i, sum(v) AS v FROM cellv GROUP BY i) x, (SELECT d, sum(v) AS v FROM cellv GROUP BY d) y")
def q_outer(spark, d):
    """Sums of vectors by sums of components."""
    c = cells(spark, d)
    rows, columns = c.groupBy("i").agg(F.sum("v").alias("v")), c.groupBy("d").agg(F.sum("v").alias("v"))
    return tensor.einsum("a,b->ab", rows, columns).select("a", F.col("b").cast("bigint").alias("b"), (F.round("v", 4) + 0.0).alias("v"))


@query("SELECT y.d AS b, round(sum(y.v * x.v), 4) AS v FROM cellv y JOIN (SELECT i, sum(v) AS v FROM cellv GROUP BY i) x ON y.i = x.i GROUP BY 1")
def q_transposed_matvec(spark, d):
    """All vectors, each weighted by the sum of its components."""
    c = cells(spark, d)
    return tensor.einsum("ab,a->b", c, c.groupBy("i").agg(F.sum("v").alias("v"))).select(F.col("b").cast("bigint").alias("b"), F.round("v", 4).alias("v"))


@query("SELECT i, d, round(tanh(v), 6) AS v, round(1 - tanh(v) * tanh(v), 6) AS slope FROM cellv")
def q_tanh(spark, d):
    """Functions of the registry, over all components."""
    c = cells(spark, d).withColumn("x", F.col("v").cast("string"))
    tanh = expression(parse("(tanh_f64 (f64_from_string $x))"))
    return c.select("i", F.col("d").cast("long").alias("d"), F.round(tanh, 6).alias("v"), F.round(tanh_prime(F.col("v")), 6).alias("slope"))


@query("SELECT i, d, round(sum(v), 6) AS v FROM (SELECT i, d, v FROM cellv UNION ALL SELECT i - 1, d, -0.5 * v FROM cellv) GROUP BY i, d")
def q_tensor_add(spark, d):
    """Each vector less half of the next."""
    c = cells(spark, d)
    return tensor.add(c, c.withColumn("i", F.col("i") - 1), -0.5).select("i", F.col("d").cast("bigint").alias("d"), F.round("v", 6).alias("v"))


@query("SELECT round(sum(v * v) / 2, 4) AS energy FROM cellv")
def q_energy(spark, d):
    return tensor.energy(cells(spark, d)).select(F.round("energy", 4).alias("energy"))


@query("SELECT o_orderkey AS k, (o_orderkey * 3 + o_custkey)::VARCHAR AS s, ((o_orderkey % 100)::TINYINT + 5::TINYINT)::VARCHAR AS t FROM orders")
def q_pure_arith(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("x"), F.col("o_custkey").cast("string").alias("y"), (F.col("o_orderkey") % 100).cast("string").alias("z"))
    big = expression(parse("(i64_to_string (sum_i64 (product_i64 (i64_from_string $x) (i64_from_string 3)) (i64_from_string $y)))"))
    small = expression(parse("(i8_to_string (sum_i8 (i8_from_string $z) (i8_from_string 5)))"))
    return o.select("k", big.alias("s"), small.alias("t"))


@query("SELECT e1.a::VARCHAR AS a, e2.b::VARCHAR AS c FROM edge e1 JOIN edge e2 ON e1.b = e2.a")
def q_tabled(spark, d):
    """The second call is answered from the table."""
    space, tables = edges(spark, d).pinned(), Tables(least_seconds=0.0, most_rows=2**31 - 2)
    tables.query(space, "(, (edge $a $b) (edge $b $c))")
    return tables.query(space, "(, (edge $a $b) (edge $b $c))").select("a", "c")


@query("SELECT count(*) AS n FROM edge x JOIN edge y ON x.b = y.a JOIN edge z ON y.b = z.a")
def q_prepared(spark, d):
    n = Prepared("(, (edge $a $b) (edge $b $c) (edge $c $d))").count(edges(spark, d))
    return spark.createDataFrame([(n,)], "n long")


# ---- composite algorithms
BESIDE_SQL = ", ".join(f"({i + 1}, {j + 1})" for i, cells_ in enumerate(puzzle.BESIDE) for j in cells_)


def _reach(name, start):
    return f"""{name}(state, depth) AS (SELECT '{start}', 0 UNION SELECT translate(state, '0' || substr(state, b.j, 1), substr(state, b.j, 1) || '0'), depth + 1
FROM {name} JOIN (VALUES {BESIDE_SQL}) b(i, j) ON b.i = instr(state, '0') WHERE depth < 3)"""


@query(f"""WITH RECURSIVE {_reach("f", "123456780")}, {_reach("k", "120453786")}, x AS (SELECT state, min(depth)::INT AS forward FROM f GROUP BY 1), y AS (SELECT state, min(depth)::INT AS backward FROM k GROUP BY 1),
m AS (SELECT state, forward, backward, forward + backward AS total FROM x JOIN y USING (state)) SELECT * FROM m WHERE total = (SELECT min(total) FROM m)""")
def q_puzzle_plan(spark, d):
    """Eight-puzzle layers from both ends and where they meet."""
    return puzzle.solve(spark, "123456780", "120453786", 3)


@query("SELECT * FROM (VALUES (1, 3), (3, 6), (5, 24), (7, 132)) t(k, n)")
def q_count_dp(spark, d):
    """Derivations by size, counted without listing them."""
    return deduction.count_derivations(spark, deduction.AXIOMS, 7).groupBy("k").agg(F.sum("n").cast("int").alias("n")).select(F.col("k").cast("int").alias("k"), "n")


@query("SELECT 0::BIGINT AS uncovered, true AS smaller")
def q_guarded_closure(spark, d):
    """Guarding by generality keeps fewer theorems, and leaves none of the full closure uncovered."""
    every, kept = cut(deduction.closure(spark, deduction.AXIOMS, 5)), cut(deduction.closure(spark, deduction.AXIOMS, 5, guarded=True))
    return spark.createDataFrame([(deduction.uncovered(every, kept).count(), kept.count() < every.count())], "uncovered long, smaller boolean")


@query("SELECT r_regionkey AS r, count(*) FILTER (n_nationkey % 2 = 0) > 0 AND count(*) FILTER (n_nationkey % 2 = 1) > 0 AS holds FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def q_qbf(spark, d):
    """For each region: for all x some y equals it, y being free to be what the parities of the region's nations allow."""
    parities = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_set((F.col("n_nationkey") % 2).cast("int")).alias("p"))
    out = []
    for r in parities.collect():  # a row for each region
        # y = x, and y is neither parity that no nation has
        clauses = [[1, -2], [-1, 2]] + ([] if 1 in r.p else [[-2]]) + ([] if 0 in r.p else [[2]])
        out.append((r.n_regionkey, qbf.value(spark, [("a", [1]), ("e", [2])], clauses)))
    return spark.createDataFrame(out, "r int, holds boolean")


#: Errors after a tick, from those before it.
TICK = """p{n} AS (SELECT i, tanh(pre.v + e{m}.v) AS v FROM pre JOIN e{m} USING (i)), g{n} AS (SELECT k, any_value(y.v) - sum(w2.v * p{n}.v) AS v FROM w2 JOIN p{n} USING (i) JOIN y USING (k) GROUP BY k),
b{n} AS (SELECT i, sum(w2.v * g{n}.v) AS v FROM w2 JOIN g{n} USING (k) GROUP BY i), e{n} AS (SELECT i, e{m}.v - 0.1 * (e{m}.v - (1 - p{n}.v * p{n}.v) * b{n}.v) AS v FROM e{m} JOIN p{n} USING (i) JOIN b{n} USING (i))"""


@query(f"""WITH RECURSIVE w1 AS (SELECT i % 8 AS i, d AS j, avg(v) AS v FROM cellv GROUP BY 1, 2), w2 AS (SELECT i % 4 AS k, d AS i, avg(v) AS v FROM cellv WHERE d < 8 GROUP BY 1, 2),
x AS (SELECT d AS j, avg(v) AS v FROM cellv GROUP BY 1), y AS (SELECT d - 8 AS k, avg(v) AS v FROM cellv WHERE d BETWEEN 8 AND 11 GROUP BY 1),
pre AS (SELECT i, sum(w1.v * x.v) AS v FROM w1 JOIN x USING (j) GROUP BY i), e0 AS (SELECT i, 0.0::DOUBLE AS v FROM pre), {TICK.format(n=1, m=0)}, {TICK.format(n=2, m=1)}
SELECT 1 AS tick, i, round(v, 6) + 0.0 AS v FROM e1 UNION ALL SELECT 2, i, round(v, 6) + 0.0 FROM e2""")
def q_predictive_coding(spark, d):
    """Two ticks of a predictive-coding network as tensor relations: 64 inputs, 8 hidden and 4 output units, with weights from means over all vectors."""
    c = cells(spark, d).withColumn("d", F.col("d").cast("bigint"))
    mean = lambda rows, *keys: cut(rows.groupBy(*keys).agg(F.avg("v").alias("v")))
    w1 = mean(c, (F.col("i") % 8).alias("i"), F.col("d").alias("j"))
    w2 = mean(c.where("d < 8"), (F.col("i") % 4).alias("i"), F.col("d").alias("j"))
    x, y = mean(c, F.col("d").alias("i")), mean(c.where("d between 8 and 11"), (F.col("d") - 8).alias("i"))
    return predictive.settle(spark, w1, w2, x, y, ticks=2).select("tick", "i", (F.round("v", 6) + 0.0).alias("v"))

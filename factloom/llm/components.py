"""Connected components of a graph in a table, as smallest labels, without collecting anything."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import cut


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, comp): the smallest id of each node's component, for nodes that have an edge (a, b).

    `labels`, from an earlier call over fewer edges, is where the search starts. Each round takes the
    least label around a node and then the label of that label, so paths shrink by half at least.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = both.select(F.col("a").alias("id")).distinct()
    if labels is None:
        now = nodes.withColumn("comp", F.col("id"))
    else:
        now = labels.unionByName(nodes.join(labels, "id", "left_anti").withColumn("comp", F.col("id")))
    now = cut(now)
    while True:
        around = both.join(now.withColumnsRenamed({"id": "b", "comp": "near"}), "b").groupBy(F.col("a").alias("id")).agg(F.min("near").alias("near"))
        # a component's own label also takes the least label that any of its members sees
        seen = now.join(cut(around), "id", "left").withColumn("low", F.least("comp", F.coalesce("near", "comp")))
        # written first: a join whose sides are plain shuffles may split a hot component
        roots = cut(seen.groupBy("comp").agg(F.min("low").alias("low")))
        linked = cut(seen.select("id", F.col("comp").alias("was"), "low").join(roots.select(F.col("comp").alias("was"), F.col("low").alias("root")), "was").select("id", "was", F.least("low", "root").alias("comp")))
        jump = linked.select(F.col("id").alias("comp"), F.col("comp").alias("up"))
        after = linked.join(jump, "comp", "left").select("id", "was", F.coalesce("up", "comp").alias("comp"))
        after = cut(after)
        changed = after.where("comp <> was").limit(1).count()
        now = after.select("id", "comp")
        if not changed:
            return now

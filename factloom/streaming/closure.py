"""A closure kept up to date from a stream of edges: each batch is matched against what is known, by semi-naive rounds.

What a batch adds is a table of its own under `root`, named by the batch, and the closure is all of them: a stream that starts again from its
checkpoint finds what it had, and a batch that comes again is done anew from the batches before it.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.plans.fixpoint import semi_naive
from factloom.session import cut, scratch_dir


class StreamedClosure:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or scratch_dir(spark)

    @property
    def paths(self) -> DataFrame | None:
        """(a, b) of all batches, or None before the first."""
        known = self._before(None)
        return None if known is None else known.select("a", "b")

    def _before(self, batch_id: int | None) -> DataFrame | None:
        try:
            known = self.spark.read.parquet(self.root)
        except AnalysisException:
            return None
        return known if batch_id is None else known.where(F.col("batch") < batch_id)

    def absorb(self, edges: DataFrame, batch_id: int = 0) -> None:
        """Takes a batch in; the same batch again changes nothing."""
        new = edges.select("a", "b").distinct()
        before = self._before(batch_id)
        known = None if before is None else before.select("a", "b")
        fresh = cut(new if known is None else new.join(known, ["a", "b"], "left_anti"))
        if known is None:
            known = fresh.limit(0)

        def step(delta, every):
            d, e = delta.alias("d"), every.unionByName(known).alias("e")
            ahead = d.join(e, F.col("d.b") == F.col("e.a")).select(F.col("d.a").alias("a"), F.col("e.b").alias("b"))
            behind = e.join(d, F.col("e.b") == F.col("d.a")).select(F.col("e.a").alias("a"), F.col("d.b").alias("b"))
            return ahead.unionByName(behind).join(known, ["a", "b"], "left_anti")

        semi_naive(fresh, step).write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def start(self, edges: DataFrame, checkpoint: str) -> StreamingQuery:
        return edges.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

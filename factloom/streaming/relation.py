"""A relation kept up to date from a stream: what a batch adds is written once, by its sort order for later seeks, and what is known stays as it is."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.session import scratch_dir
from factloom.space import Space


class StreamedRelation:
    """Facts (functor c1 … cn) of a stream's columns, a set. With `by`, a column, files of a batch hold ranges of it, so that seeks skip most of them."""

    def __init__(self, spark: SparkSession, functor: str, root: str | None = None, by: str | None = None):
        self.spark, self.functor, self.root, self.by = spark, functor, root or scratch_dir(spark), by

    def _before(self, batch_id: int | None) -> DataFrame | None:
        try:
            known = self.spark.read.parquet(self.root)
        except AnalysisException:
            return None
        return known if batch_id is None else known.where(F.col("batch") < batch_id)

    def absorb(self, rows: DataFrame, batch_id: int = 0) -> None:
        """Takes a batch in; the same batch again changes nothing."""
        facts = Space.from_columns(self.functor, rows)
        (new,) = facts.relations.values()
        known = self._before(batch_id)
        fresh = new if known is None else new.join(known, new.columns, "left_anti")
        if self.by:
            at = f"c{rows.columns.index(self.by) + 1}"
            fresh = fresh.repartitionByRange(at).sortWithinPartitions(at)
        fresh.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")

    def space(self) -> Space:
        """All facts so far."""
        known = self._before(None)
        if known is None:
            return Space(spark=self.spark)
        rows = known.drop("batch")
        return Space(relations={(self.functor, len(rows.columns) + 1): rows})

    def start(self, rows: DataFrame, checkpoint: str) -> StreamingQuery:
        return rows.writeStream.foreachBatch(self.absorb).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Session construction and the shared scratch folder used to cut lineage."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "factloom", **conf) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir, the folder all executors share.

    Only a local session may run without that setting; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = getattr(spark.sparkContext, "_factloom_scratch", None)
        if root is None:
            root = tempfile.mkdtemp(prefix="factloom-")
            spark.sparkContext._factloom_scratch = root
    path = f"{root.rstrip('/')}/factloom-{uuid.uuid4().hex}"
    _made(spark).append(path)
    return path


def _made(spark: SparkSession) -> list[str]:
    """The scratch folders of this session."""
    context = spark.sparkContext
    if not hasattr(context, "_factloom_made"):
        context._factloom_made = []
    return context._factloom_made


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that were cut inside once the block is left: results must be written or collected by then."""
    made = _made(spark)
    before = len(made)
    try:
        yield
    finally:
        conf = spark._jsc.hadoopConfiguration()
        while len(made) > before:
            path = spark._jvm.org.apache.hadoop.fs.Path(made.pop())
            path.getFileSystem(conf).delete(path, True)


class Parts:
    """A table that grows: each part is written once, and what is read is the list of all parts, put together once there are `MANY`."""

    MANY = 16

    def __init__(self, df: DataFrame):
        self.root, self.schema, self.spark = scratch_dir(df.sparkSession), df.schema, df.sparkSession
        self.paths, self.n, self.added = [], 0, 0
        self.append(df)

    def _write(self, df: DataFrame) -> str:
        path = f"{self.root}/{self.n}"
        seen = Observation()
        df.select(*(f"`{c}`" for c in self.schema.names)).observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        self.n, self.added = self.n + 1, seen.get["rows"]
        return path

    def _read(self, *paths: str) -> DataFrame:
        stored = self.spark.read.schema(self.schema).parquet(*paths)
        stored._factloom_stored = True
        return stored

    def append(self, df: DataFrame) -> DataFrame:
        """Writes the rows and returns them as stored; `added` is their number."""
        if len(self.paths) >= self.MANY:
            self.paths = [self._write(self.all())]
        self.paths.append(self._write(df))
        return self._read(self.paths[-1])

    def all(self) -> DataFrame:
        return self._read(*self.paths)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: computed once, no lineage.

    Unlike localCheckpoint the copy outlives executors; unlike checkpoint() the last stage runs once
    and later reads prune columns.
    """
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._factloom_stored = True
    return stored

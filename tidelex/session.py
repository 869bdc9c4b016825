"""Session settings, checkpointing and scratch folders."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

#: Codec of stored rows. Texts take some six tenths of their size under Parquet's default.
CODEC = "zstd"
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings that can be changed on a running session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
    # A table of many folders is listed by this many tasks, not by one for each folder.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows sent to Python at once: a worker holds a few MB of texts, however large the table is.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "tidelex", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only in local
    mode, where every task runs on this machine.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = getattr(sc, "_tidelex_folder", None)
        if folder is None:
            folder = tempfile.mkdtemp(prefix="tidelex-")
            sc._tidelex_folder = folder
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Copies:
    """Rows stored while a job needs them: a block that keeps the disk of a job small.

    ``add`` writes rows once, compressed, to a scratch folder and reads them from there; columns that are not asked
    for are not read. ``drop`` deletes what is not needed any more, the end of the block deletes the rest, so nothing
    that is returned may read it. Shuffle files go when the query that wrote them has ended; otherwise they stay
    until the driver happens to collect its garbage, and those of all steps lie on the disk together.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._held = spark, {}

    def __enter__(self) -> Copies:
        self._before = self.spark.conf.get(_DROP_SHUFFLES, None)
        self.spark.conf.set(_DROP_SHUFFLES, "true")
        return self

    def add(self, df: DataFrame, label: str) -> DataFrame:
        folder = scratch(self.spark, label)
        self._held[folder] = None
        # A column without a type has no values to store.
        rest = df.drop(*[f.name for f in df.schema.fields if isinstance(f.dataType, NullType)])
        rest.write.option("compression", CODEC).parquet(folder)
        copy = self.spark.read.schema(rest.schema).parquet(folder)
        copy = copy.select(*[F.col(f"`{c}`") if c in rest.columns else F.lit(None).alias(c) for c in df.columns])
        self._held[folder] = copy
        return copy

    def drop(self, *copies: DataFrame) -> None:
        for folder in [f for f, held in self._held.items() if any(held is c for c in copies)]:
            del self._held[folder]
            delete(self.spark, folder)

    def __exit__(self, *_) -> None:
        if self._before is None:
            self.spark.conf.unset(_DROP_SHUFFLES)
        else:
            self.spark.conf.set(_DROP_SHUFFLES, self._before)
        for folder in self._held:
            delete(self.spark, folder)
        self._held = {}


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and cut its lineage.

    Needed wherever a plan depends on values that a re-run of a lost task
    could change, such as partition numbers after a range shuffle.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)

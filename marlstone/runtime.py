"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}


def session(app: str = "marlstone", cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores where it lies in fewer files than there are: a file of one row group is one task, which matters
    to what is bound by computing. Tables of more files are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application's own below spark.checkpoint.dir, which all executors share.

    Where the setting is missing only a local master may go on, with a folder of this machine.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        _SCRATCH[app] = f"{root.rstrip('/')}/marlstone-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, app)
    return _SCRATCH[app]


def _forget(spark: SparkSession, app: str) -> None:
    path = _SCRATCH.pop(app, None)
    if path and spark.sparkContext._jsc is not None:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file systems, so that it works wherever the path lives."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most so many rows for what is planned and run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts: fewer rows than Spark's default, so that long texts fit in memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def release() -> None:
    """Give memory that is free back to the system. Python workers outlive their tasks, and what one kept of a large task
    would add to the memory of all later ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """`run`, a function for mapInArrow, with its memory released at a task's end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


class Stored:
    """A written table: `.df` reads it again without the plan that made it, `.drop()` frees its disk."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)
        for made in _SCOPES:
            made.append(self)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


_SCOPES: list[list[Stored]] = []


@contextlib.contextmanager
def scratch():
    """The tables that are stored inside, as a list; at the end those that are still in it are dropped. What is to stay is
    taken out of the list."""
    made: list[Stored] = []
    _SCOPES.append(made)
    try:
        yield made
    finally:
        _SCOPES.pop()
        for one in made:
            one.drop()


def store(df: DataFrame, name: str) -> Stored:
    """Write `df` as Parquet to the shared scratch folder and read it again. Unlike localCheckpoint the
    copy survives lost executors, and unlike checkpoint() it is columnar and compressed."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return Stored(spark, path, df.schema)


def store_bucketed(df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
    """As `store`, in buckets by a column: a later grouping by it takes the written side as it lies, without a shuffle."""
    spark = df.sparkSession
    table_name = f"marlstone_{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{scratch_root(spark)}/{table_name}"
    df.write.bucketBy(buckets, by).option("path", path).option("compression", "zstd").saveAsTable(table_name)
    # before the session's end, so that the catalogue keeps no name of a table that is gone
    atexit.register(_drop_table, spark, table_name)
    return spark.table(table_name)


def _drop_table(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")

"""Session helpers: where intermediate tables go, and when a side may be broadcast."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows a side may have before it is no longer broadcast (config-sized sides are a few hundred bytes a row).
BROADCAST_ROWS = 100_000


def broadcast_if(df: DataFrame, row_bound: int | None) -> DataFrame:
    """Broadcast ``df`` only when the caller can prove a row bound; otherwise the join is left to AQE."""
    return F.broadcast(df) if row_bound is not None and row_bound <= BROADCAST_ROWS else df


def broadcast_counted(table: DataFrame) -> DataFrame:
    """Broadcast a table that is already written, if its row count allows; else the join is left to AQE."""
    return broadcast_if(table, table.count())


def broadcast_days(df: DataFrame, day: str) -> DataFrame:
    """Broadcast a side with one small row per calendar day: dates bound its size. Other keys are left to AQE."""
    return F.broadcast(df) if isinstance(df.schema[day].dataType, T.DateType) else df


# The driver's own copies by application; they go when the driver ends.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package also where it is not installed: Spark hands them a copy, once per
    application."""
    application, package = spark.sparkContext.applicationId, Path(__file__).parent
    if application in _shipped or not package.is_dir():
        return
    _shipped[application] = tempfile.TemporaryDirectory(prefix="tidings-package-")
    archive = Path(_shipped[application].name) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as copy:
        for module in sorted(package.rglob("*.py")):
            copy.write(module, module.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))


def spread(df: DataFrame) -> DataFrame:
    """Split an input that has fewer splits than there are cores (one small file); a large table stays as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local session without one gets a scratch folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidings-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{shared_dir(spark).rstrip('/')}/tidings-{spark.sparkContext.applicationId}"


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table; reruns never overwrite a table another plan still reads."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_tables(spark: SparkSession, *paths: str | None) -> bool:
    """Delete intermediate tables that nothing reads any more; of no path (null) there is none."""
    done = False
    for path in filter(None, paths):
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        done = folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True) or done
    return done


def drop_scratch(spark: SparkSession) -> bool:
    """Delete this application's intermediate tables, once nothing that reads them is needed any more."""
    return drop_tables(spark, scratch_dir(spark))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here delete their shuffle files when they end, not when the driver collects garbage. For writes: what reads the
    table doesn't need them, and a lost file is made again while the write still runs."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def written(df: DataFrame, name: str, *parts: str) -> tuple[DataFrame, str]:
    """``df`` as a table of the shared folder, and its path. The files of its shuffles go as soon as it is written."""
    path = new_table_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def through_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and go on from the table, so that what follows never recomputes it."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

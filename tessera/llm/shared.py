"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_written: list[tuple[SparkSession, str]] = []
#: Spark's setting by which the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir')}/tessera-checkpoints"
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may be gone already
            pass


atexit.register(_drop_written)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What queries that begin meanwhile shuffle goes as they end; else it stays until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``checkpoint()``, which computes a frame twice, this runs the plan once;
    the files outlive lost executors and go when the driver ends. Shuffle files go as soon
    as the table is there.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    with _shuffles_go(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialise`` wrote for these frames; only for tables that no frame still to be computed reads."""
    for table in tables:
        _written.remove((table.sparkSession, table._path))
        _delete(table.sparkSession, table._path)


def hash_bucket(n: int, *cols: str | Column) -> Column:
    """An even spread over 0..n-1 that depends on the values of ``cols`` alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

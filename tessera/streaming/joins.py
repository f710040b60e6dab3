"""The symmetric hash join, where it belongs: between two streams.

Both sides are hashed by key into state and each new row probes the other side's. A time
bound and watermarks let state go; within the bound the result is that of the batch join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def stream_of(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table's files, read as a stream."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}*.parquet").parquet(folder)


def symmetric_join(left: DataFrame, right: DataFrame, key: str, time: str, within: str, lateness: str = "10 minutes") -> DataFrame:
    """Pairs with the same key whose right row comes within ``within`` after the left one.

    Columns of the right side are prefixed by ``r_``.
    """
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withWatermark(f"r_{time}", lateness)
    left = left.withWatermark(time, lateness)
    bound = (F.col(f"r_{time}") >= F.col(time)) & (F.col(f"r_{time}") <= F.col(time) + F.expr(f"INTERVAL {within}"))
    return left.join(right, (F.col(key) == F.col(f"r_{key}")) & bound)


def drained(df: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there into Parquet files under ``path``, and read them."""
    spark = df.sparkSession
    query = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")

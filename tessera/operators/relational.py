"""The relational operators, as functions from DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: The largest estimated size of a side that is sent to every executor.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def filtered(df: DataFrame, *conditions: Column) -> DataFrame:
    for c in conditions:
        df = df.where(c)
    return df


def projected(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[df[n] for n in names])


def distinct(df: DataFrame, *names: str) -> DataFrame:
    return (df.select(*names) if names else df).distinct()


def joined(left: DataFrame, right: DataFrame, condition: Column, algorithm: str = "auto") -> DataFrame:
    """An inner join: all columns of ``left``, then all of ``right``.

    ``auto`` leaves the choice to the optimizer. ``hash`` broadcasts the right side if its
    estimate is within BROADCAST_BYTES and else hashes both sides by key; ``symmetric`` always
    hashes both sides; ``merge`` sorts both; ``nested`` tests every pair and is for conditions
    without an equality: the smaller side is broadcast only if within the limit.
    """
    if algorithm in ("hash", "nested") and estimated_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right) if algorithm == "hash" else right.hint("broadcast"), condition)
    if algorithm in ("hash", "symmetric"):
        return left.join(right.hint("shuffle_hash"), condition)
    if algorithm == "merge":
        return left.join(right.hint("merge"), condition)
    return left.join(right, condition)


def total(df: DataFrame, value: Column, alias: str = "sum") -> DataFrame:
    return df.agg(F.sum(value).alias(alias))


def grouped_total(df: DataFrame, keys: Sequence[str], value: Column, alias: str = "sum") -> DataFrame:
    """The sum, then the keys as written; summed within tasks before the shuffle."""
    return df.groupBy(*keys).agg(F.sum(value).alias(alias)).select(alias, *keys)


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def bitmap_index(df: DataFrame, row_id: Column, *columns: str) -> DataFrame:
    """For each column, value and block of row numbers, a bitmap of the rows that have the value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    numbered = df.select(row_id.alias("_row"), *columns)  # before rows are multiplied
    rows = numbered.select(F.bitmap_bucket_number("_row").alias("bucket"), F.bitmap_bit_position("_row").alias("bit"), pairs.alias("p"))
    return rows.groupBy("p.column", "p.value", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def bitmap_count(index: DataFrame, wanted: Sequence[tuple[str, str]], how: str = "and") -> DataFrame:
    """Rows that have all (``and``) or any (``or``) of the (column, value) wanted."""
    test = F.lit(False)
    for column, value in wanted:
        test = test | ((F.col("column") == column) & (F.col("value") == value))
    combined = F.bitmap_and_agg("bitmap") if how == "and" else F.bitmap_or_agg("bitmap")
    blocks = index.where(test).groupBy("bucket").agg(combined.alias("bitmap"), F.count("*").alias("n"))
    if how == "and":  # a block that lacks one of the values has no row with all
        blocks = blocks.where(F.col("n") == len(wanted))
    return blocks.agg(F.coalesce(F.sum(F.bitmap_count("bitmap")), F.lit(0)).cast("long").alias("n_rows"))

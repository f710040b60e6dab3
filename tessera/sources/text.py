"""Text files whose fields end in a bar, and the sink that parts fields by bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def read_bars(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of ``|``-terminated fields, without quotes, escapes or a header.

    The dialect has no NULL: an empty field is 0 or the empty string.
    """
    rows = spark.read.schema(schema).option("sep", "|").option("quote", "").option("escape", "").option("emptyValue", "").csv(path)
    strings = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    return rows.fillna("", strings).fillna(0, [f.name for f in schema if f.name not in strings])


def _shown(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        plain = F.regexp_replace(c.cast("decimal(30,12)").cast("string"), r"0+$", "")
        return F.when(whole, F.concat(c.cast("long").cast("string"), F.lit(".0"))).when(F.abs(c) < 1e15, plain).otherwise(c.cast("string"))
    return c.cast("string")


def as_bars(df: DataFrame) -> DataFrame:
    """One column ``value``: the fields with bars between them; a whole FLOAT ends in ``.0``, NULL is empty."""
    return df.select(F.concat_ws("|", *[F.coalesce(_shown(f), F.lit("")) for f in df.schema]).alias("value"))


def write_bars(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    as_bars(df).write.mode(mode).text(path)

"""Proportional stratified interleaving, in DataFrame operations only.

Rows of a source are shuffled by a seeded hash and ranked; a row's place among all is
given by its fractional rank (rank less a seeded offset of its source, over the source's
rows), and the order by place is cut into shards of equal row counts. As every stretch
of places holds each source in proportion, every shard matches the mixture.

Ranks come from two levels, a count for each bucket and a row number inside it, so that
neither a hot source nor the whole table is ever sorted by one task.

Null text has size ``overhead`` and the CRC of no bytes; a null source is a source of its
own; a null id is a value like others; equal rows are told apart by nothing and may
change places; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import DataFrame, Window, functions as F

from .shared import materialise

#: Parts of one source's ranks, and of all places, at least: with more rows they grow with the root of their number.
RANK_BUCKETS, PLACE_BUCKETS = 1024, 4096


def _hash(seed: int, *cols) -> F.Column:
    """60 bits of an md5, so that other engines can compute it too."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def stratified_shards(df: DataFrame, id_col: str, text_col: str, source_col: str, shards: int, seed: int = 7, overhead: int = 16) -> DataFrame:
    """Id, size, text_crc32, shard and slot (gapless from 0 inside a shard) of every row."""
    source = F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.col(id_col)
    rows = df.select(row.alias("id"), source.alias("source"), _hash(seed, row).alias("h"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    root = df.count() ** 0.5
    bits = max(RANK_BUCKETS.bit_length() - 1, ceil(log2(root + 1)))
    places = max(PLACE_BUCKETS, ceil(root))
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - bits).cast("int"))
    # The counts need no text, so this scan reads two columns.
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    of_source = Window.partitionBy("source")
    before = of_source.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(of_source).alias("of"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "id", "crc", "size")
    ranked = rows.withColumn("rank", F.row_number().over(inside)).join(counts, ["source", "bucket"])
    shift = (_hash(seed + 1, F.col("source")) % F.lit(1_000_003) + 0.5) / F.lit(1_000_003.0)
    ranked = ranked.select("id", "size", "crc", "source", "h", ((F.col("before") + F.col("rank") - shift) / F.col("of")).alias("place"))
    ranked = materialise(ranked.withColumn("part", F.least(F.floor(F.col("place") * places), F.lit(places - 1)).cast("int")), "places")
    # One row for each part, the root of the input's number or PLACE_BUCKETS.
    parts = ranked.groupBy("part").agg(F.count("*").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy("place", "source", "h", "id", "crc", "size")
    placed = ranked.withColumn("at", F.row_number().over(inside) - 1).join(parts, "part").withColumn("at", F.col("at") + F.col("before"))
    placed = placed.withColumn("shard", F.expr(f"at * {shards}L div total").cast("int"))
    first = F.expr(f"(shard * total + {shards - 1}L) div {shards}L")
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") - first).alias("slot"))

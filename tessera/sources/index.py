"""Indexes: copies of a table that are sorted by one column.

The copy is range-partitioned and sorted, so Parquet's row-group statistics let a scan with
a comparison of that column skip nearly all of it. It keeps a stamp of the files that it was made
of; once the table has others, queries pass over it, so that no result depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .catalog import Catalog, CatalogError, IndexDef

#: Rows of a file of the copy, and of one of its row groups' skipping units.
ROWS_A_FILE = 4_000_000


def build_index(catalog: Catalog, name: str, table: str, column: str, path: str) -> IndexDef:
    """Write the sorted copy and register it."""
    if column not in catalog.table(table).columns:
        raise CatalogError(f"no column {column} in {table}")
    stamp, source = catalog.stamp(table), catalog.read(table)
    rows = catalog.row_count(table)
    if rows is None:
        rows = source.count()
    files = max(4, -(-rows // ROWS_A_FILE))
    source.repartitionByRange(files, column).sortWithinPartitions(column).write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)
    index = IndexDef(name, table, column, path, stamp)
    catalog.add_index(index)
    return index


def read_index(catalog: Catalog, index: IndexDef) -> DataFrame:
    return catalog.read_files(index.table, index.path)

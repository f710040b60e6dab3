"""A select-project-join-aggregate engine whose plans are Spark DataFrames."""

from .sources.catalog import Catalog, IndexDef, TableDef
from .engine import Engine

__all__ = ["Catalog", "Engine", "IndexDef", "TableDef"]

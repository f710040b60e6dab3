"""The engine: dialect text in, DataFrames out."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from .plans.dialect import CreateIndex, parse
from .plans.planner import Planner
from .sources.catalog import Catalog, IndexDef
from .sources.index import build_index
from .sources.text import read_bars, write_bars

#: Money and rates of the star schema are decimals, kept as doubles.
SCALES = {
    "customer": {"c_acctbal": (12, 2)},
    "supplier": {"s_acctbal": (12, 2)},
    "part": {"p_retailprice": (12, 2)},
    "orders": {"o_totalprice": (12, 2)},
    "lineitem": {"l_quantity": (6, 2), "l_extendedprice": (12, 2), "l_discount": (4, 2), "l_tax": (4, 2)},
}
#: What tells the rows of a table apart; lineitem has no such column.
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark, self.catalog = spark, catalog or Catalog(spark)

    @classmethod
    def over(cls, spark: SparkSession, folder: str, tables: tuple[str, ...] = STAR) -> Engine:
        """An engine over the Parquet tables of a folder."""
        engine = cls(spark)
        for t in tables:
            engine.catalog.defer_parquet(t, f"{folder}/{t}.parquet", SCALES.get(t), KEYS.get(t, ""))
        return engine

    def sql(self, text: str, algorithm: str = "auto", legacy_arith: bool = False, use_indexes: bool = True, strict_types: bool = False) -> DataFrame | IndexDef:
        statement = parse(text, legacy_arith)
        if isinstance(statement, CreateIndex):
            return self.create_index(statement.name, statement.table, statement.column)
        return Planner(self.catalog, algorithm, use_indexes, strict_types).plan(statement)

    def create_index(self, name: str, table: str, column: str, path: str | None = None) -> IndexDef:
        folder = self.spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        return build_index(self.catalog, name, table, column, path or f"{folder}/tessera_{name}_{zlib.crc32(self.catalog.data_file(table).encode()):x}")

    def load(self, table: str, text_path: str, parquet_path: str) -> DataFrame:
        """Bulk load of a bar-separated file: typed by the catalog, written as Parquet, registered."""
        read_bars(self.spark, text_path, self.catalog.schema(table)).write.mode("overwrite").parquet(parquet_path)
        self.catalog.set_data_file(table, parquet_path)
        return self.catalog.read(table)

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows added to a table's files. Its indexes and statistics no longer hold: the ones are passed over, the others forgotten."""
        kept = self.catalog.table(table)
        rows.select(*kept.columns).write.mode("append").parquet(kept.path)
        kept.rows, kept.distinct = None, {}
        return self.catalog.read(table)

    def outline(self, text: str) -> list[tuple[int, str]]:
        """The operators of a query's optimized plan, from the top, with their depth."""

        def below(node, depth: int) -> list[tuple[int, str]]:
            children = node.children()
            return [(depth, node.nodeName()), *(x for i in range(children.size()) for x in below(children.apply(i), depth + 1))]

        return below(self.sql(text)._jdf.queryExecution().optimizedPlan(), 0)

    def run_to(self, text: str, path: str) -> None:
        """Run a query into a bar-separated text sink."""
        write_bars(self.sql(text), path)

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The plan of a query with its estimates."""
        df = self.sql(text)
        jvm = self.spark.sparkContext._jvm
        return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

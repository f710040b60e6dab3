"""Tables, their statistics and their indexes.

The catalog is a registry of definitions, kept as JSON where it is saved; data stays in
Parquet. Statistics can be set by hand or gathered by Spark in one pass.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Types of the dialect. FLOAT with a scale, as FLOAT(12,2), stands for exact decimals.
TYPES = {"INTEGER": T.LongType(), "FLOAT": T.DoubleType(), "STRING": T.StringType()}


@dataclass
class TableDef:
    name: str
    columns: dict[str, str]  # name: INTEGER, FLOAT or STRING
    path: str = ""
    rows: int | None = None
    distinct: dict[str, int] = field(default_factory=dict)
    scales: dict[str, tuple[int, int]] = field(default_factory=dict)
    #: A column that tells all rows apart, where one is declared; only estimates rest on it.
    key: str = ""

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, TYPES[t]) for n, t in self.columns.items()])


@dataclass
class IndexDef:
    name: str
    table: str
    column: str
    path: str
    #: Stamp of the table's files that the copy was made of.
    source: str = ""


class CatalogError(ValueError):
    """A definition is missing, there twice or not valid."""


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._tables: dict[str, TableDef] = {}
        self._indexes: dict[str, IndexDef] = {}
        #: Tables whose files are not looked at before a query names them, and the schemas of files.
        self._deferred: dict[str, tuple[str, dict[str, tuple[int, int]] | None, str]] = {}
        self._files: dict[str, T.StructType] = {}

    # Definitions
    def create_table(self, name: str, columns: list[tuple[str, str]], path: str = "", scales: dict[str, tuple[int, int]] | None = None, key: str = "") -> TableDef:
        if name in self._tables or name in self._deferred:
            raise CatalogError(f"table {name} exists")
        if len({c for c, _ in columns}) < len(columns):
            raise CatalogError(f"a column of {name} is there twice")
        if unknown := [t for _, t in columns if t not in TYPES]:
            raise CatalogError(f"unknown type {unknown[0]}")
        if key and key not in dict(columns):
            raise CatalogError(f"no column {key} in {name}")
        self._tables[name] = TableDef(name, dict(columns), path, scales=scales or {}, key=key)
        return self._tables[name]

    def register_parquet(self, name: str, path: str, scales: dict[str, tuple[int, int]] | None = None, key: str = "") -> TableDef:
        """A table whose columns are those of Parquet files."""
        kinds, self._files[path] = [], self.spark.read.parquet(path).schema
        for f in self._files[path]:
            kinds.append((f.name, "INTEGER" if isinstance(f.dataType, T.IntegralType) else "FLOAT" if isinstance(f.dataType, (T.FractionalType, T.DecimalType)) else "STRING"))
        return self.create_table(name, kinds, path, scales, key)

    def defer_parquet(self, name: str, path: str, scales: dict[str, tuple[int, int]] | None = None, key: str = "") -> None:
        """Like ``register_parquet``, once the table is first used."""
        if name in self._tables or name in self._deferred:
            raise CatalogError(f"table {name} exists")
        self._deferred[name] = (path, scales, key)

    def drop_table(self, name: str) -> None:
        """Forget a table and its indexes; files stay."""
        self.table(name)
        del self._tables[name]
        self._indexes = {k: i for k, i in self._indexes.items() if i.table != name}

    def table(self, name: str) -> TableDef:
        if name in self._deferred:
            self.register_parquet(name, *self._deferred.pop(name))
        if name not in self._tables:
            raise CatalogError(f"no table {name}")
        return self._tables[name]

    def tables(self) -> list[str]:
        return sorted([*self._tables, *self._deferred])

    def attributes(self, name: str) -> list[str]:
        return list(self.table(name).columns)

    def schema(self, name: str) -> T.StructType:
        return self.table(name).schema()

    def read(self, name: str) -> DataFrame:
        return self.read_files(name, self.table(name).path)

    def read_files(self, name: str, path: str) -> DataFrame:
        """Files with the schema of a table's own, which spares a look at their footers."""
        known = self._files.get(self.table(name).path)
        return (self.spark.read.schema(known) if known else self.spark.read).parquet(path)

    # Statistics
    def row_count(self, name: str) -> int | None:
        return self.table(name).rows

    def set_row_count(self, name: str, rows: int) -> None:
        self.table(name).rows = rows

    def data_file(self, name: str) -> str:
        return self.table(name).path

    def set_data_file(self, name: str, path: str) -> None:
        self.table(name).path = path

    def distinct_count(self, name: str, column: str) -> int | None:
        return self.table(name).distinct.get(column)

    def set_distinct_count(self, name: str, column: str, n: int) -> None:
        if column not in self.table(name).columns:
            raise CatalogError(f"no column {column} in {name}")
        self.table(name).distinct[column] = n

    def analyze(self, name: str) -> None:
        """Rows and approximate distinct values of all columns, in one pass with partial aggregates."""
        table = self.table(name)
        got = self.read(name).agg(F.count("*").alias("_rows"), *[F.approx_count_distinct(c).alias(c) for c in table.columns]).first().asDict()
        table.rows = got.pop("_rows")
        table.distinct = got

    # Indexes
    def add_index(self, index: IndexDef) -> None:
        if index.name in self._indexes:
            raise CatalogError(f"index {index.name} exists")
        self._indexes[index.name] = index

    def index_on(self, table: str, column: str) -> IndexDef | None:
        return next((i for i in self._indexes.values() if (i.table, i.column) == (table, column)), None)

    def stamp(self, name: str) -> str:
        """A digest of the names, lengths and times of a table's files; another one after any load, append or rewrite."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.table(name).path)
        files, found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True), []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        return hashlib.md5("\n".join(sorted(found)).encode()).hexdigest()

    def usable_index(self, table: str, column: str) -> IndexDef | None:
        """The index on a column if its copy was made of the files that the table has now."""
        index = self.index_on(table, column)
        return index if index and index.source == self.stamp(table) else None

    def drop_index(self, name: str) -> None:
        """Forget an index; its copy stays."""
        if self._indexes.pop(name, None) is None:
            raise CatalogError(f"no index {name}")

    def has_index(self, table: str, column: str) -> bool:
        return self.index_on(table, column) is not None

    def indexes(self) -> list[IndexDef]:
        return [self._indexes[k] for k in sorted(self._indexes)]

    # As text, as a table, as a file
    def __str__(self) -> str:
        lines = []
        for name in self.tables():
            t = self.table(name)
            lines.append(f"{name} ({'?' if t.rows is None else t.rows} rows) {t.path}")
            lines += [f"    {c} {k} {t.distinct.get(c, '?')}" for c, k in t.columns.items()]
        lines += [f"index {i.name} on {i.table}({i.column}) {i.path}" for i in self.indexes()]
        return "\n".join(lines)

    def as_table(self) -> DataFrame:
        rows = [(t.name, i, c, k, t.rows, t.distinct.get(c)) for t in map(self.table, self.tables()) for i, (c, k) in enumerate(t.columns.items())]
        return self.spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, n_rows long, n_distinct long")

    def save(self, path: str) -> None:
        text = json.dumps({"tables": [asdict(self.table(t)) for t in self.tables()], "indexes": [asdict(i) for i in self._indexes.values()]})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        out = cls(spark)
        held = json.loads(spark.read.text(path, wholetext=True).first()[0])
        for t in held["tables"]:
            t["scales"] = {c: tuple(s) for c, s in t["scales"].items()}
            out._tables[t["name"]] = TableDef(**t)
        for i in held["indexes"]:
            out._indexes[i["name"]] = IndexDef(**i)
        return out

"""Command line.

    python -m tessera --catalog C create-table NAME COLUMN:TYPE ...
    python -m tessera --catalog C load TABLE TEXT_FILE PARQUET_FOLDER
    python -m tessera --catalog C add-folder FOLDER [TABLE ...]
    python -m tessera --catalog C analyze TABLE ...
    python -m tessera --catalog C query "SELECT ..." [--out FOLDER] [--explain]
    python -m tessera --catalog C query "CREATE INDEX i ON t (c)"
    python -m tessera --catalog C tables | drop-table NAME

The catalog is a folder that is written again after each change.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .engine import SCALES, STAR, Engine
from .sources.catalog import Catalog, CatalogError


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser("tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--catalog", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    create = commands.add_parser("create-table")
    create.add_argument("name")
    create.add_argument("columns", nargs="+", help="name:INTEGER, name:FLOAT or name:STRING")
    load = commands.add_parser("load")
    for name in ("table", "text", "parquet"):
        load.add_argument(name)
    folder = commands.add_parser("add-folder")
    folder.add_argument("folder")
    folder.add_argument("tables", nargs="*")
    commands.add_parser("analyze").add_argument("tables", nargs="+")
    query = commands.add_parser("query")
    query.add_argument("text")
    query.add_argument("--out", help="folder of the bar-separated result; else it is shown")
    query.add_argument("--explain", action="store_true", help="show the plan first")
    query.add_argument("--legacy-arith", action="store_true")
    commands.add_parser("tables")
    commands.add_parser("drop-table").add_argument("name")
    return parser.parse_args(argv)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    args = arguments(argv)
    spark = spark or SparkSession.builder.appName("tessera").getOrCreate()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(args.catalog)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    engine = Engine(spark, Catalog.load(spark, args.catalog) if there else None)
    catalog, changed = engine.catalog, True
    try:
        if args.command == "create-table":
            catalog.create_table(args.name, [tuple(c.split(":", 1)) for c in args.columns])
        elif args.command == "load":
            catalog.set_row_count(args.table, engine.load(args.table, args.text, args.parquet).count())
        elif args.command == "add-folder":
            for t in args.tables or STAR:
                catalog.register_parquet(t, f"{args.folder}/{t}.parquet", SCALES.get(t))
        elif args.command == "analyze":
            for t in args.tables:
                catalog.analyze(t)
        elif args.command == "drop-table":
            catalog.drop_table(args.name)
        elif args.command == "tables":
            print(catalog)
            changed = False
        else:
            result = engine.sql(args.text, legacy_arith=args.legacy_arith)
            if changed := not isinstance(result, DataFrame):
                print(f"index {result.name} on {result.table}({result.column})")
            else:
                if args.explain:
                    print(engine.explain(args.text))
                if args.out:
                    engine.run_to(args.text, args.out)
                else:
                    result.show(100, False)
        if changed:
            catalog.save(args.catalog)
    except (CatalogError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

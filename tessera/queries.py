"""Queries over the star schema, one or more for each operator, and SQL that gives the same rows.

Most are texts of the dialect, run by the engine as a user would. Money sums are exact
(decimal inside, double outside), so they don't depend on how rows are split.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .engine import STAR, Engine
from .operators import relational
from .sources.catalog import Catalog, IndexDef
from .sources.index import build_index
from .sources.text import as_bars, write_bars
from .streaming.joins import drained, stream_of, symmetric_join

_D = "CAST({} AS DECIMAL(12,2))".format
_NET = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) + CAST(l_quantity AS DECIMAL(6,2))) AS DOUBLE) AS sum"
_REVENUE = "CAST(SUM(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) AS sum"
_BALANCE = "CAST(SUM(CAST(c_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS sum"
_CHAIN = "l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey"

#: Name: dialect text, then the head of the select list in the SQL if it differs, then options.
TEXTS: dict[str, tuple] = {
    "scan_project": ("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > -1",),
    "select_star": ("SELECT * FROM supplier WHERE s_nationkey = 7",),
    "select_star_join": ("SELECT * FROM region, nation WHERE n_regionkey = r_regionkey",),
    "filter_eq_string": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",),
    "filter_lt_gt": ("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity < 3 AND l_extendedprice > 1000.0",),
    "filter_col_col": ("SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_suppkey < l_linenumber",),
    "filter_literal_left": ("SELECT o_orderkey, o_custkey FROM orders WHERE 250000.0 < o_totalprice AND 'O' = o_orderstatus",),
    "filter_conjunction": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000.0 AND o_orderdate > '1996-06-01'",),
    "filter_between_not_equal": ("SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_brand <> 'Brand#1'",),
    "sum_global": ("SELECT SUM(l_tax) FROM lineitem WHERE l_suppkey < 40 AND l_linenumber > 2", "CAST(SUM(CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS sum"),
    "sum_expr": ("SELECT SUM(l_extendedprice * (1 - l_discount) + l_quantity) FROM lineitem WHERE l_tax > 0.02 AND l_linenumber < 4", _NET),
    "sum_int": ("SELECT SUM(l_linenumber) FROM lineitem WHERE l_quantity > 30", "CAST(SUM(l_linenumber) AS BIGINT) AS sum"),
    "sum_int_add": ("SELECT SUM(l_linenumber + l_suppkey * 2 - 1) FROM lineitem WHERE l_orderkey < 5000", "CAST(SUM(l_linenumber + l_suppkey * 2 - 1) AS BIGINT) AS sum"),
    "sum_int_div": ("SELECT SUM(l_orderkey / l_linenumber) FROM lineitem WHERE l_linenumber > 1", "CAST(SUM(l_orderkey // l_linenumber) AS BIGINT) AS sum"),
    "sum_float_div": ("SELECT MAX(l_extendedprice / l_quantity) FROM lineitem WHERE l_quantity > 1", "MAX(l_extendedprice / l_quantity) AS max"),
    "sum_unary_minus": ("SELECT SUM(-l_linenumber + 1) FROM lineitem WHERE l_quantity < 5", "CAST(SUM(-l_linenumber + 1) AS BIGINT) AS sum"),
    "sum_legacy_arith": ("SELECT SUM(l_linenumber - l_suppkey - 1) FROM lineitem WHERE l_orderkey < 900", "CAST(SUM(l_linenumber - (l_suppkey - 1)) AS BIGINT) AS sum", {"legacy_arith": True}),
    "sum_empty": ("SELECT SUM(l_linenumber) FROM lineitem WHERE l_quantity < 0", "CAST(SUM(l_linenumber) AS BIGINT) AS sum"),
    "sum_with_stray_column": ("SELECT SUM(s_acctbal), n_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 2", "CAST(SUM(CAST(s_acctbal AS DECIMAL(12,2))) AS DOUBLE) AS sum"),
    "groupby_sum": ("SELECT SUM(l_extendedprice * (1 - l_discount) + l_quantity), l_linenumber FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_linenumber", _NET + ", l_linenumber"),
    "groupby_sum_multi": ("SELECT SUM(l_extendedprice * l_discount), l_returnflag, l_linestatus FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus", _REVENUE + ", l_returnflag, l_linestatus"),
    "groupby_without_sum": ("SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 1000.0 GROUP BY o_orderstatus, o_orderpriority",),
    "distinct_one": ("SELECT DISTINCT p_type FROM part WHERE p_size > 25 AND p_retailprice < 1500.0",),
    "distinct_multi": ("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_quantity > 5",),
    "join_2way_group": ("SELECT SUM(p_retailprice), l_returnflag FROM part, lineitem WHERE l_partkey = p_partkey AND l_quantity < 8 GROUP BY l_returnflag", "CAST(SUM(CAST(p_retailprice AS DECIMAL(12,2))) AS DOUBLE) AS sum, l_returnflag"),
    "join_theta": ("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey > n_nationkey AND s_acctbal < 500.0",),
    "join_multikey": ("SELECT o_orderkey, l_linenumber, s_name FROM orders, lineitem, supplier, customer WHERE o_orderkey = l_orderkey AND l_suppkey = s_suppkey AND o_custkey = c_custkey AND c_nationkey = s_nationkey",),
    "join_mixed_theta": ("SELECT c_custkey, o_orderkey FROM customer, orders WHERE c_custkey = o_custkey AND c_acctbal > o_totalprice",),
    "join_dup_keys": ("SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_nationkey = s_nationkey AND c_acctbal > 9500.0",),
    "join_3way_sum": ("SELECT SUM(o_totalprice) FROM nation, customer, orders WHERE n_nationkey = c_nationkey AND o_custkey = c_custkey AND n_regionkey < 3", "CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS sum"),
    "join_3way_project": ("SELECT p_name, s_name, l_shipdate FROM supplier, lineitem, part WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND p_size = 7 AND s_nationkey < 5",),
    "join_3way_group": ("SELECT SUM(l_extendedprice), s_suppkey FROM part, supplier, lineitem WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size > 10 GROUP BY s_suppkey", f"CAST(SUM({_D('l_extendedprice')}) AS DOUBLE) AS sum, s_suppkey"),
    "join_4way_group": ("SELECT SUM(l_quantity), p_brand FROM lineitem, part, supplier, nation WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 1 AND p_size < 30 GROUP BY p_brand", "CAST(SUM(CAST(l_quantity AS DECIMAL(6,2))) AS DOUBLE) AS sum, p_brand"),
    "join_5way_distinct": (f"SELECT DISTINCT n_name, o_orderpriority FROM region, nation, customer, orders, lineitem WHERE {_CHAIN} AND r_regionkey > 2 AND l_quantity > 48 AND o_totalprice < 150000.0",),
    "join_5way_project": (f"SELECT o_orderkey, l_linenumber, r_name FROM region, orders, nation, lineitem, customer WHERE {_CHAIN} AND l_tax = 0.08 AND c_mktsegment = 'MACHINERY'",),
    "join_cross": ("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < 2 AND n_nationkey < 3",),
    "join_hint_nlj": ("SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey > n_nationkey AND s_acctbal < 500.0", None, {"algorithm": "nested"}),
    "join_hint_hash": ("SELECT SUM(c_acctbal), c_name FROM orders, customer WHERE c_custkey = o_custkey GROUP BY c_name", _BALANCE + ", c_name", {"algorithm": "hash"}),
    "join_hint_shj": ("SELECT SUM(c_acctbal), c_name FROM orders, customer WHERE c_custkey = o_custkey GROUP BY c_name", _BALANCE + ", c_name", {"algorithm": "symmetric"}),
    "join_sort_merge": ("SELECT SUM(c_acctbal), c_name FROM orders, customer WHERE c_custkey = o_custkey GROUP BY c_name", _BALANCE + ", c_name", {"algorithm": "merge"}),
    "order_topk": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > -1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",),
    "order_by": ("SELECT SUM(l_linenumber), l_suppkey FROM lineitem WHERE l_quantity > 45 GROUP BY l_suppkey ORDER BY sum DESC, l_suppkey", "CAST(SUM(l_linenumber) AS BIGINT) AS sum, l_suppkey"),
    "agg_count_avg_min_max": (
        "SELECT COUNT(*), AVG(l_discount), MIN(l_extendedprice), MAX(l_shipdate), l_returnflag FROM lineitem WHERE l_quantity > 2 GROUP BY l_returnflag",
        "COUNT(*) AS count, CAST(SUM(CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / COUNT(l_discount) AS avg, MIN(l_extendedprice) AS min, MAX(l_shipdate) AS max, l_returnflag",
    ),
}
INDEXED: dict[str, str] = {
    "index_point": "c_custkey = 121",
    "index_upper": "c_custkey < 121",
    "index_lower": "c_custkey > 130",
    "index_range": "c_custkey > 21 AND c_custkey < 121",
    "index_residual": "c_custkey > 21 AND c_custkey < 121 AND c_mktsegment = 'HOUSEHOLD'",
    "index_absent_bound": "c_custkey > -5 AND c_custkey < 99999999",
}


def _text_query(text: str, options: dict) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Engine.over(spark, sf_dir).sql(text, **options)


def _sql(text: str, head: str | None) -> str:
    if head:
        distinct, tail = "", text[text.index(" FROM ") :]
        return f"SELECT {distinct}{head}{tail}"
    return text


_built: dict[tuple[int, str], IndexDef] = {}


def _with_index(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine whose customer and orders tables have indexes; copies are written once a session."""
    engine = Engine.over(spark, sf_dir)
    for name, table, column in (("customer_by_key", "customer", "c_custkey"), ("orders_by_customer", "orders", "o_custkey")):
        key = (id(spark), f"{sf_dir}/{name}")
        if key not in _built or _built[key].source != engine.catalog.stamp(table):
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            _built[key] = build_index(engine.catalog, name, table, column, f"{folder}/tessera_{name}_{zlib.crc32(sf_dir.encode()):08x}")
        else:
            engine.catalog.add_index(_built[key])
    return engine


def _index_text(where: str) -> str:
    return f"SELECT SUM(o_totalprice), o_orderpriority FROM orders, customer WHERE o_custkey = c_custkey AND {where} GROUP BY o_orderpriority"


def _index_query(where: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _with_index(spark, sf_dir).sql(_index_text(where))


def bitmap_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Engine.over(spark, sf_dir).catalog.read("lineitem")
    index = relational.bitmap_index(rows, F.monotonically_increasing_id(), "l_returnflag", "l_linestatus")
    wanted = [("l_returnflag", "R"), ("l_linestatus", "F")]
    both, either = (relational.bitmap_count(index, wanted, how) for how in ("and", "or"))
    return both.select(F.lit("and").alias("op"), "n_rows").unionByName(either.select(F.lit("or").alias("op"), "n_rows"))


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.over(spark, sf_dir).catalog.as_table().select("table_name", "position", "column_name", "type")


def catalog_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = Engine.over(spark, sf_dir).catalog
    for t in STAR:
        catalog.analyze(t)
    return catalog.as_table().where("position = 0").select("table_name", "n_rows")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera_{name}_{uuid.uuid4().hex}"


def tbl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier through the text sink, with the bar that ends a line, and the bulk loader."""
    engine = Engine.over(spark, sf_dir, ("supplier",))
    path = _scratch(spark, "bars")
    as_bars(engine.catalog.read("supplier")).selectExpr("value || '|' AS value").write.text(path)
    return engine.load("supplier", path, path + "_parquet")


def pipe_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that the text sink writes, read back."""
    path = _scratch(spark, "sink")
    write_bars(Engine.over(spark, sf_dir).sql("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey > -1"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def parquet_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written, then appended to."""
    rows, path = Engine.over(spark, sf_dir).catalog.read("region"), _scratch(spark, "append")
    rows.write.parquet(path)
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path)


_EXPLAINED = "SELECT SUM(l_tax), n_regionkey FROM lineitem, supplier, nation WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND l_quantity > 40 GROUP BY n_regionkey"


def explain_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each kind of operator the plan of a query has; the full text is ``Engine.explain``."""
    found = [(name.split()[0],) for _, name in Engine.over(spark, sf_dir).outline(_EXPLAINED)]
    return spark.createDataFrame(found, "operator string").where("operator IN ('Aggregate', 'Join', 'Filter', 'Relation', 'LogicalRelation')").groupBy(F.regexp_replace("operator", "^Logical", "").alias("operator")).agg(F.count("*").alias("n"))


def index_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE INDEX as text, then a range that the copy serves."""
    engine = Engine.over(spark, sf_dir)
    engine.sql("CREATE INDEX part_by_size ON part (p_size)")
    return engine.sql("SELECT p_partkey, p_brand FROM part WHERE p_size > 44")


def index_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that gets rows after its index was made: the copy is passed over."""
    source, engine, path = Engine.over(spark, sf_dir), Engine(spark), _scratch(spark, "suppliers")
    rows = source.catalog.read("supplier")
    rows.write.parquet(path)
    engine.catalog.register_parquet("supplier", path)
    engine.create_index("supplier_by_nation", "supplier", "s_nationkey", path + "_index")
    engine.append("supplier", rows.where("s_nationkey < 9"))
    return engine.sql("SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey > 5")


def catalog_life_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions made, changed, saved, loaded and dropped."""
    catalog, path = Catalog(spark), _scratch(spark, "catalog")
    catalog.create_table("stay", [("k", "INTEGER"), ("price", "FLOAT"), ("note", "STRING")], "/nowhere")
    catalog.create_table("go", [("k", "INTEGER")])
    catalog.set_row_count("stay", 7)
    catalog.set_distinct_count("stay", "k", 5)
    catalog.save(path)
    loaded = Catalog.load(spark, path)
    loaded.drop_table("go")
    return loaded.as_table()


def stream_symmetric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with what the same user bought within ten minutes, as two streams."""
    events = lambda kind: stream_of(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    pairs = symmetric_join(events("click"), events("purchase"), "user_id", "ts", "10 MINUTES")
    return drained(pairs.select("event_id", "user_id", "r_event_id"), _scratch(spark, "stream"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: _text_query(v[0], v[2] if len(v) > 2 else {}) for k, v in TEXTS.items()},
    **{k: _index_query(v) for k, v in INDEXED.items()},
    **{f.__name__: f for f in (bitmap_and_or, catalog_tables, catalog_statistics, tbl_roundtrip, pipe_sink, parquet_append, explain_plan, index_by_text, index_after_append, catalog_life_cycle, stream_symmetric_join)},
}
_COUNTS = "SELECT COUNT(*) AS n_rows FROM lineitem WHERE l_returnflag = 'R' {} l_linestatus = 'F'"
ORACLE_SQL: dict[str, str] = {
    **{k: _sql(v[0], v[1] if len(v) > 1 else None) for k, v in TEXTS.items()},
    **{k: _sql(_index_text(v), "CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS sum, o_orderpriority") for k, v in INDEXED.items()},
    "bitmap_and_or": f"SELECT 'and' AS op, n_rows FROM ({_COUNTS.format('AND')}) UNION ALL SELECT 'or' AS op, n_rows FROM ({_COUNTS.format('OR')})",
    "catalog_statistics": " UNION ALL ".join(f"SELECT '{t}' AS table_name, COUNT(*) AS n_rows FROM {t}" for t in STAR),
    "tbl_roundtrip": "SELECT s_suppkey, s_name, CAST(s_nationkey AS BIGINT) AS s_nationkey, s_acctbal FROM supplier",
    "pipe_sink": "SELECT n_nationkey || '|' || n_name || '|' || n_regionkey AS line FROM nation",
    "catalog_tables": f"SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name, CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'INTEGER' WHEN data_type = 'DOUBLE' THEN 'FLOAT' ELSE 'STRING' END AS type FROM information_schema.columns WHERE table_name IN {STAR}",
    "catalog_life_cycle": "SELECT * FROM (VALUES ('stay', 0, 'k', 'INTEGER', CAST(7 AS BIGINT), CAST(5 AS BIGINT)), ('stay', 1, 'price', 'FLOAT', 7, NULL), ('stay', 2, 'note', 'STRING', 7, NULL)) t(table_name, position, column_name, type, n_rows, n_distinct)",
    "explain_plan": "SELECT * FROM (VALUES ('Aggregate', CAST(1 AS BIGINT)), ('Join', 2), ('Filter', 3), ('Relation', 3)) t(operator, n)",
    "index_by_text": "SELECT p_partkey, p_brand FROM part WHERE p_size > 44",
    "index_after_append": "SELECT s_suppkey, s_nationkey FROM (SELECT * FROM supplier UNION ALL SELECT * FROM supplier WHERE s_nationkey < 9) WHERE s_nationkey > 5",
    "parquet_append": "SELECT * FROM region UNION ALL SELECT * FROM region",
    "stream_symmetric_join": "SELECT a.event_id, a.user_id, b.event_id AS r_event_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'click' AND b.event_type = 'purchase'",
}

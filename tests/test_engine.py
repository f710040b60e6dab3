import pytest
from pyspark.sql import functions as F

from tessera import Catalog, Engine
from tessera.operators import relational
from tessera.plans.dialect import DialectError
from tessera.sources.catalog import CatalogError
from tessera.sources.text import as_bars, read_bars


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def engine(spark, small):
    return Engine.over(spark, small)


def test_join_algorithms(engine):
    text = "SELECT SUM(c_acctbal), c_name FROM orders, customer WHERE c_custkey = o_custkey GROUP BY c_name"
    for algorithm, node in (("hash", "BroadcastHashJoin"), ("symmetric", "ShuffledHashJoin"), ("merge", "SortMergeJoin")):
        assert node in plan(engine.sql(text, algorithm))
    assert "BroadcastNestedLoopJoin" in plan(engine.sql("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_nationkey", "nested"))


def test_large_side_is_not_broadcast(engine, monkeypatch):
    monkeypatch.setattr(relational, "BROADCAST_BYTES", 0)
    assert "ShuffledHashJoin" in plan(engine.sql("SELECT c_name FROM orders, customer WHERE c_custkey = o_custkey", "hash"))


def test_filters_and_columns_reach_the_scan(engine):
    text = plan(engine.sql("SELECT SUM(l_discount) FROM lineitem WHERE l_quantity < 5 AND l_linenumber = 2"))
    assert "LessThan(l_quantity,5.0)" in text and "EqualTo(l_linenumber,2)" in text
    assert "ReadSchema: struct<l_linenumber:int,l_quantity:double,l_discount:double>" in text


def test_sums_are_partial_before_the_shuffle(engine):
    assert "partial_sum" in plan(engine.sql("SELECT SUM(l_linenumber), l_suppkey FROM lineitem GROUP BY l_suppkey"))


def test_top_k(engine):
    assert "TakeOrderedAndProject" in plan(engine.sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 3"))


def test_index_is_read_only_where_it_helps(spark, small, tmp_path):
    engine = Engine.over(spark, small)
    engine.create_index("by_key", "customer", "c_custkey", str(tmp_path / "by_key"))
    text = "SELECT c_name FROM customer WHERE {}"
    assert str(tmp_path) in plan(engine.sql(text.format("c_custkey = 5")))
    assert str(tmp_path) in plan(engine.sql(text.format("7 > c_custkey")))
    assert str(tmp_path) not in plan(engine.sql(text.format("c_acctbal > 5.0")))
    assert str(tmp_path) not in plan(engine.sql(text.format("c_custkey = 5"), use_indexes=False))
    with pytest.raises(CatalogError):
        engine.create_index("by_key", "customer", "c_custkey", str(tmp_path / "again"))
    with pytest.raises(CatalogError):
        engine.create_index("other", "customer", "nothing", str(tmp_path / "other"))


def test_an_index_copy_is_sorted_across_files(spark, small, tmp_path):
    engine = Engine.over(spark, small)
    index = engine.sql("CREATE INDEX by_order ON lineitem (l_orderkey)")
    spans = spark.read.parquet(index.path).groupBy(F.input_file_name()).agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b")).orderBy("a").collect()
    assert len(spans) == 4 and all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_errors(engine):
    for text in ("SELECT nothing FROM nation", "SELECT n_name FROM nation WHERE nothing = 1", "SELECT n_name, SUM(n_nationkey) FROM nation GROUP BY n_regionkey", "SELECT n_name FROM nation, nation"):
        with pytest.raises(DialectError):
            engine.sql(text)
    with pytest.raises(CatalogError):
        engine.sql("SELECT a FROM nothing")
    with pytest.raises(DialectError):
        engine.sql("SELECT n_name FROM nation WHERE n_nationkey = 'x'", strict_types=True)


def test_catalog(spark, small, tmp_path):
    catalog = Catalog(spark)
    catalog.create_table("t", [("a", "INTEGER"), ("b", "STRING")], "somewhere", {"a": (5, 0)})
    for columns in ([("a", "INTEGER")], ):
        with pytest.raises(CatalogError):
            catalog.create_table("t", columns)
    with pytest.raises(CatalogError):
        catalog.create_table("u", [("a", "INTEGER"), ("a", "STRING")])
    with pytest.raises(CatalogError):
        catalog.create_table("u", [("a", "Name")])
    catalog.register_parquet("nation", f"{small}/nation.parquet")
    catalog.analyze("nation")
    assert catalog.row_count("nation") == 25 and 24 <= catalog.distinct_count("nation", "n_nationkey") <= 27
    catalog.set_row_count("t", 7)
    catalog.set_distinct_count("t", "b", 3)
    catalog.set_data_file("t", "elsewhere")
    catalog.save(str(tmp_path / "catalog"))
    again = Catalog.load(spark, str(tmp_path / "catalog"))
    assert str(again) == str(catalog) and again.tables() == ["nation", "t"] and again.data_file("t") == "elsewhere"
    assert again.attributes("t") == ["a", "b"] and again.table("t").scales == {"a": (5, 0)}
    again.drop_table("t")
    with pytest.raises(CatalogError):
        again.table("t")


def test_text_source_and_sink(spark, tmp_path):
    catalog = Catalog(spark)
    catalog.create_table("t", [("k", "INTEGER"), ("x", "FLOAT"), ("s", "STRING")])
    (tmp_path / "in.tbl").write_text('1|2.5|a "quoted" word|\n2|3|back\\slash|\n3|||\n')
    rows = read_bars(spark, str(tmp_path / "in.tbl"), catalog.schema("t"))
    assert [tuple(r) for r in rows.collect()] == [(1, 2.5, 'a "quoted" word'), (2, 3.0, "back\\slash"), (3, 0.0, "")]
    assert [r[0] for r in as_bars(rows).collect()] == ['1|2.5|a "quoted" word', "2|3.0|back\\slash", "3|0.0|"]
    big = spark.sql("SELECT 2033940.0D AS a, -0.125D AS b, CAST(NULL AS INT) AS c")
    assert as_bars(big).first()[0] == "2033940.0|-0.125|"


def test_run_to_a_sink_and_explain(engine, spark, tmp_path):
    engine.run_to("SELECT r_regionkey, r_name FROM region WHERE r_regionkey < 1", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    assert "Physical Plan" in engine.explain("SELECT * FROM region")


def test_division_by_zero_is_null(engine):
    assert engine.sql("SELECT SUM(n_nationkey / n_regionkey) FROM nation WHERE n_regionkey = 0").first()[0] is None
    assert engine.sql("SELECT MAX(1.0 / n_regionkey) FROM nation WHERE n_regionkey = 0").first()[0] is None


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["sum"]
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


def test_an_index_of_other_files_is_passed_over(spark, small, tmp_path):
    engine = Engine(spark)
    path = str(tmp_path / "numbers")
    spark.range(10).selectExpr("id AS k", "id * 2 AS v").write.parquet(path)
    engine.catalog.register_parquet("numbers", path)
    engine.create_index("by_k", "numbers", "k", str(tmp_path / "by_k"))
    count = lambda: engine.sql("SELECT COUNT(*) FROM numbers WHERE k > 5").first()[0]
    assert count() == 4 and "by_k" in plan(engine.sql("SELECT k FROM numbers WHERE k > 5"))
    engine.append("numbers", spark.range(10, 20).selectExpr("id AS k", "id AS v"))
    assert count() == 14 and "by_k" not in plan(engine.sql("SELECT k FROM numbers WHERE k > 5"))
    spark.range(7).selectExpr("id AS k", "id AS v").write.parquet(str(tmp_path / "fewer"))
    engine.catalog.set_data_file("numbers", str(tmp_path / "fewer"))
    assert count() == 1


def test_joins_start_where_the_estimated_join_is_smallest(spark, small):
    """A large table that its filter and key make small comes before a small one that multiplies rows."""
    engine = Engine.over(spark, small)
    for t, n, distinct in (("lineitem", 6000, {"l_orderkey": 1500, "l_suppkey": 10}), ("orders", 1500, {"o_orderkey": 1500}), ("supplier", 10, {"s_suppkey": 10, "s_nationkey": 2}), ("customer", 150, {"c_nationkey": 2})):
        engine.catalog.set_row_count(t, n)
        for c, k in distinct.items():
            engine.catalog.set_distinct_count(t, c, k)
    text = "SELECT o_orderkey, c_custkey FROM lineitem, orders, supplier, customer WHERE l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND s_nationkey = c_nationkey AND o_orderkey = 7"
    names = [n for _, n in engine.outline(text)]
    assert names.count("Join") == 3
    whole = engine.sql(text)
    assert whole.columns == ["o_orderkey", "c_custkey"]
    assert whole.exceptAll(engine.sql(text, algorithm="merge")).count() == 0


def test_tables_meet_by_a_key_before_they_multiply(spark, small):
    """Customers and suppliers of one nation are joined last, also where nothing but keys is known."""
    from tessera.queries import TEXTS

    engine = Engine.over(spark, small)
    for t, n in (("lineitem", 36_000_000), ("orders", 9_000_000), ("customer", 900_000), ("supplier", 60_000)):
        engine.catalog.set_row_count(t, n)
    plan_of = engine.sql(TEXTS["join_multikey"][0])._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan_of.splitlines() if "Join Inner" in line]
    assert len(joins) == 3 and "nationkey" in joins[0] and "key" in joins[0].replace("nationkey", "") and not any("nationkey" in j for j in joins[1:])
    with pytest.raises(CatalogError):
        Catalog(spark).create_table("t", [("a", "INTEGER")], key="b")

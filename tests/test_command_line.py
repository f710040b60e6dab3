from tessera.__main__ import main


def test_from_text_to_result(spark, tmp_path, capsys):
    (tmp_path / "t.tbl").write_text("1|2.5|x|\n2|3.0|y|\n")
    run = lambda *a: main(["--catalog", str(tmp_path / "catalog"), *a], spark)
    assert run("create-table", "t", "k:INTEGER", "v:FLOAT", "s:STRING") == 0
    assert run("load", "t", str(tmp_path / "t.tbl"), str(tmp_path / "t.parquet")) == 0
    assert run("analyze", "t") == 0
    assert run("query", "CREATE INDEX i ON t (k)") == 0
    assert run("query", "SELECT s, v FROM t WHERE k > 1", "--out", str(tmp_path / "out"), "--explain") == 0
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "y|3.0"
    assert run("tables") == 0
    shown = capsys.readouterr().out
    assert "t (2 rows)" in shown and "index i on t(k)" in shown and "Physical Plan" in shown
    assert run("query", "SELECT nothing FROM t") == 1
    assert run("drop-table", "t") == 0 and run("query", "SELECT k FROM t") == 1


def test_a_folder_of_parquet(spark, small, tmp_path, capsys):
    run = lambda *a: main(["--catalog", str(tmp_path / "catalog"), *a], spark)
    assert run("add-folder", small, "nation", "region") == 0
    assert run("query", "SELECT COUNT(*) FROM nation, region WHERE n_regionkey = r_regionkey") == 0
    assert "25" in capsys.readouterr().out

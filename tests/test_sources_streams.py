import json

import pytest
from pyspark.sql import functions as F

from loomscribe.sources import readers, sinks
from loomscribe.streaming import logs


def test_csv_frame(spark, tmp_path):
    (tmp_path / "frame_a.csv").write_text("domain,company,vertical,region,stratum,industry_raw,employees,country,source_ref\n a.example , A ,saas,eu,x,,,fr,1\n,no,,,,,,,\n")
    (tmp_path / "frame_b.csv").write_text("domain,company,vertical,region,stratum,industry_raw,employees,country,source_ref\nb.example,B,,,,,,,\n")
    got = sorted((r["domain"], r["company"], r["vertical"], r["file_stem"]) for r in readers.csv_frame(spark, str(tmp_path / "frame_*.csv")).collect())
    assert got == [("a.example", "A", "saas", "frame_a"), ("b.example", "B", None, "frame_b")]


def test_json_log_skips_the_cut_line(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"k": 1, "v": "a"}\n\n{"k": 1, "v": "b"}\n{"k": 2, "v": "c')
    log = readers.json_log(spark, str(tmp_path / "log.jsonl"), "k int, v string")
    assert sorted((r["k"], r["v"]) for r in log.collect()) == [(1, "a"), (1, "b")]
    sinks.compact(log, ["k"], [F.col("v")], str(tmp_path / "out"))
    assert [(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "b")]
    with pytest.raises(Exception):
        sinks.compact(log, ["k"], [F.col("v")], str(tmp_path / "out"))


def test_json_documents(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"seed": 1, "doc_split": {"a": "train", "b": "val"}}, indent=1))
    assert {r["key"]: r["value"] for r in readers.json_map(spark, str(tmp_path / "s.json"), "doc_split").collect()} == {"a": "train", "b": "val"}
    (tmp_path / "s.md").write_text('# Schema\n```json\n{"a": 3}\n```\nend')
    assert readers.fenced_json(spark, str(tmp_path / "s.md"), "a int").first()["a"] == 3


def test_html(spark):
    page = "<title> My\n page </title><meta name='description' content='About us'><table><tr><th>Company</th><th>Rank[1]</th></tr><tr><td><b>Acme</b></td><td>2</td></tr></table><a href='/x'>Acme  Inc</a><a href='/y'>ACME inc</a><a href='/h'>Home</a><a href='/z'>Zeta</a>"
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert [r["cells"] for r in readers.html_rows(df, "html", 2).collect()] == [["Company", "Rank"], ["Acme", "2"]]
    assert sorted((r["url"], r["label"]) for r in readers.html_links(df, "html").collect()) == [("/x", "Acme Inc"), ("/z", "Zeta")]
    assert df.select(readers.page_title("html").alias("t")).first()["t"] == "My page | About us"


def test_title_with_attributes_in_any_order(spark):
    pages = ['<meta content="One" name=description><TITLE lang="x">T</TITLE>', "<title>only</title>", "<meta name='description' content='It\"s'>", "", None, "<title>" + "x" * 400 + "</title>"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "page_id int, html string")
    assert [r["t"] for r in df.orderBy("page_id").select(readers.page_title("html").alias("t")).collect()] == ["T | One", "only", 'It"s', "", "", "x" * 150]


def test_picked_table(spark):
    rows = "".join(f"<tr><td>{i}</td><td>n{i}</td></tr>" for i in range(4))
    page = f"<table><tr><th>Nav</th></tr>{rows}</table><table><tr><th>Rank</th><th>Name</th></tr>{rows[:30]}</table><TABLE x=1><tr><th>Rank</th><th>Name</th></tr>{rows}</TABLE><table><tr><th>Rank</th></tr>{rows}</table>"
    df = spark.createDataFrame([(1, page), (2, "no table"), (3, None)], "page_id int, html string")
    got = readers.pick_table(df, "html", "<th>Rank", 3).collect()
    assert [(r["page_id"], r["cells"]) for r in got] == [(1, [str(i), f"n{i}"]) for i in range(4)]


def test_archive_lines(spark, tmp_path):
    (tmp_path / "i").write_text("timestamp url mime status\n20200101000000 http://a/x text/html 200\n20230101000000 http://a/y text/html 200\nbad line\n")
    assert [(r["url"], r["status"]) for r in readers.archive_lines(spark, str(tmp_path / "i"), "20221031").collect()] == [("http://a/x", 200)]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1, 0.12345), (None, None, None)], "k string, n int, x double")
    assert [r["line"] for r in sinks.markdown_rows(df).collect()] == ["| a\\|b | 1 | 0.123 |", "| - | - | - |"]
    assert sinks.markdown_head(["k", "n"]) == ("| k | n |", "|---|---|")
    sinks.json_report(df, str(tmp_path / "r"), seed=7)
    assert {(r["k"], r["seed"]) for r in spark.read.json(str(tmp_path / "r")).collect()} == {("a|b", 7), (None, 7)}
    with pytest.raises(Exception):
        sinks.json_report(df, str(tmp_path / "r"))


def test_archive_index(spark, tmp_path):
    (tmp_path / "i").write_text("timestamp url mime status\n20200101000000 http://a/x text/html 200\n20230101000000 http://a/y text/html 200\nbad line\n")
    spark.dataSource.register(readers.ArchiveIndex)
    got = spark.read.format("archive_index").option("paths", str(tmp_path / "i")).option("upto", "20221031").load().collect()
    assert [(r["url"], r["status"]) for r in got] == [("http://a/x", 200)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    sinks.write_csv(df, str(tmp_path / "csv"), ["y", "x"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["y", "x"]
    assert sinks.migrate(df, [("x", "long"), ("z", "string")]).first().asDict() == {"x": 1, "z": None}
    a, b = sinks.manifest(df, "t").first(), sinks.manifest(df.orderBy(F.desc("x")), "t").first()
    assert a == b and a["digest"] != sinks.manifest(df.limit(1), "t").first()["digest"]
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    sinks.export_by(df, str(tmp_path / "parts"), "y")
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 2


def test_log_stream(spark, tmp_path):
    path = str(tmp_path / "calls.parquet")
    spark.createDataFrame([(1, 1, "old"), (1, 3, "new"), (2, 1, "x")], "k int, t int, v string").repartition(3).write.parquet(path)
    got = logs.compacted(logs.read_log(spark, path), ["k"], ["t"])
    assert {r["k"]: r["v"] for r in got.collect()} == {1: "new", 2: "x"}
    n = logs.folded_counts(logs.read_log(spark, path), [F.col("k")])
    assert {r["k"]: r["n"] for r in n.collect()} == {1: 2, 2: 1}

import json

import pytest
from pyspark.sql import functions as F, types as T

from gridloom.sources import sinks, tables
from gridloom.sources.graphml import read_graphml
from gridloom.streaming import live

SCHEMA = T.StructType([T.StructField("city", T.StringType()), T.StructField("area", T.DoubleType())])


def test_csv_contract(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿city,area,other\n﻿Rom,12.5,x\nBern,bad,y\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA, ["city"]).collect()] == [("Rom", 12.5), ("Bern", None)]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "a.csv"), SCHEMA, ["missing"])


def test_parquet_projection_optional_and_many(spark, tmp_path):
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "p1"))
    spark.range(2).withColumn("y", F.lit(2)).write.parquet(str(tmp_path / "p2"))
    both = tables.read_parquet(spark, [str(tmp_path / "p1"), str(tmp_path / "p2")], ["id", "y", "nothing"])
    assert both.columns == ["id", "y"] and both.count() == 5
    assert tables.read_optional(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    assert tables.match_column(["Main Name 2025", "ID"], ["name"], [["main", "name"]]) == "Main Name 2025"
    assert tables.match_column(["b name", "Name", "N-ame"], ["title", "name"], [["b"]]) == "Name" and tables.match_column(["x"], ["y"]) is None and tables.match_column([], ["y"]) is None
    assert tables.canonical_columns(spark.createDataFrame([(1,)], "`Avg Degree` int"), {"degree": ["avg_degree"]}).columns == ["degree"]
    assert tables.first_available(None, spark.range(0), spark.range(4)).count() == 4


def test_history_json(spark, tmp_path):
    (tmp_path / "h.json").write_text(json.dumps({"city_id": "a", "indicator": "n", "result": [{"timestamp": "2010-01-01T00:00:00Z", "value": 4}, {"timestamp": "bad", "value": 5}]}))
    assert [(r.year, r.value) for r in tables.read_history_json(spark, str(tmp_path)).collect()] == [(2010, 4.0), (None, 5.0)]


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="d0" attr.name="x"/><key id="d1" attr.name="length"/><graph><node id="1"><data key="d0">2.5</data></node><node id="2"/><edge source="1" target="2"><data key="d1">7</data></edge></graph></graphml>')
    g = str(tmp_path / "*.graphml")
    assert [(r.id, r.x) for r in read_graphml(spark, g, "nodes").collect()] == [("1", 2.5), ("2", None)]
    assert [(r.u, r.v, r.length) for r in read_graphml(spark, g, "edges").collect()] == [("1", "2", 7.0)]


def test_status_bundle_manifest(spark, tmp_path):
    ev = spark.createDataFrame([("a", 1, "open"), ("a", 2, "done"), ("b", 1, "open")], "k string, at int, state string")
    now = sinks.upsert_status(spark, str(tmp_path / "log"), ev, "k", "at")
    assert {r.k: r.state for r in now.collect()} == {"a": "done", "b": "open"}
    now = sinks.upsert_status(spark, str(tmp_path / "log"), ev.where("k = 'b'").withColumn("at", F.lit(9)).withColumn("state", F.lit("failed")), "k", "at")
    assert {r.k: r.state for r in now.collect()} == {"a": "done", "b": "failed"}
    assert sinks.todo(ev, now.where("state = 'done'"), ["k"]).select("k").distinct().count() == 1
    names = sinks.write_bundle({"A/B": ev, "a_b": ev, "x" * 40: ev.select(F.array("k").alias("l"))}, str(tmp_path / "book"))
    assert names == ["A_B", "a_b_2", "x" * 31]
    with pytest.raises(Exception):
        sinks.write_guarded(ev, str(tmp_path / "log"))
    sinks.write_manifest(spark, str(tmp_path / "m.json"), {"a": float("nan"), "b": [1, float("inf")]})
    sinks.write_manifest(spark, str(tmp_path / "m.json"), {"a": float("nan"), "b": [1, float("inf")]})
    assert sinks.sheet_names(["a", "A", "a_2", "a", ""]) == ["a", "A_2", "a_2_2", "a_3", "sheet"]
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": None, "b": [1, None]}
    assert "First 1 rows" in sinks.markdown_table(ev, 1) and sinks.column_dictionary(t=ev).count() == 3
    assert tables.inventory(spark, str(tmp_path / "book")).count() > 0


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.sql("SELECT id % 3 AS k, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, id, 0) AS ts, id * 1.0D AS v FROM range(500)")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    live_df = live.windowed(live.stream_table(spark, str(tmp_path / "in"), ev.schema, 1), "ts", ["k"], "v", late="30 days")
    q = live_df.writeStream.outputMode("complete").format("memory").queryName("out").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert sorted(spark.table("out").collect()) == sorted(live.windowed(ev, "ts", ["k"], "v").collect())
    s = live.status_sink(live.stream_table(spark, str(tmp_path / "in"), ev.schema, 1), str(tmp_path / "st"), str(tmp_path / "c2"), "k", "ts")
    s.awaitTermination()
    assert {r.k: r.v for r in sinks.latest_status(spark.read.parquet(str(tmp_path / "st")).drop("batch"), "k", "ts").collect()} == {0: 498.0, 1: 499.0, 2: 497.0}


def test_families_labels_waits_shapes_and_appendix(spark, tmp_path):
    assert tables.column_families(["n_share_MT02", "n_share__MT01", "n_share_MT01", "n_share_total"], "n_share") == {"MT01": "n_share__MT01", "MT02": "n_share_MT02"}
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    names = spark.createDataFrame([("a", "Anna"), ("b", "Bert"), ("b", "Bea"), ("c", None), (None, "x")], "k string, name string")
    assert {r.k: (r.name, r.name_note) for r in tables.attach_labels(df, names, "k", "name").collect()} == {"a": ("Anna", "matched"), "b": ("Bea", "several_labels"), "c": (None, "no_label"), None: (None, "no_label")}
    waits = tables.retry_waits(6, 1.0, 8.0)
    assert len(waits) == 5 and waits == tables.retry_waits(6, 1.0, 8.0) and all(0.75 * min(8, 2**i) <= w <= 1.25 * min(8, 2**i) for i, w in enumerate(waits))
    df.write.parquet(str(tmp_path / "t"))
    got = sinks.shapes(spark, {"t": str(tmp_path / "t")}).first()
    assert (got.rows, got.columns) == (4, 1) and got.bytes > 0
    assert sinks.write_appendix(spark, {"A": {"x": df}, "B": {"y": names, "Y": df}}, str(tmp_path / "app")) == {"A": ["x"], "B": ["y", "Y_2"]}
    assert json.loads((tmp_path / "app" / "manifest.json").read_text())["B"] == ["y", "Y_2"]
    assert [r.k for r in sinks.in_order(df).collect()] == ["a", "b", "c", None]

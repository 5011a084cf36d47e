import io
import json
import zipfile

import pytest

from tallyforge.operators.relations import GateError
from tallyforge.sources import readers as S
from tallyforge.sources import writers as W
from tallyforge.streaming import streams


def test_csv_keeps_newlines_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿a,b\n"x ""y""\nz",NA\n,2\n'.encode())
    rows = [tuple(r) for r in S.csv(spark, f"file://{tmp_path}/a.csv", ["a", "b"], S.NULL_TOKENS).collect()]
    assert rows == [('x "y"\nz', None), (None, "2")]
    with pytest.raises(GateError):
        S.csv_exact(spark, f"file://{tmp_path}/a.csv", ["b", "a"])


def test_facets_degrade(spark, tmp_path):
    assert S.facets(spark, f"file://{tmp_path}/none.csv", "k", ["x"]).columns == ["k", "x"]
    (tmp_path / "f.csv").write_text("k,x\n1,a\n1,b\n2,c\n")
    got = S.facets(spark, f"file://{tmp_path}/f.csv", "k", ["x", "y"])
    assert {tuple(r) for r in got.collect()} == {("1", "a", None), ("2", "c", None)}


def test_snapshots():
    manifest = {"pointers": {"current": "s2"}, "content_snapshots": [{"snapshot_id": "s1", "raw_sha256": "r1", "csv_sha256": "c1", "path": "p1"}, {"snapshot_id": "s2", "raw_sha256": "r2", "csv_sha256": "c2", "path": "p2"}]}
    assert [S.snapshot_path(manifest, x) for x in ("current", "s1", "r1", "c2")] == ["p2", "p1", "p1", "p2"]
    with pytest.raises(GateError):
        S.snapshot_path(manifest, "s9")


def test_dated():
    assert S.dated(["/a/projects-01-02-2024.xlsx", "/2025/01/projects.xlsx", "/x/Projects-March-2024.xlsx", "/other.xlsx"]) == "/2025/01/projects.xlsx"
    with pytest.raises(GateError):
        S.dated(["projects.xlsx", "projects-01-02-2024.xlsx"])


def test_xlsx(spark):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda ref, t: f'<c r="{ref}" t="inlineStr"><is><t>{t}</t></is></c>'
    sheet = f"<worksheet {ns}><sheetData><row r='1'>{cell('A1', 'note')}</row><row r='2'>{cell('A2', 'a')}{cell('B2', 'b')}{cell('D2', 'd')}</row><row r='3'>{cell('A3', '1')}{cell('C3', 'c')}{cell('D3', '3')}</row></sheetData></worksheet>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="x" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    df = S.xlsx(spark, out.getvalue())
    assert df.columns == ["a", "Column_3", "d"] and tuple(df.first()) == ("1", "c", "3")


def test_pages():
    made = {"u1": {"data": [1], "meta": {"pagination": {"total": 2, "links": {"next": "u2"}}}}, "u2": {"data": [2], "meta": {"pagination": {"total": 2, "links": {}}}}}
    assert [p["data"] for p in S.pages(made.get, "u1")] == [[1], [2]]
    made["u2"]["meta"]["pagination"]["links"] = {"next": "u1"}
    with pytest.raises(GateError):
        list(S.pages(made.get, "u1"))


def test_cache_and_log(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"__meta__": {"model": "m"}, "entries": {"1": {"fp": "x"}}}))
    path = f"file://{tmp_path}/c.json"
    assert [tuple(r) for r in S.json_cache(spark, path, {"model": "m"}, "fp string").collect()] == [("1", "x")]
    assert S.json_cache(spark, path, {"model": "other"}, "fp string").isEmpty()
    assert S.json_cache(spark, path + "x", {"model": "m"}, "fp string").isEmpty()
    (tmp_path / "l.txt").write_text("input_tokens=5\ninput_tokens=7 retry\nERROR x\nTraceback (most\n")
    assert S.run_log(spark, f"file://{tmp_path}/l.txt").first().asDict() == {"input_tokens": 12, "output_tokens": 0, "cache_read": 0, "cache_created": 0, "retries": 1, "errors": 1, "traceback": True}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, ["a", "b"]), (1, [])], "k int, v array<string>")
    assert W.csv_bytes(df, ["k"]) == b"\xef\xbb\xbfk,v\n1,\"\"\n2,a; b\n" or W.csv_bytes(df, ["k"]).endswith(b"2,a; b\n")
    assert W.content_hash(df).collect() == W.content_hash(df.repartition(3).orderBy("k")).collect()
    assert W.write_once(tmp_path / "x", b"1") and not W.write_once(tmp_path / "x", b"1")
    with pytest.raises(GateError):
        W.write_once(tmp_path / "x", b"2")
    assert W.one_hot(df, "k", {"v": ["a"]}).orderBy("k").collect()[1]["v: a"] == 1
    assert W.markdown(df.select("k"), ["k"]).splitlines()[2:] == ["| 1 |", "| 2 |"]
    with pytest.raises(GateError):
        W.header_only(df, ["k", "v"])


def test_idempotent_stream(spark, tmp_path):
    src, out = tmp_path / "in", f"file://{tmp_path}/out"
    spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 01:00:00")], "id int, t string").selectExpr("id", "cast(t as timestamp) ts").write.parquet(f"file://{src}/events.parquet")
    for i in range(2):
        rows = spark.readStream.schema("id int, ts timestamp").parquet(f"file://{src}/events.parquet")
        streams.idempotent(rows, ["id"], out, f"file://{tmp_path}/check{i}").awaitTermination()
    assert spark.read.parquet(out).count() == 2
    session = streams.drained(streams.sessions(spark.readStream.schema("id int, ts timestamp").parquet(f"file://{src}/events.parquet").withColumn("u", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)), "ts", "u", "2 hours"), "sess", "complete")
    assert session.first()["n"] == 2


def test_bundle_says_what_is_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("x\n1\n")
    got = S.bundle(spark, str(tmp_path), {"a": ["x"], "b": ["x", "z"], "c": ["x"]})
    assert {k: (v.count(), v.columns, ok) for k, (v, ok) in got.items()} == {"a": (1, ["x"], True), "b": (0, ["x", "z"], False), "c": (0, ["x"], False)}

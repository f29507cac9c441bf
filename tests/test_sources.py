import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from eventloom.eventlog import to_event_log
from eventloom.operators import split
from eventloom.sources import catalog, files, xes

XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xmlns="http://www.xes-standard.org/" xes.version="1.0">
  <extension name="Time" prefix="time"/>
  <global scope="event"><string key="concept:name" value="none"/></global>
  <trace>
    <string key="concept:name" value="PO-1"/><int key="amount" value="7"/>
    <event>
      <string key="concept:name" value="submit &amp; wait"/><date key="time:timestamp" value="2024-01-01T10:00:00.000+01:00"/>
      <boolean key="ok" value="true"><string key="inner" value="deep"/></boolean>
      <list key="items"><float key="price" value="1.5"/></list><id key="uid" value="x"/>
    </event>
    <event><string key="concept:name" value="pay"/><date key="time:timestamp" value="2024-01-02T10:00:00.000+01:00"/><string key="case:amount" value="9"/></event>
  </trace>
  <trace><string key="concept:name" value="PO-2"/>
    <event><string key="concept:name" value="submit"/><date key="time:timestamp" value="2024-01-03T10:00:00.000+01:00"/><string key="org:resource" value="bob"/></event></trace>
  <trace><string key="concept:name" value="PO-3"/></trace>
</log>
"""


@pytest.mark.parametrize("name", ["log.xes", "log.xes.gz"])
def test_xes(spark, tmp_path, name):
    path = tmp_path / name
    path.write_bytes(gzip.compress(XES.encode()) if name.endswith("gz") else XES.encode())
    flat = xes.read_xes(spark, str(path))
    rows = sorted((r.asDict() for r in flat.drop("file").collect()), key=lambda r: r["ordinal"])
    assert [r["concept:name"] for r in rows] == ["submit & wait", "pay", "submit"]
    assert [r["case:concept:name"] for r in rows] == ["PO-1", "PO-1", "PO-2"]
    assert rows[0]["inner"] == "deep" and rows[0]["price"] == "1.5" and rows[0]["ok"] == "true" and "uid" not in rows[0]
    assert [r["case:amount"] for r in rows] == ["7", "7", None] and rows[2]["org:resource"] == "bob"
    log = to_event_log(flat, order_by="ordinal").orderBy("event_id").collect()
    assert [(r.case_id, r.event_id, r.timestamp.astimezone(dt.timezone.utc).hour) for r in log] == [("PO-1", 0, 9), ("PO-1", 1, 9), ("PO-2", 2, 9)]


def test_namespaces(spark, tmp_path):
    text = XES.replace("<log ", '<log xmlns:foo="http://foo.org" xmlns:x="http://x.org" ').replace("<list key", '<foo:bar x:kind="a"/><foo:string key="far" value="see x:y http://z"/><list key')
    (tmp_path / "log.xes").write_text(text)
    rows = xes.read_xes(spark, str(tmp_path / "log.xes")).collect()
    assert len(rows) == 3 and [r.far for r in rows if r.far] == ["see x:y http://z"]
    for wrong in (text.replace("<trace", "<x:trace").replace("</trace", "</x:trace"), XES.replace("<event>", "<!-- </trace> --><event>", 1)):
        (tmp_path / "wrong.xes").write_text(wrong)
        with pytest.raises(Exception, match="trace"):
            xes.xes_events(spark, str(tmp_path / "wrong.xes")).count()


def test_tags():
    assert xes.is_attribute("{http://www.xes-standard.org/}string") and xes.is_attribute("float")
    assert not any(map(xes.is_attribute, ("list", "id", "container", "event")))


def test_traces_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 'x<"&>'), ("a", 2, None), ("b", 1, "y")], "c string, n int, t string")
    xes.write_traces(df, str(tmp_path / "out"), "c", ["n"], ["n", "t"])
    got = {(r["case:concept:name"], r.n): r.t for r in xes.read_xes(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", "1"): 'x<"&>', ("a", "2"): None, ("b", "1"): "y"}


def test_parts_and_their_names(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"part_{i}.xes").write_text(XES)
    both = files.read_log(spark, *(str(tmp_path / f"part_{i}.xes") for i in (1, 2)))
    assert {r.log_version: r["count"] for r in both.groupBy("log_version").count().collect()} == {"part_1": 3, "part_2": 3}
    with pytest.raises(ValueError):
        files.read_log(spark, "log.txt")
    with pytest.raises(ValueError):
        files.read_log(spark)


def test_catalog(spark, tmp_path):
    with pytest.raises(ValueError):
        catalog.load(spark, "BPI12", str(tmp_path))
    with pytest.raises(ValueError):
        catalog.load(spark, "Sepsis", str(tmp_path / "missing"))
    with pytest.raises(ValueError):
        catalog.load(spark, "Other")
    own = tmp_path / "BPI12"
    own.mkdir()
    (own / "BPI_Challenge_2012.xes.gz").write_bytes(gzip.compress(XES.encode()))
    log = catalog.load(spark, "BPI12", str(tmp_path), cache="csv")
    assert log.dataframe.count() == 3 and (own / "BPI12.csv").exists()
    (own / "BPI_Challenge_2012.xes.gz").unlink()
    again = catalog.load(spark, "BPI12", str(tmp_path), cache="csv")
    assert again.get_summary_stats()["n_cases"] == 2
    params = again.unbiased_split_params
    params["max_days"] = 0
    assert again.unbiased_split_params == {"start_date": None, "end_date": "2012-02", "max_days": 32.28}
    with pytest.raises(ValueError):  # published bounds leave nothing of this log
        split.train_test_split(again, strategy="unbiased")
    assert len(catalog.CATALOG) == 14


def test_columns_on_load(spark, tmp_path):
    own = tmp_path / "BPI15"
    own.mkdir()
    rows = [("c", "2024-01-01", "code", "name", "naam")]
    spark.createDataFrame(rows, "`case:concept:name` string, `time:timestamp` string, `concept:name` string, activityNameEN string, activityNameNL string").write.parquet(str(own / "BPI15.parquet"))
    row = catalog.load(spark, "BPI15", str(tmp_path)).dataframe.first()
    assert row.activity == "name" and "activityNameNL" not in row.asDict()
    with pytest.raises(ValueError):
        catalog.load(spark, "BPI15", str(tmp_path)).unbiased_split_params  # noqa: B018


def test_csv_parquet_round_trip(spark, tmp_path):
    df = spark.range(5).withColumn("t", F.concat(F.lit("x,"), "id"))
    for kind in files.FORMATS:
        files.write_log(df, str(tmp_path / f"log.{kind}"), kind)
        assert {(r.id, r.t) for r in files.read_log(spark, str(tmp_path / f"log.{kind}")).collect()} == {(i, f"x,{i}") for i in range(5)}
    with pytest.raises(ValueError):
        files.write_log(df, str(tmp_path / "x"), "xml")

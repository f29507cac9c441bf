import datetime as dt

import pytest

from eventloom import eventlog, schema
from eventloom.eventlog import EventLog, to_event_log

UTC = dt.timezone.utc


def at(*a):
    return dt.datetime(*a, tzinfo=UTC)


def flat(spark, rows, names="case_id string, timestamp string, activity string"):
    return spark.createDataFrame(rows, names).coalesce(1)


def test_ties_keep_the_order_of_the_source(spark):
    log = to_event_log(flat(spark, [("a", "2024-01-01 00:00:00", x) for x in "xyz"]))
    assert [(r.event_id, r.activity) for r in log.orderBy("event_id").collect()] == [(0, "x"), (1, "y"), (2, "z")]
    assert log.columns[:3] == list(schema.KEYS)
    assert to_event_log(log) is log


def test_offsets_formats_and_numbers_over_all_cases(spark):
    rows = [("PO-2", "2024-02-01 11:00+01:00", "c"), ("PO-1", "2024-02-01T09:30:00.000+01:00", "b"), ("PO-1", "01/02/2024 10:00", "a"), ("PO-2", "no time", "d"), (None, "2024-01-01", "e")]
    log = to_event_log(flat(spark, rows)).orderBy("event_id").collect()
    assert [(r.case_id, r.activity, r.event_id) for r in log] == [("PO-1", "a", 0), ("PO-1", "b", 1), ("PO-2", "c", 2), ("PO-2", "d", 3)]
    assert [r.timestamp and r.timestamp.astimezone(UTC) for r in log] == [at(2024, 1, 2, 10), at(2024, 2, 1, 8, 30), at(2024, 2, 1, 10), None]
    with pytest.warns(UserWarning):
        to_event_log(flat(spark, rows), warn=True)


def test_numbers_are_dense_over_many_ranges(spark):
    df = spark.range(500).selectExpr("cast(id % 37 as string) as case_id", "timestamp_seconds(id * 7919 % 1000) as timestamp", "'a' as activity", "id as n")
    got = to_event_log(df, order_by="n").orderBy("event_id").collect()
    want = sorted(df.collect(), key=lambda r: (r.case_id, r.timestamp, r.n))
    assert [r.event_id for r in got] == list(range(500))
    assert [r.n for r in got] == [r.n for r in want]


@pytest.mark.parametrize("names", [{"case:concept:name": "c"}, {"case_id": "c"}, {"CaseID": "c"}])
def test_three_ways_of_naming(spark, names):
    (case,) = names
    raw = flat(spark, [("c1", "2024-01-01", "a")], f"`{case}` string, `time:timestamp` string, `concept:name` string")
    mapping = {"case_id": "CaseID"} if case == "CaseID" else None
    assert to_event_log(raw, column_mapping=mapping).first().case_id == "c1"


def test_names_can_be_set_and_nothing_is_guessed(spark):
    raw = flat(spark, [("c1", "2024-01-01", "a")], "Case string, timestamp string, activity string")
    with pytest.raises(ValueError):
        to_event_log(raw)
    schema.set_global_config(case_id="Case")
    try:
        assert to_event_log(raw).first().case_id == "c1"
    finally:
        schema.reset_global_config()
    with pytest.raises(ValueError):
        to_event_log(raw, column_mapping={"case_id": "missing"})
    with pytest.raises(ValueError):
        schema.set_global_config(colour="x")


def test_clashing_and_extra_columns(spark):
    raw = spark.createDataFrame([("c", "2024-01-01", "a", "other", 7)], "CaseID string, timestamp string, activity string, case_id string, event_id int")
    row = to_event_log(raw, column_mapping={"case_id": "CaseID"}).first()
    assert row.case_id == "c" and row.event_id == 0


def test_what_is_no_log(spark):
    with pytest.raises(TypeError):
        to_event_log([1, 2])
    with pytest.raises(ValueError):
        to_event_log(EventLog())
    log = EventLog(flat(spark, [("a", "2024-01-01", "x")]))
    with pytest.raises(ValueError):
        to_event_log(log, column_mapping={"case_id": "case_id"})
    assert log.get_summary_stats() == {"n_cases": 1, "n_events": 1, "n_activities": 1}
    assert "n_cases=1" in repr(log)


def test_positions_and_bounds(spark):
    log = to_event_log(flat(spark, [("a", "2024-01-02", "y"), ("a", "2024-01-01", "x"), ("b", "2024-01-01", "z")]))
    got = eventlog.trace_positions(log).join(log, list(schema.KEYS)).collect()
    assert {r.activity: r.trace_position for r in got} == {"x": 0, "y": 1, "z": 0}
    assert {r.case_id: r.duration_days for r in eventlog.case_bounds(log).collect()} == {"a": 1.0, "b": 0.0}
    assert [f(log).count() for f in (eventlog.case_ids, eventlog.timestamps, eventlog.event_ids)] == [3, 3, 3]


def test_empty_log(spark):
    log = to_event_log(flat(spark, []))
    assert log.count() == 0 and eventlog.log_summary(log).first().n_events == 0


def test_other_time_zones_are_refused(spark):
    from eventloom.eventlog import ordered

    df = spark.createDataFrame([("b", "2024-01-01", "x"), ("a", "2024-01-02", "y"), ("a", "2024-01-01", "z")], "case_id string, timestamp string, activity string")
    assert [r.activity for r in ordered(df).collect()] == ["z", "y", "x"]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="UTC"):
            to_event_log(df)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")

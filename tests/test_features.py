import datetime as dt

import pytest

from eventloom import schema
from eventloom.eventlog import to_event_log
from eventloom.functions import selection, targets, time
from eventloom.operators import intercase

GAPS = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:30"), ("a", "2024-01-01 00:01:30"), ("b", "2024-01-02 00:00:00"), ("b", "2024-01-02 01:00:00")]


def log_of(spark, rows, activity="x"):
    rows = [(c, t, activity if isinstance(activity, str) or activity is None else activity[i]) for i, (c, t) in enumerate(rows)]
    return to_event_log(spark.createDataFrame(rows, "case_id string, timestamp string, activity string").coalesce(1))


def values(df, column):
    return [r[column] for r in df.orderBy("event_id").collect()]


def test_known_gaps(spark):
    log = log_of(spark, GAPS)
    made = time.time_features(log, "all", None)
    assert values(made, "time_since_last_event") == [0, 30, 60, 0, 3600]
    assert values(made, "accumulated_time") == [0, 30, 90, 0, 3600]
    assert values(targets.execution_time(log), "execution_time") == [30, 60, 0, 3600, 0]
    assert values(targets.remaining_time(log, "m"), "remaining_time") == [1.5, 1, 0, 60, 0]
    with pytest.raises(KeyError):
        time.time_features(log, time_unit="y")


def test_next_activity_and_nulls(spark):
    log = log_of(spark, GAPS, ["p", None, "q", "r", "s"])
    assert values(targets.next_activity(log), "next_activity") == [None, "q", "<EOT>", "s", "<EOT>"]


def test_calendar_bounds(spark):
    log = log_of(spark, [("a", "2023-12-31 23:59:59"), ("a", "2024-01-01 00:00:00")])
    made = time.time_features(log, None, "all")
    last, first = made.orderBy("event_id").collect()
    for name in ("sec_of_min", "min_of_hour", "hour_of_day", "day_of_week", "day_of_month", "month_of_year"):
        assert last[name] == 0.5, name
        assert first[name] == -0.5, name
    assert last["secs_since_sunday"] == pytest.approx(86399 / 604800 - 0.5)
    assert first["numerical_timestamp"] == dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc).timestamp()


def test_sunday_starts_the_week(spark):
    log = log_of(spark, [("a", "2024-01-07 00:00:00"), ("a", "2024-01-13 23:59:59")])
    assert values(time.time_features(log, None, "secs_since_sunday"), "secs_since_sunday") == pytest.approx([-0.5, 604799 / 604800 - 0.5])


def test_selection(spark):
    names = [n for n, _ in selection.resolve_features(time.CASE_TIME, "all")]
    assert names == ["accumulated_time", "time_since_last_event"]
    assert selection.resolve_features(time.CASE_TIME, None) == []
    assert [n for n, _ in selection.resolve_features(time.CALENDAR, ["hour_of_day", "hour_of_day"])] == ["hour_of_day"]
    for wrong in ("remaining_time", "colour"):
        with pytest.raises(ValueError):
            selection.resolve_features(time.CASE_TIME, wrong)
    with pytest.raises(TypeError):
        selection.resolve_features(object(), "all")
    with pytest.raises(ValueError):
        time.time_features(log_of(spark, GAPS), None, None)
    assert selection.ensure_list("a") == ["a"] and selection.ensure_list(("a", "b")) == ["a", "b"] and selection.ensure_list(3) == [3]
    with pytest.raises(ValueError):
        selection.validate_columns(["a"], ["b"])


def test_column_types(spark):
    df = spark.sql("SELECT 'x' AS s, 1 AS i, 1.5D AS d, true AS b, timestamp'2024-01-01' AS t")
    assert selection.infer_column_types(df) == (["s", "b"], ["i", "d"], ["t"])
    assert selection.infer_column_types(df, int_as_cat=True)[0] == ["s", "i", "b"]


def test_a_prefix_never_sees_later_events(spark):
    whole, short = log_of(spark, GAPS), log_of(spark, GAPS[:2] + GAPS[3:4])
    for made in (lambda x: time.time_features(x),):
        a = {(r.case_id, r.timestamp): r.asDict() for r in made(whole).drop("event_id").collect()}
        for r in made(short).drop("event_id").collect():
            assert a[r.case_id, r.timestamp] == r.asDict()


WIP = [
    ("1D", [("a", "2024-01-01 01:00"), ("b", "2024-01-01 02:00"), ("a", "2024-01-01 03:00")], {"a": [2, 2], "b": [2]}),
    ("1D", [("a", "2024-01-01 23:59:59"), ("b", "2024-01-01 10:00"), ("c", "2024-01-02 00:00")], {"a": [2], "b": [2], "c": [1]}),
    ("12h", [("a", "2024-01-01 01:00"), ("b", "2024-01-01 11:00"), ("c", "2024-01-01 12:00")], {"a": [2], "b": [2], "c": [1]}),
    ("7h", [("a", "2024-01-01 22:00"), ("b", "2024-01-02 03:00"), ("c", "2024-01-02 04:00")], {"a": [2], "b": [2], "c": [1]}),
    ("W", [("a", "2024-01-01 00:00"), ("b", "2024-01-07 23:00"), ("c", "2024-01-08 00:00")], {"a": [2], "b": [2], "c": [1]}),
    ("2W", [("a", "2024-01-03 00:00"), ("b", "2024-01-08 00:00"), ("c", "2024-01-21 00:00"), ("d", "2024-01-22 00:00")], {"a": [1], "b": [2], "c": [2], "d": [1]}),
    ("B", [("a", "2024-01-05 00:00"), ("b", "2024-01-07 00:00"), ("c", "2024-01-08 00:00")], {"a": [2], "b": [2], "c": [1]}),
    ("ME", [("a", "2024-01-31 23:00"), ("b", "2024-01-01 00:00"), ("c", "2024-02-01 00:00")], {"a": [2], "b": [2], "c": [1]}),
]


@pytest.mark.parametrize("width,rows,want", WIP)
def test_work_in_progress(spark, width, rows, want):
    got: dict = {}
    for r in intercase.work_in_progress(log_of(spark, rows), width).orderBy("event_id").collect():
        got.setdefault(r.case_id, []).append(r.wip)
    assert got == want


@pytest.mark.parametrize("width", ["2MS", "2ME", "5ME", "QS", "2QE", "3QS", "YE", "2YS", "2YE", "2B", "3B"])
def test_calendar_widths_against_pandas(spark, width):
    """Which events share a bin, over four years, as pandas groups them."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    # the first event is on a working day: for others pandas has no single rule
    times = [pd.Timestamp("2021-02-17 05:00")] + [pd.Timestamp("2021-02-17 06:00") + pd.Timedelta(minutes=int(m)) for m in rng.integers(0, 4 * 365 * 1440, 60)]
    frame = pd.DataFrame({"time": times, "case": [f"c{i}" for i in range(61)]})
    want = {}
    for _, part in frame.groupby(pd.Grouper(key="time", freq=width)):
        want |= {c: len(part) for c in part["case"]}
    log = log_of(spark, list(zip(frame["case"], frame["time"].astype(str), strict=True)))
    assert {r.case_id: r.wip for r in intercase.work_in_progress(log, width).collect()} == want


def test_widths_that_are_not_supported(spark):
    for width in ("0D", "x", "3 days", "2X"):
        with pytest.raises(ValueError):
            intercase.work_in_progress(log_of(spark, GAPS), width)
    rows = [("a", "2024-01-01"), ("b", "never")]
    assert {r.case_id: r.wip for r in intercase.work_in_progress(log_of(spark, rows)).collect()} == {"a": 1, "b": None}


def test_features_need_one_shuffle(spark):
    plan = time.time_features(log_of(spark, GAPS).select(*schema.KEYS, "activity"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window ") <= 6

"""Work in progress: how many cases have an event in the event's tumbling bin of time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.eventlog import EventLog, to_event_log
from eventloom.schema import KEYS, micros

#: Microseconds of the units of fixed width.
WIDTHS = {"D": 86_400_000_000, "h": 3_600_000_000, "H": 3_600_000_000, "min": 60_000_000, "T": 60_000_000, "s": 1_000_000, "S": 1_000_000}
#: Calendar units: their months, and whether bins of several are counted from their starts, else from their ends.
CALENDAR = {"MS": (1, True), "ME": (1, False), "M": (1, False), "QS": (3, True), "QE": (3, False), "YS": (12, True), "YE": (12, False)}
WEEK = 7 * WIDTHS["D"]


def time_bin(window_size: str, first: Column) -> Column:
    """The number of the bin of column timestamp. first: the log's first time, in microseconds.

    Fixed widths run on from midnight of the log's first event; "W" bins are weeks from Monday, "nW" n of them, the
    first ending on the first Sunday at or after the first event. Months, quarters and years are the calendar's: n of
    them begin with the first event's ("nMS"), or the first bin ends with the first event's ("nME"). "B" counts
    working days from the first event's and puts weekends to their Friday.
    """
    matched = re.fullmatch(r"(\d*)([A-Za-z]+)", window_size)
    if not matched or matched[1] and not int(matched[1]):
        raise ValueError(f"{window_size!r} is no width of time")
    n, unit = int(matched[1] or 1), matched[2]
    day = WIDTHS["D"]
    days = F.floor(micros("timestamp") / day)
    if unit in WIDTHS:
        return F.floor((micros("timestamp") - F.floor(first / day) * day) / (n * WIDTHS[unit]))
    if unit in ("W", "W-SUN"):  # 1970-01-01 was a Thursday: Mondays are 4 modulo 7
        week, first_week = F.floor((days + 3) / 7), F.floor((F.floor(first / day) + 3) / 7)
        return F.ceil((week - first_week) / n)
    if unit not in (*CALENDAR, "B"):
        raise ValueError(f"{window_size!r} isn't supported: units are {[*WIDTHS, 'W', *CALENDAR, 'B']}")
    if unit == "B":

        def working(day: Column) -> Column:
            return F.floor((day + 3) / 7) * 5 + F.least((day + 3) - F.floor((day + 3) / 7) * 7, F.lit(4))

        return F.floor((working(days) - working(F.floor(first / day))) / n)
    months, from_start = CALENDAR[unit]

    def period(time: Column) -> Column:
        return F.floor((F.year(time) * 12 + F.month(time) - 1) / months)

    since = period(F.col("timestamp")) - period(F.timestamp_micros(first.cast("long")))
    return F.floor(since / n) if from_start else F.ceil(since / n)


def work_in_progress(log: DataFrame | EventLog, window_size: str = "1D") -> DataFrame:
    """The keys and wip. An event without a time has a null wip; an empty log has an empty result.

    Distinct (bin, case) pairs are counted before they meet the events again, so that no bin's events gather in a task.
    """
    df = to_event_log(log)
    time_bin(window_size, F.lit(0))
    first = df.agg(F.min(micros("timestamp")).alias("__first"))
    binned = df.crossJoin(F.broadcast(first)).withColumn("__bin", time_bin(window_size, F.col("__first")))
    active = binned.where("__bin IS NOT NULL").select("__bin", "case_id").distinct().groupBy("__bin").agg(F.count(F.lit(1)).alias("wip"))
    return binned.join(active, "__bin", "left").select(*KEYS, "wip")

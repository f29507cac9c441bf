"""Time features: the calendar position of an event, and its place in its case's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.eventlog import EventLog, to_event_log
from eventloom.functions.selection import Registry, resolve_features
from eventloom.schema import KEYS, by_case, in_order, micros

#: Seconds in a unit of time.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
T = "timestamp"


def _scaled(value: Column, top: int) -> Column:
    """0 ... top to -0.5 ... 0.5."""
    return value / float(top) - 0.5


def _second_of_day() -> Column:
    return F.hour(T) * 3600 + F.minute(T) * 60 + F.second(T)


CALENDAR = Registry(
    {
        "sec_of_min": lambda unit: _scaled(F.second(T), 59),
        "min_of_hour": lambda unit: _scaled(F.minute(T), 59),
        "hour_of_day": lambda unit: _scaled(F.hour(T), 23),
        "day_of_week": lambda unit: _scaled(F.weekday(T), 6),
        "day_of_month": lambda unit: _scaled(F.dayofmonth(T) - 1, 30),
        "day_of_year": lambda unit: _scaled(F.dayofyear(T) - 1, 365),
        "week_of_year": lambda unit: _scaled(F.weekofyear(T) - 1, 52),
        "month_of_year": lambda unit: _scaled(F.month(T) - 1, 11),
        "secs_within_day": lambda unit: _scaled(_second_of_day(), 86400),
        "secs_since_sunday": lambda unit: _scaled((F.weekday(T) + 1) % 7 * 86400 + _second_of_day(), 604800),
        "numerical_timestamp": lambda unit: F.floor(micros(T) / 1e6) / UNITS[unit],
    }
)


def _seconds(later: Column, earlier: Column) -> Column:
    return (later - earlier) / 1e6


def accumulated_time(unit: str = "s") -> Column:
    """From the case's first event to this one."""
    return _seconds(micros(T), F.min(micros(T)).over(by_case())) / UNITS[unit]


def time_since_last_event(unit: str = "s") -> Column:
    """From the case's event before to this one; 0 for the first."""
    return F.coalesce(_seconds(micros(T), F.lag(micros(T)).over(in_order())), F.lit(0.0)) / UNITS[unit]


def execution_time(unit: str = "s") -> Column:
    """From this event to the case's next one; 0 for the last. Looks ahead."""
    return F.coalesce(F.abs(_seconds(F.lead(micros(T)).over(in_order()), micros(T))), F.lit(0.0)) / UNITS[unit]


def remaining_time(unit: str = "s") -> Column:
    """From this event to the case's last one. Looks ahead."""
    return _seconds(F.max(micros(T)).over(by_case()), micros(T)) / UNITS[unit]


CASE_TIME = Registry({"accumulated_time": accumulated_time, "time_since_last_event": time_since_last_event}, ["execution_time", "remaining_time"])


def time_columns(case_features: str | list[str] | None = "all", event_features: str | list[str] | None = "all", time_unit: str = "s") -> dict[str, Column]:
    """The chosen features of a canonical log by name, case features first."""
    chosen = resolve_features(CASE_TIME, case_features) + resolve_features(CALENDAR, event_features)
    if not chosen:
        raise ValueError("no features are chosen")
    UNITS[time_unit]
    return {name: build(time_unit) for name, build in chosen}


def floor_day(column: str = T) -> Column:
    """Midnight of the day of a time."""
    return F.date_trunc("day", F.col(f"`{column}`"))


def time_features(log: DataFrame | EventLog, case_features: str | list[str] | None = "all", event_features: str | list[str] | None = "all", time_unit: str = "s") -> DataFrame:
    """The keys and the chosen features, case features first, in one projection over one ordering of each case."""
    made = time_columns(case_features, event_features, time_unit)
    return to_event_log(log).select(*KEYS, *(c.alias(name) for name, c in made.items()))

"""Feature extractors with fit and transform, over the functions of the library."""

from __future__ import annotations

from pyspark.sql import DataFrame

from eventloom.base import BaseProcessTransformer
from eventloom.functions.selection import resolve_features
from eventloom.functions.time import CALENDAR, CASE_TIME, UNITS, time_features
from eventloom.operators.intercase import work_in_progress


class TimestampExtractor(BaseProcessTransformer):
    """The keys and the chosen time features, those of the case first."""

    def __init__(self, case_features: str | list[str] | None = "all", event_features: str | list[str] | None = "all", time_unit: str = "s"):
        self.case_features, self.event_features, self.time_unit = case_features, event_features, time_unit

    @property
    def names_out(self) -> tuple[str, ...]:
        return tuple(n for n, _ in resolve_features(CASE_TIME, self.case_features) + resolve_features(CALENDAR, self.event_features))

    def _fit(self, df: DataFrame) -> None:
        UNITS[self.time_unit]
        if not self.names_out:
            raise ValueError("no features are chosen")

    def _transform(self, df: DataFrame) -> DataFrame:
        return time_features(df, self.case_features, self.event_features, self.time_unit)


class WorkInProgress(BaseProcessTransformer):
    """The keys and wip, the number of cases with an event in the event's bin of time."""

    names_out = ("wip",)

    def __init__(self, window_size: str = "1D"):
        self.window_size = window_size

    def _fit(self, df: DataFrame) -> None:
        work_in_progress(df, self.window_size)

    def _transform(self, df: DataFrame) -> DataFrame:
        return work_in_progress(df, self.window_size)

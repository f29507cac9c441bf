"""Splits of whole cases into train and test."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.eventlog import EventLog, to_event_log
from eventloom.plans.storage import written
from eventloom.schema import by_case, micros

DAY = 86_400_000_000
#: Fixed value: slack of the longest duration, against rounding.
SLACK = 1.00000000001


def _check_test_size(test_size: float) -> None:
    if not 0 < test_size < 1:
        raise ValueError(f"test_size lies between 0 and 1, not {test_size}")


def _month(text: str | None) -> str | None:
    if text is not None and not re.fullmatch(r"\d{4}-\d{2}", str(text)):
        raise ValueError(f"a bound is a month, yyyy-mm, not {text!r}")
    return text and str(text)


def _checked(train: DataFrame, test: DataFrame, validate: bool) -> tuple[DataFrame, DataFrame]:
    if validate:
        for side, name in ((train, "train"), (test, "test")):
            if side.isEmpty():
                raise ValueError(f"the split leaves no cases to {name}: choose another test_size")
    return train, test


def temporal_flags(log: DataFrame | EventLog, test_size: float = 0.2) -> DataFrame:
    """The log with in_train: whether the case's first event is at or before the cut, a fraction of the log's span.

    The span's ends come from the driver as two numbers.
    """
    _check_test_size(test_size)
    df = to_event_log(log)
    start, end = df.agg(F.min(micros("timestamp")), F.max(micros("timestamp"))).first()
    if start is None:
        return df.withColumn("in_train", F.lit(None).cast("boolean"))
    cut = start + int((end - start) * (1 - test_size))
    return df.withColumn("in_train", F.coalesce(F.min(micros("timestamp")).over(by_case()) <= cut, F.lit(False)))


def temporal(log: DataFrame | EventLog, test_size: float = 0.2, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(train, test). A train case keeps all its events, also those after the cut."""
    flagged = temporal_flags(log, test_size)
    sides = flagged.where("in_train").drop("in_train"), flagged.where("NOT in_train").drop("in_train")
    return _checked(*sides, validate)


def kth_smallest(df: DataFrame, column: str, k: int, ranges: int = 4096) -> int:
    """The k-th smallest value, from 0, of a column of integers without nulls; df has more than k rows.

    Each round counts the rows in ranges of the values that are left and goes on in the range that holds the k-th, so
    that a task keeps counts and the driver gets at most `ranges` of them.
    """
    value = F.col(f"`{column}`")
    low, high = df.agg(F.min(value), F.max(value)).first()
    while low < high:
        width = -(-(high - low + 1) // ranges)
        part = F.expr(f"(`{column}` - {low}L) div {width}L").alias("part")
        found = df.where(value.between(low, high)).groupBy(part).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for r in sorted(found.collect()):
            if k < r.n:
                low, high = r.low, r.high
                break
            k -= r.n
    return low


def unbiased_cases(log: DataFrame | EventLog, start_date: str | None, end_date: str | None, max_days: float, test_size: float = 0.2) -> DataFrame:
    """case_id and in_train of the cases that stay.

    Cases that begin before the first month, end after the last, take longer than max_days or begin within the last
    max_days of what is left go. The k-th case start, k = int(n (1 - test_size)), divides: a case that ends at or after
    it is for testing. Everything happens on one row a case, which is written; the driver gets numbers and counts of
    ranges.
    """
    _check_test_size(test_size)
    start_date, end_date = _month(start_date), _month(end_date)
    cases = to_event_log(log).groupBy("case_id").agg(F.min(micros("timestamp")).alias("first"), F.max(micros("timestamp")).alias("last"))
    if start_date:
        cases = cases.where(F.date_format(F.timestamp_micros("first"), "yyyy-MM") >= start_date)
    if end_date:
        cases = cases.where(F.date_format(F.timestamp_micros("last"), "yyyy-MM") <= end_date)
    cases = written(cases, "cases")
    last = cases.agg(F.max("last")).first()[0]
    lasting = (F.col("last") - F.col("first")) / float(DAY)
    cases = cases.where((lasting <= max_days * SLACK) & (F.col("first") <= (last or 0) - round(max_days * DAY)))
    n = cases.count()
    if not n:
        raise ValueError(f"no cases are left to split: all last longer than {max_days} days, or begin within the log's last {max_days} days")
    k = int(n * (1 - test_size))
    t0 = kth_smallest(cases, "first", k)
    return cases.select("case_id", (F.col("last") < t0).alias("in_train"))


def unbiased(log: DataFrame | EventLog, start_date: str | None, end_date: str | None, max_days: float, test_size: float = 0.2, validate: bool = True) -> tuple[DataFrame, DataFrame]:
    df = to_event_log(log)
    cases = unbiased_cases(df, start_date, end_date, max_days, test_size)
    sides = (df.join(cases.where(side).select("case_id"), "case_id", "left_semi").select(*df.columns) for side in ("in_train", "NOT in_train"))
    return _checked(*sides, validate)


STRATEGIES = "temporal", "unbiased"


def train_test_split(
    log: DataFrame | EventLog,
    *,
    strategy: str = "temporal",
    test_size: float = 0.2,
    start_date: str | None = None,
    end_date: str | None = None,
    max_days: float | None = None,
    column_mapping: Mapping[str, str] | None = None,
    validate: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(train, test) by strategy. What unbiased needs and isn't given comes from the log's catalog entry."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy is one of {STRATEGIES}, not {strategy!r}")
    given = {"start_date": start_date, "end_date": end_date, "max_days": max_days}
    published = dict(getattr(log, "unbiased_split_params", None) or {})
    df = to_event_log(log, column_mapping=column_mapping)
    if strategy == "temporal":
        if extra := [k for k, v in given.items() if v is not None]:
            raise ValueError(f"{extra} are parameters of the unbiased split")
        return temporal(df, test_size, validate)
    chosen = {k: published.get(k) if v is None else v for k, v in given.items()}
    if chosen["max_days"] is None:
        raise ValueError("the unbiased split needs max_days, and the log has no published value")
    return unbiased(df, **chosen, test_size=test_size, validate=validate)


def group_folds(log: DataFrame | EventLog, k: int) -> DataFrame:
    """The log with fold, 0 ... k-1, the same for all events of a case: its id's CRC-32, as text, modulo k."""
    if k < 2:
        raise ValueError("there are at least 2 folds")
    return to_event_log(log).withColumn("fold", (F.crc32(F.col("case_id").cast("string").cast("binary")) % k).cast("int"))

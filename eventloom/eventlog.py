"""Bringing raw logs into one shape: case_id, timestamp, event_id, then data."""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.plans.storage import written
from eventloom.schema import KEYS, SourceNames, get_global_config, in_order, normalize_columns

#: Patterns for times that a cast doesn't read, tried in this order.
TIME_PATTERNS = (
    "yyyy-MM-dd HH:mmXXX",
    "yyyy-MM-dd'T'HH:mmXXX",
    "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy/MM/dd HH:mm",
    "yyyy/MM/dd",
    "MM/dd/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy",
    "dd.MM.yyyy HH:mm:ss",
    "dd.MM.yyyy HH:mm",
    "dd.MM.yyyy",
)
#: Case ids that are sampled to deal cases into ranges of about the same size.
SAMPLED = 2048


def parsed_time(column: str, kind: T.DataType) -> Column:
    """A column as an instant in UTC; what can't be read becomes null. Text may mix formats from row to row."""
    c = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        return F.coalesce(c.try_cast("timestamp"), *(F.try_to_timestamp(c, F.lit(p)) for p in TIME_PATTERNS))
    return c.cast("timestamp")


#: Names of the zone in which the calendar is read.
UTC = {"utc", "etc/utc", "gmt", "etc/gmt", "z", "+00:00", "gmt+0", "utc+0", "etc/uct", "uct", "zulu"}


def check_zone(spark: SparkSession) -> None:
    """ValueError unless the session's time zone is UTC: the calendar, and times without a zone, are read in it."""
    if (zone := spark.conf.get("spark.sql.session.timeZone")).lower() not in UTC:
        raise ValueError(f"the session's time zone is {zone}: set spark.sql.session.timeZone to UTC")


def is_event_log(df: object) -> bool:
    return isinstance(df, DataFrame) and tuple(df.columns[:3]) == KEYS


class EventLog:
    """Owns a canonical log."""

    #: Published parameters of the unbiased split, for logs of the catalog.
    unbiased_split_params: dict | None = None

    def __init__(self, dataframe: DataFrame | None = None, column_mapping: Mapping[str, str] | None = None, order_by: str | None = None):
        self.dataframe = None if dataframe is None else to_event_log(dataframe, column_mapping=column_mapping, order_by=order_by)

    def get_summary_stats(self) -> dict[str, object]:
        row = log_summary(to_event_log(self)).first()
        return {"n_cases": row.n_cases, "n_events": row.n_events, "n_activities": "N/A" if row.n_activities is None else row.n_activities}

    def __repr__(self) -> str:
        if self.dataframe is None:
            return f"{type(self).__name__}(empty)"
        return f"{type(self).__name__}({', '.join(f'{k}={v}' for k, v in self.get_summary_stats().items())})"


def case_offsets(counts: DataFrame, ranges: int) -> DataFrame:
    """counts (case_id, n) with `before`: the events of all smaller cases.

    Cases are dealt into ranges between sampled case ids; each range adds up by itself and the ranges' totals, one row
    each, are added up in turn, so that no task sees all cases.
    """
    sample = [r[0] for r in counts.select("case_id").orderBy(F.xxhash64("case_id"), "case_id").limit(SAMPLED).collect()]
    sample.sort()
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    cut = F.array(*(F.lit(c) for c in cuts)) if cuts else None
    place = F.size(F.filter(cut, lambda c: c <= F.col("case_id"))) if cuts else F.lit(0)
    ranged = counts.withColumn("__range", place)
    before = Window.partitionBy("__range").orderBy("case_id").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("__inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = ranged.groupBy("__range").agg(F.sum("n").alias("__total"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__range", F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__start"))
    return inside.join(F.broadcast(starts), "__range").select("case_id", (F.col("__start") + F.col("__inside")).alias("before"))


def numbered_rows(df: DataFrame, order: list[str], into: str, parts: int) -> DataFrame:
    """df with `into`: 0, 1, 2 ... in the order of these columns. Rows are dealt into sorted ranges, counted and written
    there, and numbered range by range; one row for each range is added up in one place."""
    dealt = df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, "numbered")
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__inside", inside).join(F.broadcast(starts), "__range").withColumn(into, F.col("__start") + F.col("__inside") - 1).drop("__range", "__start", "__inside")


def ordered(log: DataFrame | EventLog) -> DataFrame:
    """The log sorted by case, time (unreadable ones last) and event, over all its partitions: for writing or looking at."""
    return to_event_log(log).orderBy("case_id", F.col("timestamp").asc_nulls_last(), "event_id")


def to_event_log(
    log: DataFrame | EventLog, *, column_mapping: Mapping[str, str] | None = None, order_by: str | None = None, event_ids: str = "dense", names: SourceNames | None = None, warn: bool = False
) -> DataFrame:
    """The canonical log: fields renamed, times in UTC, events ordered by (case, time, order_by) and numbered.

    order_by: a column that breaks ties of time; without it, the order in which the source is scanned. event_ids:
    "dense" numbers all events from 0 in the order of cases; "source" takes order_by's values, unique in a case, and
    needs no shuffle. A log that is canonical stays as it is. Rows without a case are dropped, unreadable times are
    null and come last; warn counts these, with a job.
    """
    if isinstance(log, EventLog):
        if column_mapping is not None:
            raise ValueError("an EventLog is canonical: column_mapping doesn't apply")
        if log.dataframe is None:
            raise ValueError(f"this {type(log).__name__} holds no log: build it from a DataFrame")
        return log.dataframe
    if not isinstance(log, DataFrame):
        raise TypeError(f"a log is a Spark DataFrame or an EventLog, not {type(log).__name__}")
    check_zone(log.sparkSession)
    if is_event_log(log):
        return log
    if "case_id" in log.columns and not {"timestamp", (names or get_global_config()).timestamp, *(column_mapping or {}).values()} & set(log.columns):
        raise ValueError(f"{log.columns} has a row for each case, not for each event: a stage on cases ends a pipeline")
    if event_ids not in ("dense", "source") or event_ids == "source" and order_by is None:
        raise ValueError('event_ids is "dense", or "source" with order_by')
    tied = log.withColumn("__tie", F.col(f"`{order_by}`") if order_by else F.monotonically_increasing_id())
    df = normalize_columns(tied, column_mapping, names)
    df = df.withColumn("timestamp", parsed_time("timestamp", df.schema["timestamp"].dataType)).where("case_id IS NOT NULL")
    if warn and (bad := df.where("timestamp IS NULL").count()):
        warnings.warn(f"{bad} times can't be read", stacklevel=2)
    rest = [c for c in df.columns if c not in (*KEYS, "__tie")]
    if event_ids == "source":
        return df.select("case_id", "timestamp", F.col("__tie").alias("event_id"), *(F.col(f"`{c}`") for c in rest))
    ranges = max(1, min(256, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    offsets = case_offsets(df.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")), ranges)
    position = F.row_number().over(in_order(event="__tie")) - 1
    numbered = df.withColumn("__position", position).join(offsets, "case_id")
    return numbered.select("case_id", "timestamp", (F.col("before") + F.col("__position")).alias("event_id"), *(F.col(f"`{c}`") for c in rest))


def case_ids(log: DataFrame | EventLog) -> DataFrame:
    return to_event_log(log).select(*KEYS)


def timestamps(log: DataFrame | EventLog) -> DataFrame:
    return to_event_log(log).select(*KEYS)


def event_ids(log: DataFrame | EventLog) -> DataFrame:
    return to_event_log(log).select(*KEYS)


def trace_positions(log: DataFrame | EventLog) -> DataFrame:
    """The keys and trace_position: 0 for a case's first event, 1 for the next."""
    return to_event_log(log).select(*KEYS, (F.row_number().over(in_order()) - 1).cast("long").alias("trace_position"))


def log_summary(log: DataFrame | EventLog) -> DataFrame:
    """One row: n_cases, n_events, n_activities (null without activities)."""
    df = to_event_log(log)
    activities = F.count_distinct("activity") if "activity" in df.columns else F.lit(None).cast("long")
    return df.agg(F.count_distinct("case_id").alias("n_cases"), F.count(F.lit(1)).alias("n_events"), activities.alias("n_activities"))


def case_bounds(log: DataFrame | EventLog) -> DataFrame:
    """case_id, first, last, n_events and duration_days of each case."""
    return (
        to_event_log(log)
        .groupBy("case_id")
        .agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count(F.lit(1)).alias("n_events"))
        .withColumn("duration_days", (F.unix_micros("last") - F.unix_micros("first")) / 86400e6)
    )

"""Public logs by name, and loading them from a folder with a cache beside them."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from eventloom.eventlog import EventLog, to_event_log
from eventloom.plans.storage import exists, is_local
from eventloom.sources.files import FORMATS, read_log, write_log


@dataclass(frozen=True)
class Entry:
    """files: the published files' names. split: published parameters of the unbiased split. drop, rename: columns, on load."""

    files: tuple[str, ...]
    split: dict[str, object] | None = None
    drop: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)


def _split(start_date: str | None, end_date: str | None, max_days: float) -> dict[str, object]:
    return {"start_date": start_date, "end_date": end_date, "max_days": max_days}


#: The published names of the files, and the split parameters (first month, last month, longest case in days).
CATALOG = {
    "BPI11": Entry(("Hospital_log.xes.gz",)),
    "BPI12": Entry(("BPI_Challenge_2012.xes.gz",), _split(None, "2012-02", 32.28)),
    "BPI13ClosedProblems": Entry(("BPI_Challenge_2013_closed_problems.xes.gz",)),
    "BPI13Incidents": Entry(("BPI_Challenge_2013_incidents.xes.gz",)),
    "BPI13OpenProblems": Entry(("BPI_Challenge_2013_open_problems.xes.gz",)),
    "BPI15": Entry(
        ("BPIC15_5.xes", "BPIC15_4.xes", "BPIC15_3.xes", "BPIC15_2.xes", "BPIC15_1.xes"), drop=("activityNameNL", "concept:name"), rename={"activityNameEN": "concept:name"}
    ),
    "BPI17": Entry(("BPI Challenge 2017.xes.gz",), _split(None, "2017-01", 47.81)),
    "BPI19": Entry(("BPI_Challenge_2019.xes",), _split("2018-01", "2019-02", 143.33)),
    "BPI20PrepaidTravelCosts": Entry(("PrepaidTravelCost.xes.gz",), _split(None, "2019-01", 114.26)),
    "BPI20TravelPermitData": Entry(("PermitLog.xes.gz",), _split(None, "2019-10", 258.81)),
    "BPI20RequestForPayment": Entry(("RequestForPayment.xes.gz",), _split(None, "2018-12", 28.86)),
    "BPI20DomesticDeclarations": Entry(("DomesticDeclarations.xes.gz",)),
    "BPI20InternationalDeclarations": Entry(("InternationalDeclarations.xes.gz",)),
    "Sepsis": Entry(("Sepsis Cases - Event Log.xes.gz",)),
}


class CatalogLog(EventLog):
    """A log of the catalog. unbiased_split_params gives a copy of the published parameters; ValueError if there are none."""

    def __init__(self, name: str, dataframe: DataFrame):
        self.name = name
        super().__init__(dataframe)

    @property
    def unbiased_split_params(self) -> dict[str, object]:
        if (split := CATALOG[self.name].split) is None:
            raise ValueError(f"{self.name} has no published parameters of the unbiased split")
        return dict(split)


def load(spark: SparkSession, name: str, folder: str | None = None, cache: str = "parquet") -> CatalogLog:
    """A log from folder/name: the cached table if there is one, else the published files, which are then cached.

    folder, in any store that Spark reads, must exist if it is given; by default it is ~/eventloom/event_logs, in local
    mode only, as other machines don't see it. An unknown cache format means parquet. The files themselves have to be
    there: nothing is downloaded. ValueError where there are none, or no events.
    """
    if name not in CATALOG:
        raise ValueError(f"{name!r} isn't in the catalog: {list(CATALOG)}")
    if folder is None and not is_local(spark):
        raise ValueError("name the folder: a home folder isn't shared by a cluster's machines")
    if folder is not None and not exists(spark, str(folder)):
        raise ValueError(f"{folder} is no folder")
    kind = cache if cache in FORMATS else "parquet"
    own = f"{folder if folder is not None else Path.home() / 'eventloom' / 'event_logs'}/{name}"
    cached = f"{own}/{name}{FORMATS[kind]}"
    entry = CATALOG[name]
    if not exists(spark, cached):
        files = [f"{own}/{f}" for f in entry.files]
        if missing := [f for f in files if not exists(spark, f)]:
            raise ValueError(f"no cached table and no published files: {missing}")
        write_log(read_log(spark, *files), cached, kind)
    df = read_log(spark, cached)
    if df.isEmpty():
        raise ValueError(f"{cached} holds no events")
    return CatalogLog(name, to_event_log(df.drop(*entry.drop).withColumnsRenamed(entry.rename)))

"""Resource roles: resources whose activity profiles correlate, and what links connect."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.base import BaseProcessTransformer
from eventloom.eventlog import EventLog, numbered_rows, to_event_log
from eventloom.functions.selection import validate_columns
from eventloom.operators.components import components
from eventloom.plans.storage import written
from eventloom.schema import KEYS

#: The role of resources that fit has not seen.
UNKNOWN_ROLE = 0
#: Resources of a block, and activities whose counts are multiplied at a time.
BLOCK, WIDE = 1024, 4096


class ConceptDriftWarning(UserWarning):
    """The log holds values that fit has not seen."""


def resource_profiles(log: DataFrame | EventLog) -> DataFrame:
    """resource, activity, n: how often each resource does each activity."""
    return to_event_log(log).groupBy("resource", "activity").agg(F.count(F.lit(1)).alias("n"))


def resource_correlation(profiles: DataFrame) -> DataFrame:
    """a, b, r: Pearson correlation of two resources' profiles, a < b, for pairs that share an activity.

    Profiles have an entry for each activity and one more, zero, for unknown activities. Pairs that share none have a
    negative correlation or, like constant profiles, none. Sums are integers; there is one division. The result has a
    row for each pair, as asked for; roles come from linked_resources, which makes no pairs.
    """
    n = profiles.agg((F.count_distinct("activity") + 1).alias("__size"))
    own = profiles.groupBy("resource").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    left = profiles.select(F.col("resource").alias("a"), "activity", F.col("n").alias("na"))
    right = profiles.select(F.col("resource").alias("b"), "activity", F.col("n").alias("nb"))
    shared = left.join(right, "activity").where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("p"))
    both = (
        shared.join(own.select(F.col("resource").alias("a"), F.col("s").alias("sa"), F.col("q").alias("qa")), "a")
        .join(own.select(F.col("resource").alias("b"), F.col("s").alias("sb"), F.col("q").alias("qb")), "b")
        .crossJoin(F.broadcast(n))
    )
    size = F.col("__size")
    spread = (size * F.col("qa") - F.col("sa") * F.col("sa")).cast("double") * (size * F.col("qb") - F.col("sb") * F.col("sb")).cast("double")
    r = F.when(spread > 0, (size * F.col("p") - F.col("sa") * F.col("sb")) / F.sqrt(spread))
    return both.select("a", "b", r.alias("r"))


def _linked(profiles: list[list[tuple[int, int]]], size: int, threshold: float) -> np.ndarray:
    """For each profile, (number of an activity, count) each, the first profile that links lead to."""
    n = len(profiles)
    sums = np.array([sum(c for _, c in p) for p in profiles], np.int64)
    squares = np.array([sum(c * c for _, c in p) for p in profiles], np.int64)
    names = sorted({a for p in profiles for a, _ in p})
    place = {a: i for i, a in enumerate(names)}
    shared = np.zeros((n, n))  # whole numbers, exact up to 2 ** 53
    for at in range(0, len(names), WIDE):
        part = np.zeros((n, min(WIDE, len(names) - at)))
        for i, p in enumerate(profiles):
            for a, c in p:
                if 0 <= place[a] - at < WIDE:
                    part[i, place[a] - at] = c
        shared += part @ part.T
    own = (size * squares - sums * sums).astype(np.float64)
    spread = own[:, None] * own
    with np.errstate(all="ignore"):
        near = np.where(spread > 0, (size * shared.astype(np.int64) - sums[:, None] * sums) / np.sqrt(spread), -1.0) > threshold
    np.fill_diagonal(near, True)
    label = np.arange(n)
    while True:
        lower = np.where(near, label, n).min(1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def linked_resources(profiles: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """a, b: edges that connect the resources whose profiles correlate over threshold, and those that these connect.

    Blocks of resources meet in pairs; a task multiplies the counts of two blocks and passes on one edge for each
    resource at most, whatever the number of its links. A profile, one row, is the unit of memory.
    """
    kind = profiles.schema["resource"].dataType
    n, size = profiles.agg(F.count_distinct("resource"), F.count_distinct("activity") + 1).first()
    blocks = max(1, -(-n // block))
    rows = profiles.groupBy("resource").agg(F.collect_list(F.struct(F.xxhash64("activity").alias("activity"), "n")).alias("profile"))
    own = F.pmod(F.xxhash64("resource"), F.lit(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    met = rows.withColumn("own", own).withColumn("other", other).select("resource", "profile", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def edges(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("resource")  # so that an edge leads from the smaller resource
        label = _linked([[(r["activity"], r["n"]) for r in p] for p in part["profile"]], int(size), threshold)
        at = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"a": part["resource"].to_numpy()[label[at]], "b": part["resource"].to_numpy()[at]})

    return met.groupBy("i", "j").applyInPandas(edges, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


class ResourcePoolExtractor(BaseProcessTransformer):
    """fit finds roles: resources with a correlation over threshold are linked, and connected ones share a role.

    Roles are numbered from 1 by their first resource in the log; role 0 is for resources that fit has not seen.
    """

    names_out = ("resource_roles",)

    def __init__(self, threshold: float = 0.7):
        self.threshold = threshold

    def _check(self, df: DataFrame) -> None:
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold lies between 0 and 1")
        validate_columns(df.columns, ["activity", "resource"])
        empty = df.agg(F.count_if(F.col("activity").isNull()).alias("activity"), F.count_if(F.col("resource").isNull()).alias("resource")).first()
        if lacking := [c for c in ("activity", "resource") if empty[c]]:
            raise ValueError(f"columns with nulls: {lacking}")

    def _fit(self, df: DataFrame) -> None:
        self._check(df)
        profiles = written(resource_profiles(df), "profiles")
        linked = components(linked_resources(profiles, self.threshold), "role-links")
        first = df.groupBy("resource").agg(F.min(F.struct(*KEYS)).alias("at"))
        placed = first.join(linked, first["resource"] == linked["node"], "left").withColumn("pool", F.coalesce("component", "resource"))
        pools = placed.groupBy("pool").agg(F.min("at").alias("at"))
        ranges = max(1, min(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        numbered = numbered_rows(pools, ["at"], "role", ranges).select("pool", (F.col("role") + 1).cast("long").alias("resource_roles"))
        self.roles_ = written(placed.join(numbered, "pool").select("resource", "resource_roles"), "roles")

    def transform(self, log: DataFrame | EventLog, warn: bool = False) -> DataFrame:
        """The keys and resource_roles. warn: with a job, warns of resources that fit has not seen."""
        self.warn_ = warn
        return super().transform(log)

    def _transform(self, df: DataFrame) -> DataFrame:
        self._check(df)
        warn = self.warn_
        out = df.join(self.roles_, "resource", "left")
        if warn and (new := [r[0] for r in out.where("resource_roles IS NULL").select("resource").distinct().limit(10).collect()]):
            warnings.warn(f"resources that fit has not seen: {new}", ConceptDriftWarning, stacklevel=2)
        return out.select(*KEYS, F.coalesce("resource_roles", F.lit(UNKNOWN_ROLE)).alias("resource_roles"))

"""Trace variants: the order of activities that a case shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.base import CaseLevelTransformer
from eventloom.eventlog import EventLog, case_offsets, to_event_log
from eventloom.plans.storage import written


def traces(log: DataFrame | EventLog) -> DataFrame:
    """case_id and trace, its activities in order; a null activity keeps its place."""
    key = F.struct(F.col("timestamp").isNull().alias("late"), "timestamp", "event_id", "activity")
    ordered = F.array_sort(F.collect_list(key))
    return to_event_log(log).groupBy("case_id").agg(F.transform(ordered, lambda x: x["activity"]).alias("trace"))


def variant_counts(log: DataFrame | EventLog) -> DataFrame:
    """trace and n_cases of each variant."""
    return traces(log).groupBy("trace").agg(F.count(F.lit(1)).alias("n_cases"))


class VariantExtractor(CaseLevelTransformer):
    """Numbers variants from 0 by the smallest case that shows them.

    transform gives a case the number of its variant at fit, null where fit has not seen it.
    """

    names_out = ("variant",)

    def _fit(self, df: DataFrame) -> None:
        found = traces(df).groupBy("trace").agg(F.min("case_id").alias("case_id"))
        found = written(found, "variants")
        ranges = max(1, min(256, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        ranked = case_offsets(found.select("case_id", F.lit(1).cast("long").alias("n")), ranges)
        self.variants_ = found.join(ranked, "case_id").select("trace", F.col("before").alias("variant"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return traces(df).join(self.variants_, "trace", "left").select("case_id", "variant")

    def inverse_transform(self, codes: DataFrame, column: str = "variant") -> DataFrame:
        """codes with the trace of each number; null for a number that isn't a variant's."""
        known = self.variants_.withColumnRenamed("variant", "__variant")
        return codes.join(known, F.col(column) == F.col("__variant"), "left").drop("__variant")

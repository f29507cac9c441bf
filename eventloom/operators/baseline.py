"""Simple predictors and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.base import NotFittedError, Parameterized


class ActivityMeanRegressor(Parameterized):
    """Predicts the mean of y over the events of the same activity; an activity that is new or null, the mean of all."""

    def __init__(self, activity: str = "activity", target: str = "y"):
        self.activity, self.target = activity, target

    def fit(self, df: DataFrame) -> ActivityMeanRegressor:
        """df has the activity and y as columns. Means and the mean of all come from one pass over grouping sets."""
        sets = df.rollup(self.activity).agg(F.avg(self.target).alias("mean"), F.grouping(self.activity).alias("all"))
        self.means_ = sets.where("all = 0 AND " + f"`{self.activity}` IS NOT NULL").select(F.col(self.activity).alias("__activity"), F.col("mean").alias("__mean"))
        self.global_mean_ = sets.where("all = 1").select(F.col("mean").alias("__global"))
        return self

    def predict(self, df: DataFrame, into: str = "prediction") -> DataFrame:
        if not hasattr(self, "means_"):
            raise NotFittedError("ActivityMeanRegressor isn't fitted yet")
        joined = df.join(self.means_, df[self.activity] == self.means_["__activity"], "left").crossJoin(F.broadcast(self.global_mean_))
        return joined.withColumn(into, F.coalesce("__mean", "__global")).drop("__activity", "__mean", "__global")


def mean_baseline(df: DataFrame, target: str, into: str = "prediction") -> DataFrame:
    return df.crossJoin(F.broadcast(df.agg(F.avg(target).alias(into))))


def majority_baseline(df: DataFrame, target: str, into: str = "prediction") -> DataFrame:
    """df with the most frequent value; of equally frequent ones, the smallest."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(target).alias("v"))).alias("m")).select(F.col("m.v").alias(into))
    return df.crossJoin(F.broadcast(top))


def mean_absolute_error(df: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(target) - F.col(prediction))).alias("mae"))


def accuracy(df: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(target) == F.col(prediction)).cast("double")).alias("accuracy"))


def error_by(df: DataFrame, by: str, target: str, prediction: str = "prediction") -> DataFrame:
    return df.groupBy(by).agg(F.avg(F.abs(F.col(target) - F.col(prediction))).alias("mae"), F.count(F.lit(1)).alias("n"))


def confusion(df: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """actual, predicted, n and share, of the actual value's rows."""
    from pyspark.sql import Window

    counts = df.groupBy(F.col(target).alias("actual"), F.col(prediction).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("actual")))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value and n, the most frequent first, equally frequent ones by value; a null counts as a value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


def cross_table(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """row, column, n of every pair that occurs: a cross table in long form."""
    return df.groupBy(F.col(rows).alias("row"), F.col(columns).alias("column")).agg(F.count(F.lit(1)).alias("n"))

"""Prefix encodings: rolling aggregates, sliding windows, absolute positions, buckets.

Each encoder is fitted on a log, where it takes down columns and positions, and then adds columns to any log. All
columns of one encoder come from one projection over one ordering of each case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.base import NotFittedError, Parameterized, checked_names
from eventloom.eventlog import EventLog, to_event_log
from eventloom.functions.selection import validate_columns
from eventloom.schema import KEYS, feature_columns, in_order, prefix


class Encoder(Parameterized):
    """fit takes down the feature columns; transform returns the keys and the encoded columns, as they are declared."""

    def fit(self, log: DataFrame | EventLog) -> Encoder:
        df = to_event_log(log)
        self._check(df, names := feature_columns(df))
        self.feature_names_in_ = names
        self.n_features_in_ = len(self.feature_names_in_)
        self._fit(df)
        return self

    def transform(self, log: DataFrame | EventLog) -> DataFrame:
        df = to_event_log(log)
        out = df.select(*KEYS, *self.columns(df))
        checked_names(out.columns[len(KEYS) :], self.get_feature_names_out(), self)
        return out

    def columns(self, df: DataFrame) -> list[Column]:
        """The encoded columns of a canonical log, for one projection with others."""
        if not hasattr(self, "feature_names_in_"):
            raise NotFittedError(f"{type(self).__name__} isn't fitted yet")
        validate_columns(df.columns, self.feature_names_in_)
        self._check(df, self.feature_names_in_)
        return self._columns(df)

    def fit_transform(self, log: DataFrame | EventLog) -> DataFrame:
        return self.fit(log).transform(log)

    def _check(self, df: DataFrame, names: list[str]) -> None:
        pass

    def _fit(self, df: DataFrame) -> None:
        pass

    def _columns(self, df: DataFrame) -> list[Column]:
        raise NotImplementedError

    def get_feature_names_out(self) -> list[str]:
        return list(self.feature_names_in_)


def _norm(c: Column, frame) -> Column:
    whole = F.count(c).over(frame) == F.count(F.lit(1)).over(frame)
    return F.when(whole, F.sqrt(F.sum(c * c).over(frame)))


METHODS = {
    "mean": lambda c, frame: F.avg(c).over(frame),
    "sum": lambda c, frame: F.sum(c).over(frame),
    "median": lambda c, frame: F.percentile(c, F.lit(0.5)).over(frame),
    "norm": _norm,
}


class Aggregation(Encoder):
    """Rolling mean, sum, median or Euclidean norm of every feature over a case's last prefix_len events; None: all.

    Nulls don't count, but make a norm null. median sorts each frame, so that whole prefixes of very long cases cost
    more than in proportion. engine is taken for compatibility; there is one way to compute.
    """

    def __init__(self, method: str = "mean", prefix_len: int | None = None, engine: str = "spark"):
        self.method, self.prefix_len, self.engine = method, prefix_len, engine

    def _check(self, df: DataFrame, names: list[str]) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method is one of {list(METHODS)}, not {self.method!r}")
        if self.prefix_len is not None and (not isinstance(self.prefix_len, int) or self.prefix_len < 1):
            raise ValueError("prefix_len is a positive integer or None")
        wrong = {c: df.schema[c].dataType.simpleString() for c in names if not isinstance(df.schema[c].dataType, T.NumericType | T.BooleanType)}
        if wrong:
            raise ValueError(f"columns that aren't numeric: {wrong}; choose others, or encode them first")

    def _columns(self, df: DataFrame) -> list[Column]:
        frame = prefix(self.prefix_len)
        return [METHODS[self.method](F.col(f"`{c}`").cast("double"), frame).alias(c) for c in self.feature_names_in_]


class Positional(Encoder):
    """Columns <attribute>_<label>_<position>; fill_value stands where a case has no event, None for null."""

    label = ""

    def __init__(self, fill_value: float | str | None = 0):
        self.fill_value = fill_value

    def _check(self, df: DataFrame, names: list[str]) -> None:
        if not isinstance(self.fill_value, int | float | str | None):
            raise ValueError("fill_value is a number, a string or None")

    def _fill(self, df: DataFrame, column: str) -> Column:
        return F.lit(self.fill_value).try_cast(df.schema[column].dataType)

    def positions(self) -> range:
        raise NotImplementedError

    def get_feature_names_out(self) -> list[str]:
        return [f"{c}_{self.label}_{j}" for c in self.feature_names_in_ for j in self.positions()]


class Windowing(Positional):
    """<attr>_w_j: the attribute's value j events back in the case, j = 0 ... n-1."""

    label = "w"

    def __init__(self, n: int = 2, fill_value: float | str | None = 0):
        super().__init__(fill_value)
        self.n = n

    def _check(self, df: DataFrame, names: list[str]) -> None:
        super()._check(df, names)
        if not isinstance(self.n, int) or self.n < 1:
            raise ValueError("n is a positive integer")

    def positions(self) -> range:
        return range(self.n)

    def _columns(self, df: DataFrame) -> list[Column]:
        position = F.row_number().over(in_order()) - 1
        return [
            (F.col(f"`{c}`") if not j else F.when(position >= j, F.lag(f"`{c}`", j).over(in_order())).otherwise(self._fill(df, c))).alias(f"{c}_w_{j}")
            for c in self.feature_names_in_
            for j in self.positions()
        ]


class Indexing(Positional):
    """<attr>_pos_j: the value of the case's j-th event, from the moment it is known; width: the longest case at fit."""

    label = "pos"

    def _fit(self, df: DataFrame) -> None:
        self.width_ = df.groupBy("case_id").count().agg(F.max("count")).first()[0] or 0

    def positions(self) -> range:
        return range(self.width_)

    def _columns(self, df: DataFrame) -> list[Column]:
        position = F.row_number().over(in_order()) - 1
        return [
            F.when(position >= j, F.nth_value(f"`{c}`", j + 1).over(prefix())).otherwise(self._fill(df, c)).alias(f"{c}_pos_{j}")
            for c in self.feature_names_in_
            for j in self.positions()
        ]


class Bucketing(Encoder):
    """bucket: "b1" for all ("single"), or "b" and the event's position from 1 ("prefix")."""

    def __init__(self, method: str = "single"):
        self.method = method

    def _check(self, df: DataFrame, names: list[str]) -> None:
        if self.method == "clustering":
            raise NotImplementedError("clustering isn't implemented")
        if self.method not in ("single", "prefix"):
            raise ValueError(f"method is single or prefix, not {self.method!r}")

    def get_feature_names_out(self) -> list[str]:
        return ["bucket"]

    def _columns(self, df: DataFrame) -> list[Column]:
        number = F.row_number().over(in_order())
        return [(F.lit("b1") if self.method == "single" else F.concat(F.lit("b"), number.cast("string"))).alias("bucket")]


class OneHot(Encoder):
    """<column>_<value>: 1.0 where the column has the value; values are those at fit, sorted; others have zeros."""

    def __init__(self, column: str = "activity", most: int = 1000):
        self.column, self.most = column, most

    def _fit(self, df: DataFrame) -> None:
        validate_columns(df.columns, [self.column])
        found = df.select(F.col(f"`{self.column}`").alias("v")).where("v IS NOT NULL").distinct().limit(self.most + 1).collect()
        if len(found) > self.most:
            raise ValueError(f"{self.column} has more than {self.most} values")
        self.values_ = sorted(r.v for r in found)

    def get_feature_names_out(self) -> list[str]:
        return [f"{self.column}_{v}" for v in self.values_]

    def _columns(self, df: DataFrame) -> list[Column]:
        return [F.coalesce((F.col(f"`{self.column}`") == v).cast("double"), F.lit(0.0)).alias(f"{self.column}_{v}") for v in self.values_]

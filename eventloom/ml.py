"""pyspark.ml stages for pipelines: they add columns to a log in one projection, and can be copied, tuned, saved and loaded."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.base import BaseProcessTransformer, CaseLevelTransformer, checked_names
from eventloom.eventlog import to_event_log
from eventloom.functions.time import time_columns
from eventloom.operators import encoding
from eventloom.operators.baseline import ActivityMeanRegressor
from eventloom.operators.encoding import Encoder
from eventloom.schema import KEYS

__all__ = [
    "ActivityMean",
    "ActivityMeanModel",
    "BaseProcessTransformer",
    "CaseLevelTransformer",
    "EncoderModel",
    "EncoderStage",
    "FunctionStage",
    "TimeFeatures",
]


def _with(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """The log's columns and the new ones, which replace those of their names: one projection, every row kept."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in made), *(c.alias(n) for n, c in made.items()))


def _param(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc)


class TimeFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the time features to a log."""

    case_features = _param("case_features", "names of case features, all or None")
    event_features = _param("event_features", "names of calendar features, all or None")
    time_unit = _param("time_unit", "s, m, h, d or w")

    def __init__(self, case_features="all", event_features="all", time_unit: str = "s"):
        super().__init__()
        self._set(time_unit=time_unit)
        # a Param takes no None: an empty list stands for it
        for name, value in (("case_features", case_features), ("event_features", event_features)):
            self.set(self.getParam(name), [] if value is None else value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        chosen = (self.getOrDefault(p) or None for p in ("case_features", "event_features"))
        return _with(to_event_log(dataset), time_columns(*chosen, self.getOrDefault("time_unit")))


class _EncoderParams:
    encoder = _param("encoder", "the encoder's class")
    options = _param("options", "the encoder's parameters, by name")
    columns = _param("columns", "the log's columns that are encoded")

    def made(self) -> Encoder:
        """The encoder that the params describe, not fitted."""
        return getattr(encoding, self.getOrDefault("encoder"))(**self.getOrDefault("options"))


class EncoderModel(Model, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Adds a fitted encoder's columns to a log."""

    state = _param("state", "what the encoder has learnt, by name")

    def fitted(self) -> Encoder:
        encoder = self.made()
        for name, value in self.getOrDefault("state").items():
            setattr(encoder, name, value)
        return encoder

    def _transform(self, dataset: DataFrame) -> DataFrame:
        df, encoder = to_event_log(dataset), self.fitted()
        made = encoder.columns(df)
        names = encoder.get_feature_names_out()
        checked_names(df.select(*made).columns, names, encoder)
        return _with(df, dict(zip(names, made, strict=True)))


class EncoderStage(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fits an encoder on some columns of the log and adds its columns. A tuner varies options or columns."""

    def __init__(self, encoder: Encoder | None = None, columns: Iterable[str] | None = None):
        super().__init__()
        if encoder is not None:
            self._set(encoder=type(encoder).__name__, options=encoder.get_params(), columns=list(columns or []))

    def _fit(self, dataset: DataFrame) -> EncoderModel:
        columns = self.getOrDefault("columns")
        fitted = self.made().fit(to_event_log(dataset).select(*KEYS, *(F.col(f"`{c}`") for c in columns)))
        state = {k: v for k, v in vars(fitted).items() if k.endswith("_")}
        return EncoderModel()._set(encoder=self.getOrDefault("encoder"), options=self.getOrDefault("options"), columns=columns, state=state)


class _MeanParams:
    labelCol = _param("labelCol", "target column")
    predictionCol = _param("predictionCol", "column of predictions")
    activityCol = _param("activityCol", "column of activities")


class _MeansWriter(MLWriter):
    def __init__(self, instance: ActivityMeanModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sc)
        self.instance.regressor.means_.write.parquet(f"{path}/means")
        self.instance.regressor.global_mean_.write.parquet(f"{path}/global")


class _MeansReader(MLReader):
    def load(self, path: str) -> ActivityMeanModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sc)
        model = ActivityMeanModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        regressor = ActivityMeanRegressor(model.getOrDefault("activityCol"), model.getOrDefault("labelCol"))
        spark = self.sparkSession
        regressor.means_, regressor.global_mean_ = spark.read.parquet(f"{path}/means"), spark.read.parquet(f"{path}/global")
        model.regressor = regressor
        return model


class ActivityMeanModel(Model, _MeanParams, MLReadable, MLWritable):
    """Adds the mean of the target over the events of the same activity."""

    regressor: ActivityMeanRegressor

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.regressor.predict(dataset, self.getOrDefault("predictionCol"))

    def write(self) -> MLWriter:
        return _MeansWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _MeansReader()


class ActivityMean(Estimator, _MeanParams, DefaultParamsReadable, DefaultParamsWritable):
    """The activity means as a predictor; labelCol is the target."""

    def __init__(self, labelCol: str = "y", predictionCol: str = "prediction", activityCol: str = "activity"):
        super().__init__()
        self._set(labelCol=labelCol, predictionCol=predictionCol, activityCol=activityCol)

    def _fit(self, dataset: DataFrame) -> ActivityMeanModel:
        names = {p: self.getOrDefault(p) for p in ("labelCol", "predictionCol", "activityCol")}
        model = ActivityMeanModel()._set(**names)
        model.regressor = ActivityMeanRegressor(names["activityCol"], names["labelCol"]).fit(dataset)
        return model


class FunctionStage(Transformer):
    """Any function from a DataFrame to a DataFrame as a stage. It can't be saved."""

    def __init__(self, function: Callable[[DataFrame], DataFrame]):
        super().__init__()
        self.function = function

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.function(dataset)

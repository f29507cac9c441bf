import datetime as dt

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from eventloom import ml, schema
from eventloom.eventlog import to_event_log, trace_positions
from eventloom.functions import targets
from eventloom.operators.encoding import Aggregation, Indexing, OneHot, Windowing
from eventloom.streaming import online

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture()
def log(spark):
    rows = [(f"c{i}", BASE + dt.timedelta(hours=7 * i + j * j), "abc"[(i + j) % 3], float(i * j)) for i in range(6) for j in range(4)]
    return to_event_log(spark.createDataFrame(rows, "case_id string, timestamp timestamp, activity string, value double"))


def test_pipeline(log):
    labelled = log.join(targets.remaining_time(log).withColumnRenamed("remaining_time", "y"), list(schema.KEYS))
    stages = [ml.TimeFeatures(event_features="hour_of_day"), ml.EncoderStage(Windowing(2, "<pad>"), ["activity"]), ml.FunctionStage(lambda df: df), ml.ActivityMean()]
    out = Pipeline(stages=stages).fit(labelled).transform(labelled)
    assert {"accumulated_time", "hour_of_day", "activity_w_1", "prediction", "value"} <= set(out.columns)
    assert out.count() == 24
    means = {r.activity: r.m for r in labelled.groupBy("activity").agg(F.avg("y").alias("m")).collect()}
    assert all(abs(r.prediction - means[r.activity]) < 1e-9 for r in out.collect())


def test_every_row_stays(spark, log):
    """Also events whose time can't be read; and the windows of a case share one exchange."""
    rows = [("a", "2024-01-01 10:00:00", "x", 1.0), ("a", "no time", "y", 2.0), ("b", None, "x", 3.0)]
    odd = to_event_log(spark.createDataFrame(rows, "case_id string, timestamp string, activity string, value double"))
    stages = [ml.TimeFeatures("all", ["hour_of_day"]), ml.EncoderStage(Windowing(2, "<pad>"), ["activity"]), ml.EncoderStage(Aggregation("sum"), ["value"])]
    out = Pipeline(stages=stages).fit(odd).transform(odd)
    assert out.count() == 3 and {(r.activity, r.activity_w_1, r.value) for r in out.collect()} == {("x", "<pad>", 1.0), ("y", "x", 3.0), ("x", "<pad>", 3.0)}
    canonical = log.select(*log.columns)
    plan = Pipeline(stages=[*stages[:2]]).fit(canonical).transform(spark.createDataFrame(log.collect(), log.schema))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_params_copies_saving_and_loading(spark, log, tmp_path):
    from pyspark.ml import PipelineModel

    time = ml.TimeFeatures("accumulated_time", None, "h")
    assert time.copy({time.time_unit: "d"}).getOrDefault("time_unit") == "d" and time.getOrDefault("time_unit") == "h"
    stage = ml.EncoderStage(Windowing(2, "<pad>"), ["activity"])
    wider = stage.copy({stage.options: {"n": 3, "fill_value": "<pad>"}})
    assert "activity_w_2" in wider.fit(log).transform(log).columns and "activity_w_2" not in stage.fit(log).transform(log).columns
    labelled = log.join(targets.remaining_time(log).withColumnRenamed("remaining_time", "y"), list(schema.KEYS))
    stages = [time, stage, ml.EncoderStage(Indexing("<pad>"), ["activity"]), ml.EncoderStage(OneHot("activity"), ["activity"]), ml.ActivityMean()]
    Pipeline(stages=stages).save(str(tmp_path / "plan"))
    fitted = Pipeline.load(str(tmp_path / "plan")).fit(labelled)
    fitted.save(str(tmp_path / "fitted"))
    again = PipelineModel.load(str(tmp_path / "fitted"))
    one, two = (sorted(map(str, m.transform(labelled).collect())) for m in (fitted, again))
    assert one == two and len(one) == 24
    assert {"accumulated_time", "activity_w_1", "activity_pos_3", "activity_a", "prediction"} <= set(again.transform(labelled).columns)


def test_params_of_extractors():
    from eventloom.operators.baseline import ActivityMeanRegressor
    from eventloom.operators.encoding import Bucketing
    from eventloom.operators.extractors import TimestampExtractor, WorkInProgress
    from eventloom.operators.roles import ResourcePoolExtractor
    from eventloom.operators.variants import VariantExtractor

    for stage in (TimestampExtractor(), WorkInProgress(), ResourcePoolExtractor(), VariantExtractor(), ActivityMeanRegressor(), Aggregation(), Indexing(), Windowing(), Bucketing(), OneHot()):
        params = stage.get_params()
        assert type(stage.clone()).__name__ in repr(stage) and stage.clone().get_params() == params
        stage.set_params(**params)
        with pytest.raises(ValueError):
            stage.set_params(no_such=1)
    assert WorkInProgress("2D").set_params(window_size="W").clone().window_size == "W"


def test_names_are_checked(log):
    class Odd(Windowing):
        def get_feature_names_out(self):
            return ["other"]

    with pytest.raises(ValueError, match="declares"):
        Odd(2).fit(log).transform(log)


def test_cases_end_a_pipeline(log):
    from eventloom.operators.variants import VariantExtractor

    class Longest(ml.CaseLevelTransformer):
        names_out = ("n",)

        def _transform(self, df):
            return df.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))

    for stage in (VariantExtractor(), Longest()):
        made = stage.fit(log).transform(log)
        assert stage.cardinality == "case" and made.columns == ["case_id", *stage.names_out] and made.count() == 6
        with pytest.raises(ValueError, match="row for each case"):
            Windowing(2).fit(made)

    class Lost(Longest):
        def _transform(self, df):
            return df.select(F.lit(1).alias("n"))

    with pytest.raises(ValueError):
        Lost().fit(log).transform(log)


def test_own_stage(log):
    class Doubled(ml.BaseProcessTransformer):
        names_out = ("twice",)

        def _transform(self, df):
            return df.select(*schema.KEYS, (F.col("value") * 2).alias("twice"))

    assert Doubled().fit(log).transform(log).agg(F.sum("twice")).first()[0] == 2 * log.agg(F.sum("value")).first()[0]
    with pytest.raises(ValueError):
        Doubled().transform(log)

    class Wrong(Doubled):
        names_out = ("other",)

    with pytest.raises(ValueError):
        Wrong().fit(log).transform(log)


def test_online_features_match_batch_ones(spark, log, tmp_path):
    from eventloom.functions.time import time_features

    path = str(tmp_path / "in")
    for part in range(2):  # two micro-batches, in order of time
        log.where(F.col("timestamp") < F.lit(BASE + dt.timedelta(hours=20)) if not part else F.col("timestamp") >= F.lit(BASE + dt.timedelta(hours=20))).select("case_id", "timestamp", "event_id", "activity").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = online.online_features(stream, 2).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r.case_id, r.event_id): (r.trace_position, r.accumulated_time, r.time_since_last_event, r.activity_w_1) for r in spark.table("online").collect()}
    made = time_features(log, "all", None).join(Windowing(2, "<pad>").fit_transform(log.drop("value")), list(schema.KEYS))
    position = {r.event_id: r.trace_position for r in trace_positions(log).collect()}
    want = {(r.case_id, r.event_id): (position[r.event_id], r.accumulated_time, r.time_since_last_event, r.activity_w_1) for r in made.collect()}
    assert got == want


def test_online_counts(spark, log, tmp_path):
    path = str(tmp_path / "in")
    log.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(log.schema).parquet(path)
    for frame, mode, name in ((online.online_work_in_progress(stream, "1 day", "0 seconds"), "append", "wip"), (online.online_transitions(stream), "complete", "counts")):
        query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    assert spark.table("wip").where("wip > 0").count() == 1
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 24


def test_extractors(log):
    from eventloom.operators.extractors import TimestampExtractor, WorkInProgress

    made = TimestampExtractor("all", ["hour_of_day"], "h").fit(log).transform(log)
    assert made.columns == [*schema.KEYS, "accumulated_time", "time_since_last_event", "hour_of_day"]
    assert WorkInProgress("2D").fit(log).transform(log).columns == [*schema.KEYS, "wip"]
    for wrong in (TimestampExtractor(None, None), WorkInProgress("2 days"), TimestampExtractor("remaining_time")):
        with pytest.raises(ValueError):
            wrong.fit(log)
    with pytest.raises(ValueError):
        WorkInProgress().transform(log)

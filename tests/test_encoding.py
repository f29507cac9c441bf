import pytest
from pyspark.sql import functions as F

from eventloom import schema
from eventloom.eventlog import to_event_log
from eventloom.operators import encoding as enc


def log(spark, rows, names="v double"):
    rows = [(c, f"2024-01-01 00:00:{i:02d}", *rest) for i, (c, *rest) in enumerate(rows)]
    df = to_event_log(spark.createDataFrame(rows, f"case_id string, timestamp string, {names}").withColumn("activity", F.lit("x")))
    return df.drop("activity")


def column(df, name):
    return [r[name] for r in df.orderBy("event_id").collect()]


PQ = [("p", 10.0), ("p", 20.0), ("p", 30.0), ("q", 40.0), ("q", 50.0)]


@pytest.mark.parametrize(
    "method,length,want",
    [
        ("mean", None, [10, 15, 20, 40, 45]),
        ("sum", 2, [10, 30, 50, 40, 90]),
        ("median", None, [10, 15, 20, 40, 45]),
        ("norm", 1, [10, 20, 30, 40, 50]),
        ("mean", 2, [10, 15, 25, 40, 45]),
    ],
)
def test_aggregation(spark, method, length, want):
    assert column(enc.Aggregation(method, length).fit_transform(log(spark, PQ)), "v") == pytest.approx(want)


def test_nulls_in_frames(spark):
    df = log(spark, [("a", 1.0), ("a", None), ("a", None), ("a", 5.0)])
    assert column(enc.Aggregation("mean", 2).fit_transform(df), "v") == [1.0, 1.0, None, 5.0]
    assert column(enc.Aggregation("norm", 1).fit_transform(df), "v") == [1.0, None, None, 5.0]
    assert column(enc.Aggregation("norm").fit_transform(df), "v") == [1.0, None, None, None]


def test_what_can_be_aggregated(spark):
    assert column(enc.Aggregation("sum").fit_transform(log(spark, [("a", True), ("a", False)], "v boolean")), "v") == [1.0, 1.0]
    with pytest.raises(ValueError, match="v"):
        enc.Aggregation().fit(log(spark, [("a", "x")], "v string"))
    for wrong in ({"method": "mode"}, {"prefix_len": 0}):
        with pytest.raises(ValueError):
            enc.Aggregation(**wrong).fit(log(spark, PQ))


def test_windowing(spark):
    got = enc.Windowing(3, "PAD").fit_transform(log(spark, [("1", "a"), ("1", "b"), ("1", None), ("1", "d")], "act string"))
    assert column(got, "act_w_0") == ["a", "b", None, "d"]
    assert column(got, "act_w_1") == ["PAD", "a", "b", None]
    assert column(got, "act_w_2") == ["PAD", "PAD", "a", "b"]
    assert column(enc.Windowing(2, None).fit_transform(log(spark, PQ)), "v_w_1") == [None, 10, 20, None, 40]
    with pytest.raises(ValueError):
        enc.Windowing(0).fit(log(spark, PQ))


def test_indexing(spark):
    encoder = enc.Indexing("PAD").fit(log(spark, [("1", "a"), ("1", "b"), ("1", "c")], "act string"))
    got = encoder.transform(log(spark, [("1", "a"), ("1", "b"), ("1", "c")], "act string"))
    assert [column(got, f"act_pos_{j}") for j in range(3)] == [["a"] * 3, ["PAD", "b", "b"], ["PAD", "PAD", "c"]]
    longer = encoder.transform(log(spark, [("1", x) for x in "wxyz"], "act string"))
    assert longer.columns == [*schema.KEYS, "act_pos_0", "act_pos_1", "act_pos_2"]
    got = enc.Indexing().fit_transform(log(spark, PQ))
    assert column(got, "v_pos_1") == [0, 20, 20, 0, 50] and column(got, "v_pos_2") == [0, 0, 30, 0, 0]


def test_bucketing(spark):
    assert column(enc.Bucketing().fit_transform(log(spark, PQ)), "bucket") == ["b1"] * 5
    assert column(enc.Bucketing("prefix").fit_transform(log(spark, PQ)), "bucket") == ["b1", "b2", "b3", "b1", "b2"]
    with pytest.raises(NotImplementedError):
        enc.Bucketing("clustering").fit(log(spark, PQ))


def test_one_hot_before_a_prefix_mean(spark):
    df = log(spark, [("1", x) for x in "abacb"], "act string")
    hot = enc.OneHot("act").fit_transform(df)
    got = enc.Aggregation("mean").fit_transform(hot)
    assert column(got, "act_a") == pytest.approx([1, 0.5, 2 / 3, 0.5, 0.4])


def test_fitting_cloning_and_parameters(spark):
    encoder = enc.Windowing(4, "x")
    with pytest.raises(enc.NotFittedError):
        encoder.transform(log(spark, PQ))
    assert encoder.clone().get_params() == {"n": 4, "fill_value": "x"}
    assert encoder.set_params(n=2).n == 2
    with pytest.raises(ValueError):
        encoder.set_params(colour=1)
    fitted = enc.Windowing(2).fit(log(spark, PQ))
    assert fitted.get_feature_names_out() == ["v_w_0", "v_w_1"] and fitted.n_features_in_ == 1
    with pytest.raises(ValueError):
        fitted.transform(log(spark, [("a", 1.0)], "w double"))

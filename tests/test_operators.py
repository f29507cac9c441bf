import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.eventlog import to_event_log
from eventloom.operators import baseline, graph, roles, split, variants
from eventloom.operators.components import components

BASE = dt.datetime(2024, 1, 1)


def log_of(spark, cases, resource=None):
    """cases: {case: [(minutes from the start, activity)]}"""
    rows = [(c, BASE + dt.timedelta(minutes=m), a, resource and resource(c, a)) for c, events in cases.items() for m, a in events]
    return to_event_log(spark.createDataFrame(rows, "case_id string, timestamp timestamp, activity string, resource string").coalesce(1))


# graphs


def test_matrix_degree_and_density(spark):
    traces = spark.createDataFrame([([1, 2, 3],), ([1, 2, 3, 4],), ([9],), (None,)], "trace array<int>")
    edges = graph.frequency_of_traces(traces)
    assert {(r.src, r.dst): r.n for r in edges.collect()} == {(1, 2): 2, (2, 3): 2, (3, 4): 1}
    degrees = {r.node: (r.in_degree, r.out_degree) for r in graph.node_degree(edges).collect()}
    assert degrees == {1: (0, 2), 2: (2, 2), 3: (2, 1), 4: (1, 0)}
    assert graph.density(edges).first().density == pytest.approx(5 / 12)
    assert graph.density(edges, 10).first().density == pytest.approx(5 / 90)
    states = spark.createDataFrame([(7,)], "node int")
    assert graph.node_degree(edges, states).where("node = 7").first().in_degree == 0


def test_cycles(spark):
    ring = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1), ("e", "e", 1)], "src string, dst string, n int")
    got = {n: {r.node for r in graph.nodes_in_cycles(ring, n).where("in_cycle").collect()} for n in (1, 2, 3)}
    assert got == {1: set(), 2: {"e"}, 3: {"a", "b", "c", "e"}}


def test_frequency_keeps_null_activities_apart(spark):
    log = log_of(spark, {"a": [(0, "x"), (1, None), (2, "y")]})
    assert {(r.src, r.dst): r.n for r in graph.frequency(log).collect()} == {("x", None): 1, (None, "y"): 1}


# variants


def test_variants(spark):
    log = log_of(spark, {"1": [(0, "a"), (1, "b")], "2": [(0, "b"), (1, "a")], "3": [(5, "a"), (9, "b")], "4": [(0, "b"), (1, "a")], "5": [(0, None), (1, "a")]})
    extractor = variants.VariantExtractor()
    codes = extractor.fit_transform(log)
    assert {r.case_id: r.variant for r in codes.collect()} == {"1": 0, "2": 1, "3": 0, "4": 1, "5": 2}
    assert {r.case_id: r.trace for r in extractor.inverse_transform(codes).collect()}["5"] == [None, "a"]
    new = extractor.transform(log_of(spark, {"9": [(0, "z")], "8": [(0, "a"), (1, "b")]}))
    assert {r.case_id: r.variant for r in new.collect()} == {"9": None, "8": 0}
    assert {tuple(r.trace): r.n_cases for r in variants.variant_counts(log).collect()}["a", "b"] == 2
    with pytest.raises(ValueError):
        variants.VariantExtractor().transform(log)


# splits


def cases_of(df):
    return {r.case_id for r in df.select("case_id").distinct().collect()}


DAYS = {f"{c:02d}": [(1440 * c + 40 * i, "x") for i in range(4)] for c in range(40)}


def test_temporal(spark):
    log = log_of(spark, DAYS)
    train, test = split.train_test_split(log, test_size=0.25)
    assert cases_of(train) | cases_of(test) == set(DAYS) and not cases_of(train) & cases_of(test)
    assert train.count() + test.count() == 160 and max(cases_of(train)) < min(cases_of(test))
    assert train.columns == log.columns


def test_temporal_counts_time_and_keeps_whole_cases(spark):
    cases = {"early": [(0, "x"), (990, "y")], "mid": [(100, "x")], "late": [(1000, "x")]}
    train, test = split.temporal(log_of(spark, cases), 0.5)
    assert cases_of(train) == {"early", "mid"} and cases_of(test) == {"late"} and train.count() == 3


def test_unbiased(spark):
    # the long case and those that begin in the last 2 days go; of the rest, what ends at or after the k-th start is for testing
    cases = {str(i): [(1440 * i, "x"), (1440 * i + 600, "y")] for i in range(1, 11)} | {"long": [(0, "x"), (1440 * 9, "y")]}
    train, test = split.unbiased(log_of(spark, cases), None, None, 2.0, 0.5)
    assert cases_of(train) == {"1", "2", "3", "4"} and cases_of(test) == {"5", "6", "7", "8"}
    overlapping = cases | {"4": [(1440 * 4, "x"), (1440 * 5 + 60, "y")]}
    assert "4" in cases_of(split.unbiased(log_of(spark, overlapping), None, None, 2.0, 0.5)[1])
    with pytest.raises(ValueError):
        split.unbiased(log_of(spark, cases), None, None, 0.0001)
    with pytest.raises(ValueError):
        split.unbiased(log_of(spark, cases), "2024-01-05", None, 2.0)
    bounded = split.unbiased_cases(log_of(spark, DAYS), "2024-02", None, 1.0)
    assert min(cases_of(bounded)) == "31"


def test_split_arguments(spark):
    log = log_of(spark, DAYS)
    for wrong in ({"strategy": "other"}, {"max_days": 3.0}, {"test_size": 1.0}, {"strategy": "unbiased"}):
        with pytest.raises(ValueError):
            split.train_test_split(log, **wrong)
    one = log_of(spark, {"a": [(0, "x")]})
    with pytest.raises(ValueError):
        split.temporal(one)
    assert split.temporal(one, validate=False)[0].count() == 1
    folds = split.group_folds(log, 4).groupBy("case_id").agg(F.count_distinct("fold").alias("k"), F.max("fold").alias("m")).collect()
    assert all(r.k == 1 and 0 <= r.m < 4 for r in folds)


def test_kth_smallest(spark):
    rng = np.random.default_rng(5)
    values = [int(v) for v in rng.integers(-(10**15), 10**15, 300)] + [7] * 50 + [8, 8, 9]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (0, 1, 149, 160, 200, len(values) - 1):
        assert split.kth_smallest(df, "v", k, 8) == sorted(values)[k]


def test_no_split_gathers_cases(spark):
    """No plan of the unbiased split sorts the cases in one place."""
    log = log_of(spark, DAYS)
    plan = split.unbiased_cases(log, None, None, 1.0)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan


# baselines


def test_activity_means(spark):
    df = spark.createDataFrame([("a", 10.0), ("b", 20.0), ("c", 30.0), ("a", 12.0), ("b", 22.0), ("a", 14.0)], "activity string, y double")
    model = baseline.ActivityMeanRegressor().fit(df)
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("new",), (None,)], "activity string")
    assert {r.activity: r.prediction for r in model.predict(asked).collect()} == {"a": 12, "b": 21, "c": 30, "new": 18, None: 18}
    with pytest.raises(ValueError):
        baseline.ActivityMeanRegressor().predict(df)
    assert baseline.mean_absolute_error(baseline.mean_baseline(df, "y"), "y").first().mae == pytest.approx(6)
    top = baseline.majority_baseline(df, "activity")
    assert baseline.accuracy(top, "activity").first().accuracy == 0.5
    assert {r.actual: r.share for r in baseline.confusion(top, "activity").collect()} == {"a": 1, "b": 1, "c": 1}
    assert {r.activity: r.mae for r in baseline.error_by(baseline.mean_baseline(df, "y"), "activity", "y").collect()} == {"a": 6, "b": 3, "c": 12}


# roles


def plain_roles(profiles, names, threshold):
    n = len(names)
    padded = np.zeros((n + 1, profiles.shape[1] + 1))
    padded[1:, 1:] = profiles
    with np.errstate(all="ignore"):
        near = np.corrcoef(padded) > threshold
    label = list(range(n + 1))
    for _ in range(n):
        for i in range(n + 1):
            for j in range(n + 1):
                if i != j and near[i, j]:
                    label[i] = label[j] = min(label[i], label[j])
    order = sorted(set(label[1:]))
    return {names[i - 1]: order.index(label[i]) + 1 for i in range(1, n + 1)}


def test_roles_against_numpy(spark):
    rng = np.random.default_rng(3)
    names, acts = [f"r{i:02d}" for i in range(14)], [f"a{j}" for j in range(7)]
    profiles = rng.poisson(2.0, (14, 7)) * (rng.random((14, 7)) < 0.6)
    profiles[3] = profiles[2]
    profiles[profiles.sum(1) == 0, 0] = 1
    rows = [("c", BASE + dt.timedelta(seconds=1000 * i + k), acts[j], names[i]) for i in range(14) for j in range(7) for k in range(profiles[i, j])]
    used = profiles[:, profiles.sum(0) > 0]
    log = to_event_log(spark.createDataFrame(rows, "case_id string, timestamp timestamp, activity string, resource string"))
    for threshold in (0.3, 0.7, 0.95):
        extractor = roles.ResourcePoolExtractor(threshold).fit(log)
        assert {r.resource: r.resource_roles for r in extractor.roles_.collect()} == plain_roles(used, names, threshold)
        found = components(roles.linked_resources(roles.resource_profiles(log), threshold, block=3)).collect()
        together = {r.node: r.component for r in found}
        role = plain_roles(used, names, threshold)
        assert all((together.get(a, a) == together.get(b, b)) == (role[a] == role[b]) for a in names for b in names)
    new = to_event_log(spark.createDataFrame([("c", BASE, "a0", "nobody")], "case_id string, timestamp timestamp, activity string, resource string"))
    with pytest.warns(roles.ConceptDriftWarning):
        assert extractor.transform(new, warn=True).first().resource_roles == roles.UNKNOWN_ROLE
    with pytest.raises(ValueError):
        roles.ResourcePoolExtractor().fit(log.drop("resource"))
    with pytest.raises(ValueError):
        roles.ResourcePoolExtractor().fit(log.withColumn("resource", F.lit(None).cast("string")))
    with pytest.raises(ValueError):
        roles.ResourcePoolExtractor().transform(log)


def test_numbered_rows(spark):
    from eventloom.eventlog import numbered_rows

    rng = np.random.default_rng(6)
    rows = [(int(a), int(b)) for a, b in rng.integers(0, 40, (200, 2))]
    rows = list(dict.fromkeys(rows))
    got = numbered_rows(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"], "n", 7).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.n)] == sorted(rows) and sorted(r.n for r in got) == list(range(len(rows)))
    assert numbered_rows(spark.createDataFrame([], "a int, b int"), ["a"], "n", 3).count() == 0


def test_value_counts(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "x string")
    assert [(r.value, r.n) for r in baseline.value_counts(df, "x").collect()] == [("b", 2), (None, 1), ("a", 1), ("c", 1)]


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (1, 1)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

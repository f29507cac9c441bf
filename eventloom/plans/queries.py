"""One query for each operator, over the test tables taken as event logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom import eventlog, schema
from eventloom.functions import targets, time
from eventloom.operators import baseline, encoding, graph, intercase, roles, split, variants
from eventloom.plans.storage import shared_dir
from eventloom.sources import files, xes

ROLE_THRESHOLD = 0.95
#: An activity that unseen_activities leaves out of learning.
UNSEEN = "purchase"


def _r(c: Column | str) -> Column:
    """Six decimals. The nudge takes exact halves up, whatever an engine's rule for them is."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_user(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """events as a canonical log: a case is a user. Its event_id is unique, so that nothing has to be numbered."""
    cols = [F.col("user_id").alias("case_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id"), F.col("event_type").alias("activity"), *more]
    return _table(spark, sf_dir, "events").select(*cols)


def by_day(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """events as a canonical log: a case is a user's day."""
    cols = [(F.col("user_id") * 100 + F.dayofmonth("ts")).alias("case_id"), F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_id"), F.col("event_type").alias("activity"), *more]
    return _table(spark, sf_dir, "events").select(*cols)


def with_resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_user(spark, sf_dir, F.get_json_object("props", "$.k").alias("resource"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col("o_custkey").alias("case_id"), F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("activity")]
    return _table(spark, sf_dir, "orders").select(*cols)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [F.col("conv_id").alias("case_id"), F.timestamp_micros("turn").alias("timestamp"), F.col("turn").alias("event_id"), F.col("role").alias("activity")]
    return _table(spark, sf_dir, "conversations").select(*cols)


def canonical_event_log(spark, sf_dir):
    raw = _table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time:timestamp"), F.col("event_id").alias("source_id"), F.col("event_type").alias("concept:name"))
    log = eventlog.to_event_log(raw, column_mapping={"case_id": "user_id"}, order_by="source_id")
    return log.select("case_id", schema.micros("timestamp").alias("micros"), "event_id", "activity", "source_id")


def log_summary(spark, sf_dir):
    return eventlog.log_summary(by_user(spark, sf_dir))


def trace_position(spark, sf_dir):
    return eventlog.trace_positions(by_user(spark, sf_dir)).drop("timestamp")


def case_bounds(spark, sf_dir):
    return eventlog.case_bounds(orders(spark, sf_dir)).select("case_id", schema.micros("first").alias("first_micros"), schema.micros("last").alias("last_micros"), "n_events", _r("duration_days").alias("duration_days"))


def first_events(spark, sf_dir):
    positions = eventlog.trace_positions(by_user(spark, sf_dir))
    return positions.where("trace_position < 3").select("case_id", "event_id", "trace_position")


def remaining_time(spark, sf_dir):
    return targets.remaining_time(by_user(spark, sf_dir), "h").select("case_id", "event_id", _r("remaining_time").alias("remaining_time"))


def execution_time(spark, sf_dir):
    return targets.execution_time(by_user(spark, sf_dir), "m").select("case_id", "event_id", _r("execution_time").alias("execution_time"))


def next_activity(spark, sf_dir):
    return targets.next_activity(by_user(spark, sf_dir)).drop("timestamp")


def accumulated_time(spark, sf_dir):
    return time.time_features(by_user(spark, sf_dir), "accumulated_time", None).select("case_id", "event_id", _r("accumulated_time").alias("accumulated_time"))


def time_since_last_event(spark, sf_dir):
    return time.time_features(by_user(spark, sf_dir), "time_since_last_event", None).select("case_id", "event_id", _r("time_since_last_event").alias("time_since_last_event"))


def calendar_features(spark, sf_dir):
    made = time.time_features(by_user(spark, sf_dir), None, "all", "h")
    return made.select("case_id", "event_id", *(_r(n).alias(n) for n in time.CALENDAR.features))


def time_extractor(spark, sf_dir):
    made = time.time_features(orders(spark, sf_dir), "all", ["day_of_week", "hour_of_day"], "d")
    return made.select("case_id", "event_id", *(_r(n).alias(n) for n in ("accumulated_time", "time_since_last_event", "day_of_week", "hour_of_day")))


def _aggregation(method: str, length: int | None = None) -> Callable:
    def query(spark, sf_dir):
        log = by_user(spark, sf_dir, "value").drop("activity")
        made = encoding.Aggregation(method, length).fit_transform(log)
        return made.select("case_id", "event_id", _r("value").alias("value"))

    return query


def windowing_n3(spark, sf_dir):
    return encoding.Windowing(3).fit_transform(by_user(spark, sf_dir, "value").drop("activity")).drop("timestamp")


def windowing_activity_pad(spark, sf_dir):
    return encoding.Windowing(3, "<pad>").fit_transform(by_user(spark, sf_dir)).drop("timestamp")


def indexing(spark, sf_dir):
    """In long form, so that columns don't depend on the data: case, event, position and value."""
    encoder = encoding.Indexing("<pad>")
    made = encoder.fit_transform(by_day(spark, sf_dir))
    cells = F.array(*(F.struct(F.lit(j).cast("long").alias("position"), F.col(f"activity_pos_{j}").alias("value")) for j in encoder.positions()))
    return made.select("case_id", "event_id", F.explode(cells).alias("c")).select("case_id", "event_id", "c.position", "c.value")


def _bucketing(method: str) -> Callable:
    def query(spark, sf_dir):
        return encoding.Bucketing(method).fit_transform(by_user(spark, sf_dir)).drop("timestamp")

    return query


def onehot_relative_frequency(spark, sf_dir):
    log = by_user(spark, sf_dir)
    hot = encoding.OneHot("activity").fit_transform(log)
    made = encoding.Aggregation("mean").fit_transform(hot)
    names = [c for c in made.columns if c not in schema.KEYS]
    cells = F.array(*(F.struct(F.lit(n).alias("name"), _r(n).alias("share")) for n in names))
    return made.select("case_id", "event_id", F.explode(cells).alias("c")).select("case_id", "event_id", "c.name", "c.share")


def _wip(width: str) -> Callable:
    def query(spark, sf_dir):
        return intercase.work_in_progress(by_user(spark, sf_dir), width).drop("timestamp")

    return query


def _wip_orders(width: str) -> Callable:
    def query(spark, sf_dir):
        return intercase.work_in_progress(orders(spark, sf_dir), width).drop("timestamp")

    return query


def wip_month(spark, sf_dir):
    return intercase.work_in_progress(orders(spark, sf_dir), "ME").drop("timestamp")


def variants_(spark, sf_dir):
    return variants.VariantExtractor().fit_transform(by_day(spark, sf_dir))


def variant_counts(spark, sf_dir):
    return variants.variant_counts(by_day(spark, sf_dir)).select(F.array_join("trace", ">").alias("trace"), "n_cases")


def variant_decode(spark, sf_dir):
    log = by_day(spark, sf_dir)
    extractor = variants.VariantExtractor().fit(log)
    return extractor.inverse_transform(extractor.transform(log)).select("case_id", "variant", F.array_join("trace", ">").alias("trace"))


def dfg(spark, sf_dir):
    return graph.frequency(by_user(spark, sf_dir))


def dfg_conversations(spark, sf_dir):
    return graph.frequency(conversations(spark, sf_dir))


def dfg_of_traces(spark, sf_dir):
    return graph.frequency_of_traces(variants.traces(by_day(spark, sf_dir)))


def node_degree(spark, sf_dir):
    return graph.node_degree(graph.frequency(by_user(spark, sf_dir)))


def graph_density(spark, sf_dir):
    return graph.density(graph.frequency(conversations(spark, sf_dir))).select(_r("density").alias("density"))


def nodes_in_cycles(spark, sf_dir):
    return graph.nodes_in_cycles(graph.frequency(conversations(spark, sf_dir)), 3)


def temporal_split(spark, sf_dir):
    return split.temporal_flags(by_day(spark, sf_dir), 0.2).select("case_id", "event_id", "in_train")


def temporal_split_sides(spark, sf_dir):
    """Events and cases of both sides, through the public call."""
    return _sides(*split.train_test_split(by_day(spark, sf_dir), test_size=0.3))


def unbiased_split(spark, sf_dir):
    return split.unbiased_cases(by_day(spark, sf_dir), None, None, 1.0, 0.2)


def unbiased_bounded(spark, sf_dir):
    return split.unbiased_cases(by_day(spark, sf_dir), "2024-01", "2024-01", 0.5, 0.3)


def group_folds(spark, sf_dir):
    return split.group_folds(by_day(spark, sf_dir), 5).select("case_id", "event_id", "fold")


def _labelled(log: DataFrame) -> DataFrame:
    return log.withColumns({"y": time.remaining_time("h"), "trace_position": (F.row_number().over(schema.in_order()) - 1).cast("long")})


def activity_mean_baseline(spark, sf_dir):
    log = _labelled(by_day(spark, sf_dir))
    return baseline.ActivityMeanRegressor().fit(log).predict(log).select("case_id", "event_id", _r("prediction").alias("prediction"))


def baseline_mae_by_position(spark, sf_dir):
    """The flagship: split cases, learn on train, and score on test by position in the case."""
    train, test = split.train_test_split(by_day(spark, sf_dir), validate=False)
    scored = baseline.ActivityMeanRegressor().fit(_labelled(train)).predict(_labelled(test))
    out = baseline.error_by(scored, "trace_position", "y")
    return out.select("trace_position", _r("mae").alias("mae"), "n")


def mean_baseline_mae(spark, sf_dir):
    log = _labelled(by_day(spark, sf_dir))
    return baseline.mean_absolute_error(baseline.mean_baseline(log, "y"), "y").select(_r("mae").alias("mae"))


def _next(spark, sf_dir) -> DataFrame:
    return baseline.majority_baseline(targets.next_activity(by_user(spark, sf_dir)), "next_activity")


def most_frequent_baseline(spark, sf_dir):
    return baseline.accuracy(_next(spark, sf_dir), "next_activity").select(_r("accuracy").alias("accuracy"))


def confusion(spark, sf_dir):
    return baseline.confusion(_next(spark, sf_dir), "next_activity").select("actual", "predicted", "n", _r("share").alias("share"))


def cross_table(spark, sf_dir):
    return baseline.cross_table(with_resource(spark, sf_dir), "resource", "activity")


def resource_profiles(spark, sf_dir):
    return roles.resource_profiles(with_resource(spark, sf_dir))


def resource_correlation(spark, sf_dir):
    return roles.resource_correlation(roles.resource_profiles(with_resource(spark, sf_dir))).select("a", "b", _r("r").alias("r"))


def resource_roles(spark, sf_dir):
    log = with_resource(spark, sf_dir)
    return roles.ResourcePoolExtractor(ROLE_THRESHOLD).fit(log).transform(log).drop("timestamp")


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def xes_scan(spark, sf_dir):
    """events written as XES traces and read again."""
    raw = _table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("concept:name"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("time:timestamp"))
    xes.write_traces(raw, path := _scratch(spark, "xes"), "user_id", ["time:timestamp", "event_id"], ["event_id", "concept:name", "time:timestamp"])
    flat = xes.read_xes(spark, path)
    log = eventlog.to_event_log(flat.drop("file"), order_by="ordinal")
    return log.select(F.col("case_id").cast("long").alias("case_id"), schema.micros("timestamp").alias("micros"), "activity").drop("ordinal")


def csv_parts(spark, sf_dir):
    """Two files with different columns, a CSV and a Parquet one, as one log."""
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    one, two = _scratch(spark, "part") + ".csv", _scratch(spark, "part") + ".parquet"
    files.write_log(events.where("event_id % 2 = 0").drop("value"), one, "csv")
    files.write_log(events.where("event_id % 2 = 1"), two)
    both = files.read_log(spark, one, two)
    return both.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "event_type", "value")


def _traces_text(log: DataFrame, path: str, compression: str = "none") -> None:
    """A log as XES traces, one a line, whose events hold their id below their activity."""
    event = F.format_string('<event><string key="concept:name" value="%s"><int key="number" value="%d"/></string></event>', "activity", "event_id")
    grouped = log.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("timestamp", "event_id", event.alias("xml")))).alias("es"))
    body = F.array_join(F.transform("es", lambda e: e["xml"]), "")
    lines = grouped.select(F.concat(F.format_string('<trace><string key="concept:name" value="%d"/><x:note>', "case_id"), F.lit("</x:note>"), body, F.lit("</trace>")).alias("value"))
    lines.write.option("compression", compression).text(path)


def xes_nested_gz(spark, sf_dir):
    """Nested attributes, and elements of a namespace that is declared elsewhere, from gzipped files."""
    _traces_text(by_user(spark, sf_dir), path := _scratch(spark, "xes-nested"), "gzip")
    flat = xes.read_xes(spark, path)
    return flat.select(F.col("`case:concept:name`").cast("long").alias("case_id"), F.col("number").cast("long").alias("event_id"), F.col("`concept:name`").alias("activity"))


def xes_parts(spark, sf_dir):
    """Two XES parts as one log: events of each part and case."""
    log, folder = by_user(spark, sf_dir), _scratch(spark, "xes-parts")
    for i in (0, 1):
        _traces_text(log.where(F.col("case_id") % 2 == i), f"{folder}/part_{i}.xes")
    both = files.read_log(spark, f"{folder}/part_0.xes", f"{folder}/part_1.xes")
    return both.groupBy("log_version", F.col("`case:concept:name`").cast("long").alias("case_id")).agg(F.count(F.lit(1)).alias("n"))


def _sides(train: DataFrame, test: DataFrame) -> DataFrame:
    one, other = (df.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("case_id").alias("n_cases")).withColumn("side", F.lit(n)) for n, df in (("train", train), ("test", test)))
    return one.unionByName(other)


def unbiased_sides(spark, sf_dir):
    """Events and cases of both sides of the unbiased split, through the public call."""
    return _sides(*split.train_test_split(by_day(spark, sf_dir), strategy="unbiased", max_days=1.0, test_size=0.2))


def unseen_activities(spark, sf_dir):
    """Means learnt without one activity, whose events get the mean of all."""
    log = _labelled(by_day(spark, sf_dir))
    fitted = baseline.ActivityMeanRegressor().fit(log.where(f"activity != '{UNSEEN}'"))
    return fitted.predict(log).select("case_id", "event_id", _r("prediction").alias("prediction"))


def unseen_resources(spark, sf_dir):
    """Roles learnt from a part of the resources; the others have role 0."""
    log = with_resource(spark, sf_dir)
    fitted = roles.ResourcePoolExtractor(ROLE_THRESHOLD).fit(log.where("resource < '5'"))
    return fitted.transform(log).select("case_id", "event_id", (F.col("resource_roles") == roles.UNKNOWN_ROLE).alias("unseen"))


def activity_counts(spark, sf_dir):
    return baseline.value_counts(by_user(spark, sf_dir), "activity")


def top_variants(spark, sf_dir):
    """The ten most frequent variants, a report."""
    traces = variants.traces(by_day(spark, sf_dir)).select(F.array_join("trace", ">").alias("trace"))
    return baseline.value_counts(traces, "trace").limit(10)


def events_by_day(spark, sf_dir):
    return by_user(spark, sf_dir).groupBy(schema.micros(time.floor_day()).alias("day_micros")).agg(F.count(F.lit(1)).alias("n"))


def ordered_head(spark, sf_dir):
    """The first hundred events of the ordered log, a report."""
    return eventlog.ordered(by_user(spark, sf_dir)).limit(100).select("case_id", "event_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable] = {
        f.__name__: f
        for f in (
            canonical_event_log, log_summary, trace_position, case_bounds, first_events, remaining_time, execution_time, next_activity, accumulated_time, time_since_last_event,
            calendar_features, time_extractor, windowing_n3, windowing_activity_pad, indexing, onehot_relative_frequency, wip_month, variant_counts, variant_decode, dfg,
            dfg_conversations, dfg_of_traces, node_degree, graph_density, nodes_in_cycles, temporal_split, temporal_split_sides, unbiased_split, unbiased_bounded, group_folds, activity_mean_baseline,
            baseline_mae_by_position, mean_baseline_mae, most_frequent_baseline, confusion, cross_table, resource_profiles, resource_correlation, resource_roles, xes_scan, csv_parts,
            xes_nested_gz, xes_parts, unbiased_sides, unseen_activities, unseen_resources, activity_counts, top_variants, events_by_day, ordered_head,
        )
    }
    found |= {f"agg_{m}": _aggregation(m) for m in encoding.METHODS} | {"agg_mean_w3": _aggregation("mean", 3), "agg_median_w5": _aggregation("median", 5)}
    found |= {f"bucketing_{m}": _bucketing(m) for m in ("single", "prefix")}
    found |= {"wip_1d": _wip("1D"), "wip_12h": _wip("12h"), "wip_7h": _wip("7h"), "wip_2d": _wip("2D"), "wip_week": _wip("W"), "wip_2week": _wip("2W"), "wip_business_day": _wip("B"), "wip_quarter": _wip("QE")}
    found |= {"wip_2month_starts": _wip_orders("2MS"), "wip_2month_ends": _wip_orders("2ME"), "wip_3quarters": _wip_orders("3QE"), "wip_2years": _wip_orders("2YS"), "wip_2business_days": _wip("2B")}
    return found | {"variants": variants_}

"""The same queries in DuckDB's SQL."""

from __future__ import annotations

from eventloom.plans.queries import ROLE_THRESHOLD, UNSEEN

E = "e AS (SELECT user_id AS case_id, ts, event_id, event_type AS activity, value, json_extract_string(props, '$.k') AS resource FROM events)"
D = "e AS (SELECT user_id * 100 + day(ts) AS case_id, ts, event_id, event_type AS activity, value FROM events)"
O = "e AS (SELECT o_custkey AS case_id, o_orderdate AS ts, o_orderkey AS event_id, o_orderpriority AS activity FROM orders)"
C = "e AS (SELECT conv_id AS case_id, make_timestamp(turn) AS ts, turn AS event_id, role AS activity FROM conversations)"
W = "(PARTITION BY case_id ORDER BY ts, event_id)"
PREFIX = "(PARTITION BY case_id ORDER BY ts, event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
SECS = "(3600 * hour(ts) + 60 * minute(ts) + second(ts))"
GRAPH = "g AS (SELECT activity AS src, next AS dst, count(*) AS n FROM (SELECT activity, lead(activity) OVER " + W + " AS next, lead(1) OVER " + W + " AS more FROM e) WHERE more IS NOT NULL GROUP BY 1, 2)"
LABELS = "y AS (SELECT *, epoch_us(max(ts) OVER (PARTITION BY case_id)) / 3.6e9 - epoch_us(ts) / 3.6e9 AS y0, (epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)) / 1e6 / 3600 AS y, row_number() OVER " + W + " - 1 AS trace_position FROM e)"
FIRST = "(SELECT epoch_us(min(ts)) FROM e)"
DAY_US = "86400000000"


def _agg(expression: str, size: str = "UNBOUNDED") -> str:
    return f"WITH {E} SELECT case_id, event_id, round({expression.format('OVER ' + PREFIX.format(size))}, 6) AS value FROM e"


def _wip(bin_: str, log: str = E) -> str:
    return f"WITH {log}, b AS (SELECT *, {bin_} AS bin FROM e) SELECT case_id, event_id, count(DISTINCT case_id) OVER (PARTITION BY bin) AS wip FROM b"


def _fixed(width: int) -> str:
    return f"(epoch_us(ts) - {FIRST} // {DAY_US} * {DAY_US}) // {width}"


WEEK = f"((epoch_us(ts) // {DAY_US} + 3) // 7)"
FIRST_WEEK = f"(({FIRST} // {DAY_US} + 3) // 7)"
UNBIASED = """
    {log}, c AS (SELECT case_id, min(ts) AS f, max(ts) AS l FROM e GROUP BY 1),
    b AS (SELECT * FROM c WHERE {bounds}),
    k AS (SELECT * FROM b WHERE (epoch_us(l) - epoch_us(f)) / 86400e6 <= {days} * 1.00000000001 AND epoch_us(f) <= (SELECT epoch_us(max(l)) FROM b) - ({days}::DOUBLE * 86400000000)::BIGINT),
    t AS (SELECT f AS t0 FROM k ORDER BY f OFFSET (SELECT floor(count(*) * (1 - {test}::DOUBLE))::BIGINT FROM k) LIMIT 1)
    SELECT case_id, l < (SELECT t0 FROM t) AS in_train FROM k
"""
TRACES = "t AS (SELECT case_id, string_agg(activity, '>' ORDER BY ts, event_id) AS trace FROM e GROUP BY 1)"
CODES = "v AS (SELECT trace, row_number() OVER (ORDER BY m) - 1 AS variant FROM (SELECT trace, min(case_id) AS m FROM t GROUP BY 1))"
PROFILES = "p AS (SELECT resource, activity, count(*) AS n FROM e GROUP BY 1, 2)"
CORRELATION = """
    s AS (SELECT resource, sum(n)::BIGINT AS s, sum(n * n)::BIGINT AS q FROM p GROUP BY 1), z AS (SELECT count(DISTINCT activity) + 1 AS z FROM p),
    x AS (SELECT a.resource AS a, b.resource AS b, sum(a.n * b.n)::BIGINT AS p FROM p a JOIN p b ON a.activity = b.activity AND a.resource < b.resource GROUP BY 1, 2),
    r AS (SELECT a, b, CASE WHEN (z * sa.q - sa.s * sa.s)::DOUBLE * (z * sb.q - sb.s * sb.s)::DOUBLE > 0
      THEN (z * p - sa.s * sb.s) / sqrt((z * sa.q - sa.s * sa.s)::DOUBLE * (z * sb.q - sb.s * sb.s)::DOUBLE) END AS r
      FROM x JOIN s sa ON sa.resource = a JOIN s sb ON sb.resource = b CROSS JOIN z)
"""
MAJORITY = "m AS (SELECT next_activity AS predicted FROM a GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
NEXT = "a AS (SELECT case_id, event_id, CASE WHEN lead(1) OVER " + W + " IS NULL THEN '<EOT>' ELSE lead(activity) OVER " + W + " END AS next_activity FROM e)"
CUT = "(SELECT epoch_us(min(ts)) + floor((epoch_us(max(ts)) - epoch_us(min(ts))) * (1 - {}::DOUBLE))::BIGINT FROM e)"


#: CRC-32 byte by byte, with its table in t.
CRC_TABLE = """t AS (SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"""
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(c >> 8, list_extract(crcs, xor(c & 255, b) + 1))))"""


def oracle_sql() -> dict[str, str]:
    # exact halves go up, as in the queries
    return {name: sql.replace(", 6)", " + 1e-9::DOUBLE, 6)") for name, sql in _sql().items()}


def _sql() -> dict[str, str]:
    flags = f"SELECT *, min(epoch_us(ts)) OVER (PARTITION BY case_id) <= {CUT} AS in_train FROM e"
    return {
        "canonical_event_log": f"WITH {E} SELECT case_id, epoch_us(ts) AS micros, row_number() OVER (ORDER BY case_id, ts, event_id) - 1 AS event_id, activity, event_id AS source_id FROM e",
        "log_summary": f"WITH {E} SELECT count(DISTINCT case_id) AS n_cases, count(*) AS n_events, count(DISTINCT activity) AS n_activities FROM e",
        "trace_position": f"WITH {E} SELECT case_id, event_id, row_number() OVER {W} - 1 AS trace_position FROM e",
        "case_bounds": f"WITH {O} SELECT case_id, epoch_us(min(ts)) AS first_micros, epoch_us(max(ts)) AS last_micros, count(*) AS n_events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400e6, 6) AS duration_days FROM e GROUP BY 1",
        "first_events": f"WITH {E} SELECT case_id, event_id, row_number() OVER {W} - 1 AS trace_position FROM e QUALIFY row_number() OVER {W} <= 3",
        "remaining_time": f"WITH {E} SELECT case_id, event_id, round((epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)) / 1e6 / 3600, 6) AS remaining_time FROM e",
        "execution_time": f"WITH {E} SELECT case_id, event_id, round(coalesce(abs(epoch_us(lead(ts) OVER {W}) - epoch_us(ts)) / 1e6, 0) / 60, 6) AS execution_time FROM e",
        "next_activity": f"WITH {E}, {NEXT} SELECT * FROM a",
        "accumulated_time": f"WITH {E} SELECT case_id, event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY case_id))) / 1e6, 6) AS accumulated_time FROM e",
        "time_since_last_event": f"WITH {E} SELECT case_id, event_id, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 1e6, 0), 6) AS time_since_last_event FROM e",
        "calendar_features": f"""WITH {E} SELECT case_id, event_id, round(second(ts) / 59.0::DOUBLE - 0.5, 6) AS sec_of_min, round(minute(ts) / 59.0::DOUBLE - 0.5, 6) AS min_of_hour, round(hour(ts) / 23.0::DOUBLE - 0.5, 6) AS hour_of_day,
            round((isodow(ts) - 1) / 6.0::DOUBLE - 0.5, 6) AS day_of_week, round((day(ts) - 1) / 30.0::DOUBLE - 0.5, 6) AS day_of_month, round((dayofyear(ts) - 1) / 365.0::DOUBLE - 0.5, 6) AS day_of_year,
            round((week(ts) - 1) / 52.0::DOUBLE - 0.5, 6) AS week_of_year, round((month(ts) - 1) / 11.0::DOUBLE - 0.5, 6) AS month_of_year, round({SECS} / 86400.0::DOUBLE - 0.5, 6) AS secs_within_day,
            round((isodow(ts) % 7 * 86400 + {SECS}) / 604800.0::DOUBLE - 0.5, 6) AS secs_since_sunday, round(epoch_us(ts) // 1000000 / 3600.0::DOUBLE, 6) AS numerical_timestamp FROM e""",
        "time_extractor": f"""WITH {O} SELECT case_id, event_id, round((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY case_id))) / 1e6 / 86400, 6) AS accumulated_time,
            round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER {W})) / 1e6, 0) / 86400, 6) AS time_since_last_event, round((isodow(ts) - 1) / 6.0::DOUBLE - 0.5, 6) AS day_of_week, round(hour(ts) / 23.0::DOUBLE - 0.5, 6) AS hour_of_day FROM e""",
        "agg_mean": _agg("avg(value) {}"),
        "agg_sum": _agg("sum(value) {}"),
        "agg_median": _agg("quantile_cont(value, 0.5) {}"),
        "agg_norm": _agg("sqrt(sum(value * value) {})"),
        "agg_mean_w3": _agg("avg(value) {}", "2"),
        "agg_median_w5": _agg("quantile_cont(value, 0.5) {}", "4"),
        "windowing_n3": f"WITH {E} SELECT case_id, event_id, value AS value_w_0, lag(value, 1, 0) OVER {W} AS value_w_1, lag(value, 2, 0) OVER {W} AS value_w_2 FROM e",
        "windowing_activity_pad": f"WITH {E} SELECT case_id, event_id, activity AS activity_w_0, lag(activity, 1, '<pad>') OVER {W} AS activity_w_1, lag(activity, 2, '<pad>') OVER {W} AS activity_w_2 FROM e",
        "indexing": f"""WITH {D}, p AS (SELECT *, row_number() OVER {W} - 1 AS pos FROM e), j AS (SELECT unnest(range((SELECT max(pos) + 1 FROM p))) AS position)
            SELECT p.case_id, p.event_id, j.position, CASE WHEN p.pos >= j.position THEN q.activity ELSE '<pad>' END AS value FROM p CROSS JOIN j LEFT JOIN p q ON q.case_id = p.case_id AND q.pos = j.position""",
        "bucketing_single": f"WITH {E} SELECT case_id, event_id, 'b1' AS bucket FROM e",
        "bucketing_prefix": f"WITH {E} SELECT case_id, event_id, 'b' || row_number() OVER {W} AS bucket FROM e",
        "onehot_relative_frequency": f"""WITH {E}, v AS (SELECT DISTINCT activity AS v FROM e)
            SELECT case_id, event_id, 'activity_' || v AS name, round(avg(CASE WHEN activity = v THEN 1.0::DOUBLE ELSE 0 END) OVER (PARTITION BY case_id, v ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS share FROM e CROSS JOIN v""",
        "wip_1d": _wip(_fixed(86400000000)),
        "wip_12h": _wip(_fixed(43200000000)),
        "wip_7h": _wip(_fixed(25200000000)),
        "wip_2d": _wip(_fixed(172800000000)),
        "wip_week": _wip("date_trunc('week', ts)"),
        "wip_2week": _wip(f"({WEEK} - {FIRST_WEEK} + 1) // 2"),
        "wip_business_day": _wip(f"epoch_us(ts) // {DAY_US} - greatest(isodow(ts) - 5, 0)"),
        "wip_quarter": _wip("date_trunc('quarter', ts)"),
        "wip_2month_starts": _wip("((year(ts) * 12 + month(ts)) - (SELECT min(year(ts) * 12 + month(ts)) FROM e)) // 2", O),
        "wip_2month_ends": _wip("((year(ts) * 12 + month(ts)) - (SELECT min(year(ts) * 12 + month(ts)) FROM e) + 1) // 2", O),
        "wip_3quarters": _wip("((year(ts) * 4 + quarter(ts)) - (SELECT min(year(ts) * 4 + quarter(ts)) FROM e) + 2) // 3", O),
        "wip_2years": _wip("(year(ts) - (SELECT min(year(ts)) FROM e)) // 2", O),
        "wip_2business_days": _wip("(epoch_us(date_trunc('week', ts)) // 604800000000 * 5 + least(isodow(ts), 5) - (SELECT min(epoch_us(date_trunc('week', ts)) // 604800000000 * 5 + least(isodow(ts), 5)) FROM e)) // 2"),
        "wip_month": _wip("date_trunc('month', ts)", O),
        "variants": f"WITH {D}, {TRACES}, {CODES} SELECT case_id, variant FROM t JOIN v USING (trace)",
        "variant_counts": f"WITH {D}, {TRACES} SELECT trace, count(*) AS n_cases FROM t GROUP BY 1",
        "variant_decode": f"WITH {D}, {TRACES}, {CODES} SELECT case_id, variant, trace FROM t JOIN v USING (trace)",
        "dfg": f"WITH {E}, {GRAPH} SELECT * FROM g",
        "dfg_conversations": f"WITH {C}, {GRAPH} SELECT * FROM g",
        "dfg_of_traces": f"WITH {D}, {GRAPH} SELECT * FROM g",
        "node_degree": f"""WITH {E}, {GRAPH}, s AS (SELECT dst AS node, n AS i, 0 AS o FROM g UNION ALL SELECT src, 0, n FROM g)
            SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM s GROUP BY 1""",
        "graph_density": f"""WITH {C}, {GRAPH}, k AS (SELECT count(*) AS k FROM (SELECT src FROM g UNION SELECT dst FROM g)) SELECT round((SELECT sum(n) FROM g) / (k * (k - 1)), 6) AS density FROM k""",
        "nodes_in_cycles": f"""WITH RECURSIVE {C}, {GRAPH}, w AS (SELECT src AS origin, dst AS at_, 1 AS steps FROM g UNION SELECT origin, dst, steps + 1 FROM w JOIN g ON at_ = src WHERE steps < 3)
            SELECT node, EXISTS (SELECT 1 FROM w WHERE origin = node AND at_ = node AND steps >= 2) AS in_cycle FROM (SELECT src AS node FROM g UNION SELECT dst FROM g)""",
        "temporal_split": f"WITH {D} SELECT case_id, event_id, in_train FROM ({flags.format(0.2)})",
        "temporal_split_sides": f"WITH {D} SELECT CASE WHEN in_train THEN 'train' ELSE 'test' END AS side, count(*) AS n_events, count(DISTINCT case_id) AS n_cases FROM ({flags.format(0.3)}) GROUP BY 1",
        "unbiased_split": "WITH " + UNBIASED.format(log=D, bounds="true", days="1.0", test="0.2"),
        "unbiased_bounded": "WITH " + UNBIASED.format(log=D, bounds="strftime(f, '%Y-%m') >= '2024-01' AND strftime(l, '%Y-%m') <= '2024-01'", days="0.5", test="0.3"),
        "group_folds": f"WITH {D}, {CRC_TABLE} SELECT case_id, event_id, ({CRC.format('case_id::VARCHAR')} % 5)::INT AS fold FROM e CROSS JOIN t",
        "unbiased_sides": f"""WITH c AS (WITH {UNBIASED.format(log=D, bounds="true", days="1.0", test="0.2")}), {D}
            SELECT CASE WHEN in_train THEN 'train' ELSE 'test' END AS side, count(*) AS n_events, count(DISTINCT case_id) AS n_cases FROM e JOIN c USING (case_id) GROUP BY 1""",
        "unseen_activities": f"""WITH {D}, {LABELS}, m AS (SELECT activity, avg(y) AS mean FROM y WHERE activity != '{UNSEEN}' GROUP BY 1)
            SELECT case_id, event_id, round(coalesce(mean, (SELECT avg(y) FROM y WHERE activity != '{UNSEEN}')), 6) AS prediction FROM y LEFT JOIN m USING (activity)""",
        "unseen_resources": f"WITH {E} SELECT case_id, event_id, resource >= '5' AS unseen FROM e",
        "activity_counts": f"WITH {E} SELECT activity AS value, count(*) AS n FROM e GROUP BY 1",
        "top_variants": f"WITH {D}, {TRACES} SELECT trace AS value, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
        "events_by_day": f"WITH {E} SELECT epoch_us(date_trunc('day', ts)) AS day_micros, count(*) AS n FROM e GROUP BY 1",
        "ordered_head": f"WITH {E} SELECT case_id, event_id FROM e ORDER BY case_id, ts, event_id LIMIT 100",
        "xes_nested_gz": f"WITH {E} SELECT case_id, event_id, activity FROM e",
        "xes_parts": f"WITH {E} SELECT 'part_' || case_id % 2 AS log_version, case_id, count(*) AS n FROM e GROUP BY 1, 2",
        "activity_mean_baseline": f"WITH {D}, {LABELS} SELECT case_id, event_id, round(avg(y) OVER (PARTITION BY activity), 6) AS prediction FROM y",
        "baseline_mae_by_position": f"""WITH {D}, {LABELS}, f AS (SELECT *, min(epoch_us(ts)) OVER (PARTITION BY case_id) <= {CUT.format(0.2)} AS in_train FROM y),
            m AS (SELECT activity, avg(y) AS mean FROM f WHERE in_train GROUP BY 1)
            SELECT trace_position, round(avg(abs(y - coalesce(mean, (SELECT avg(y) FROM f WHERE in_train)))), 6) AS mae, count(*) AS n FROM f LEFT JOIN m USING (activity) WHERE NOT in_train GROUP BY 1""",
        "mean_baseline_mae": f"WITH {D}, {LABELS} SELECT round(avg(abs(y - (SELECT avg(y) FROM y))), 6) AS mae FROM y",
        "most_frequent_baseline": f"WITH {E}, {NEXT}, {MAJORITY} SELECT round(avg((next_activity = predicted)::INT), 6) AS accuracy FROM a CROSS JOIN m",
        "confusion": f"WITH {E}, {NEXT}, {MAJORITY} SELECT next_activity AS actual, predicted, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY next_activity), 6) AS share FROM a CROSS JOIN m GROUP BY 1, 2",
        "cross_table": f'WITH {E} SELECT resource AS "row", activity AS "column", count(*) AS n FROM e GROUP BY 1, 2',
        "resource_profiles": f"WITH {E}, {PROFILES} SELECT * FROM p",
        "resource_correlation": f"WITH {E}, {PROFILES}, {CORRELATION} SELECT a, b, round(r, 6) AS r FROM r",
        "resource_roles": f"""WITH RECURSIVE {E}, {PROFILES}, {CORRELATION}, l AS (SELECT a, b FROM r WHERE r > {ROLE_THRESHOLD} UNION ALL SELECT b, a FROM r WHERE r > {ROLE_THRESHOLD}),
            w AS (SELECT resource AS a, resource AS b FROM s UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
            o AS (SELECT *, row_number() OVER (ORDER BY case_id, ts, event_id) AS place FROM e), f AS (SELECT resource, min(place) AS place FROM o GROUP BY 1),
            c AS (SELECT w.a AS resource, min(f.place) AS place FROM w JOIN f ON f.resource = w.b GROUP BY 1), n AS (SELECT resource, dense_rank() OVER (ORDER BY place) AS resource_roles FROM c)
            SELECT case_id, event_id, resource_roles FROM e JOIN n USING (resource)""",
        "xes_scan": f"WITH {E} SELECT case_id, epoch_us(ts) AS micros, activity FROM e",
        "csv_parts": "SELECT event_id, user_id, event_type, CASE WHEN event_id % 2 = 1 THEN value END AS value FROM events",
    }

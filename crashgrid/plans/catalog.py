"""Registered queries: one per operator, each over the shared test tables.

Every callable takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
work grows with the input tables. Where an operator is a sink or source
(CSV, Parquet, text, JSON), the query writes Spark-derived data under the
shared checkpoint folder and reads it back through the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import activity as G
from ..operators import aggregates as A
from ..operators import bloom as B
from ..operators import cleaning as C
from ..operators import derive as P
from ..operators import filters as FL
from ..operators import multiset as M
from ..operators import rolling as R
from ..operators import sampling as K
from ..operators import sketches as SK
from ..operators import subtotals as S
from ..operators import temporal as TJ
from ..operators import timeseries as T
from ..operators.reconcile import reconcile_paths
from ..plans.prepare import child_session, prepare_dataset, prepare_frame
from ..schema import HEATMAP_CLASSES, MAP_ROW_CAP, POINT_DRAW_ORDER, REQUIRED_COLUMNS, SEVERITY_CLASSES, SEVERITY_OTHER
from ..session import materialize, scratch_path
from ..sources import activity as SA
from ..sources.csv import load_dataset, validate_required_columns
from ..sources.export import export_results, export_summary
from ..sources.fixtures import fixture, raw_incidents, table
from ..sources.parquet import get_prepared_data, write_prepared
from ..streaming import sessions as SS
from ..streaming import windows as SW

ID = "EVENT_UNIQUE_ID"


def raw(spark, d):
    return raw_incidents(spark, d)


def cleaned(spark, d):
    return C.clean(raw(spark, d))


def prepared(spark, d):
    return prepare_frame(raw(spark, d))


def points(spark, d):
    return P.map_points(prepared(spark, d))


def _positioned(df):
    """Adds the place (from 1) of each row in the order the operator returned; for small sorted results."""
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn("position", F.row_number().over(Window.orderBy("_at"))).drop("_at")


def _midnight(df, *columns):
    """Dates as midnight timestamps, like the other day columns of the results."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _aliases(spark, d):
    return fixture(spark, d, "aliases")


def _commits(spark, d):
    return fixture(spark, d, "commits")


def _numstat(spark, d):
    return fixture(spark, d, "numstat")


def _prs(spark, d):
    return fixture(spark, d, "prs")


# --- sources and sinks ----------------------------------------------------------

def _raw_csv(spark, d):
    return export_results(raw(spark, d), scratch_path(spark, "raw-csv"))


def q_scan_csv(spark, d):
    return load_dataset(spark, _raw_csv(spark, d))


def q_prepare_dataset(spark, d):
    """P7 end to end: raw CSV in, prepared Parquet out, read back."""
    return spark.read.parquet(prepare_dataset(spark, _raw_csv(spark, d), scratch_path(spark, "prepared")))


def q_quality_report_csv(spark, d):
    """C8 on rows as read from CSV (missing-value tokens already null)."""
    return C.quality_report(load_dataset(spark, _raw_csv(spark, d)))


def q_schema_contract(spark, d):
    df = raw(spark, d)
    validate_required_columns(df)
    return df.select(*REQUIRED_COLUMNS)


def q_write_prepared(spark, d):
    path = write_prepared(prepared(spark, d), scratch_path(spark, "prepared"))
    return spark.read.parquet(path)


def q_scan_prepared(spark, d):
    path = write_prepared(prepared(spark, d), scratch_path(spark, "prepared"))
    return get_prepared_data(spark, path)


def q_export_csv(spark, d):
    path = export_results(A.collisions_by_hour(prepared(spark, d)), scratch_path(spark, "by-hour-csv"),
                          single_file=True)
    return spark.read.schema("OCC_HOUR double, collision_count bigint").option("header", True).csv(path)


def q_export_summary(spark, d):
    summary = G.contribution_summary(_numstat(spark, d), _prs(spark, d), _aliases(spark, d))
    path = export_summary(summary, scratch_path(spark, "summary-csv"))
    schema = ("member_id bigint, member string, commits bigint, files_changed bigint, insertions bigint, "
              "deletions bigint, prs bigint, status string, github string")
    return spark.read.schema(schema).option("header", True).csv(path)


def q_scan_activity_log(spark, d):
    c = _commits(spark, d)
    lines = c.select(F.concat(F.col("author"), F.lit("|"), F.col("day").cast("string"), F.lit("|"),
                              F.col("subject")).alias("value"))
    path = scratch_path(spark, "commit-log")
    lines.write.mode("overwrite").text(path)
    return SA.scan_activity_log(spark, path)


def _pr_struct():
    return F.struct("number", "title", "state", F.struct(F.col("login").alias("login")).alias("author"))


def q_scan_pr_json(spark, d):
    js = _prs(spark, d).select(F.to_json(_pr_struct()).alias("value"))
    path = scratch_path(spark, "prs-json")
    js.write.mode("overwrite").text(path)
    return SA.scan_pr_json(spark, path).withColumn("number", F.col("number").cast("double"))


PRS_PER_DOCUMENT = 500


def q_scan_pr_json_array(spark, d):
    """PR lists as JSON array documents (at most 500 PRs each), many documents per file."""
    number = F.coalesce(F.col("number"), F.crc32("login"))   # listings of authors only have no number
    page = F.floor(number / F.lit(PRS_PER_DOCUMENT))
    arrays = (_prs(spark, d).groupBy(page.alias("page"))
              .agg(F.to_json(F.collect_list(_pr_struct())).alias("value")))
    path = scratch_path(spark, "prs-json-array")
    arrays.select("value").write.mode("overwrite").text(path)
    return SA.scan_pr_json(spark, path, json_array=True, multiline=False) \
        .withColumn("number", F.col("number").cast("double"))


# --- cleaning ---------------------------------------------------------------------

def q_coerce_timestamp(spark, d):
    return C.coerce_timestamp(raw(spark, d)).select(ID, "OCC_DATE")


def q_coerce_numeric(spark, d):
    return C.coerce_numeric(raw(spark, d)).select(ID, "OCC_YEAR", "OCC_HOUR", "LAT_WGS84", "LONG_WGS84")


def q_null_placeholders(spark, d):
    return C.null_placeholders(raw(spark, d)).select(ID, "NEIGHBOURHOOD_158")


def q_quality_flags(spark, d):
    df = raw(spark, d).transform(C.coerce_numeric).transform(C.null_placeholders).transform(C.quality_flags)
    return df.select(ID, "HAS_VALID_COORDINATES", "HAS_VALID_NEIGHBOURHOOD")


def q_drop_invalid_coords(spark, d):
    df = raw(spark, d).transform(C.coerce_numeric).transform(C.quality_flags).transform(C.drop_invalid_coords)
    return df.select(ID, "LAT_WGS84", "LONG_WGS84")


# --- derivations --------------------------------------------------------------------

def _derived(cols):
    def run(spark, d):
        return prepared(spark, d).select(ID, *cols)
    return run


def q_normalize_flags(spark, d):
    return P.normalize_flags(cleaned(spark, d)).select(
        ID, "INJURY_COLLISIONS", "PD_COLLISIONS", "PEDESTRIAN", "BICYCLE", "MOTORCYCLE")


def q_classify_severity(spark, d):
    return P.classify_severity(cleaned(spark, d)).select(ID, "severity_class")


def q_calendar_parts(spark, d):
    return P.calendar_parts(cleaned(spark, d)).select(ID, "OCC_DATE_STR", "YEAR", "MONTH", "DAY")


def q_fatality_flag(spark, d):
    return P.fatality_flag(cleaned(spark, d)).select(ID, "HAS_FATALITY")


def q_grid_cell(spark, d):
    return P.grid_cell(cleaned(spark, d)).select(ID, "lat_cluster", "lon_cluster")


def q_trim_dims(spark, d):
    return P.trim_dims(cleaned(spark, d)).select(ID, "DIVISION", "NEIGHBOURHOOD_158")


def q_rename_for_display(spark, d):
    return _positioned(P.rename_for_display(A.collisions_by_hour(prepared(spark, d)), "hourly"))


def q_rename_weekday(spark, d):
    return _positioned(P.rename_for_display(A.collisions_by_day_of_week(prepared(spark, d)), "weekday"))


def q_rename_month(spark, d):
    return P.rename_for_display(A.collisions_by_month(prepared(spark, d)).drop("month"), "month")


# --- filters -------------------------------------------------------------------------

def q_filter_dims(spark, d):
    return FL.filter_collisions(cleaned(spark, d), years=[1996, 1997], hours=[8, 17],
                                divisions=["D11", "D12", "D20"]).select(ID, "OCC_YEAR", "OCC_HOUR", "DIVISION")


def q_filter_prepared(spark, d):
    return FL.filter_collisions_prepared(prepared(spark, d), years=[1998], divisions=["D11", "D15", "D22"]) \
        .select(ID, "YEAR", "DIVISION", "NEIGHBOURHOOD_158")


def q_filter_neighbourhood(spark, d):
    return FL.filter_by_neighbourhood(prepared(spark, d), "BUILDING (7)", column="NEIGHBOURHOOD_158") \
        .select(ID, "NEIGHBOURHOOD_158")


def q_filter_severity(spark, d):
    return FL.apply_collision_severity_filter(prepared(spark, d), "Injury").select(ID, "severity_class")


def q_filter_recent_days(spark, d):
    return FL.apply_recent_days_filter(prepared(spark, d), 90).select(ID, "OCC_DATE_STR")


def q_filter_road_user(spark, d):
    return FL.apply_road_user_filter(prepared(spark, d), pedestrian=True, bicycle=True) \
        .select(ID, "PEDESTRIAN", "BICYCLE")


CHAIN_PARAMS = FL.DashboardParams(years=(1997, 1998), severity="Property Damage", motorcycle=True,
                                  recent_days=180)


def q_filter_chain(spark, d):
    return FL.filter_chain(prepared(spark, d), CHAIN_PARAMS) \
        .select(ID, "YEAR", "severity_class", "MOTORCYCLE", "OCC_DATE_STR")


def q_filter_classes(spark, d):
    return FL.filter_classes(prepared(spark, d), POINT_DRAW_ORDER).select(ID, "severity_class", "draw_order")


def q_heatmap_classes(spark, d):
    return FL.filter_classes(prepared(spark, d), HEATMAP_CLASSES).select(ID, "severity_class", "draw_order")


def q_drop_missing_keys(spark, d):
    return FL.drop_missing_keys(prepared(spark, d), ["NEIGHBOURHOOD_158", "DIVISION"]).select(ID)


# --- aggregations --------------------------------------------------------------------

def q_map_viewport(spark, d):
    v = A.map_viewport(points(spark, d))
    return v.withColumns({"center_lat": F.round("center_lat", 9), "center_lon": F.round("center_lon", 9)})


def q_top_n(spark, d):
    return K.top_n(prepared(spark, d), "NEIGHBOURHOOD_158", 15)


def q_multi_key_sort(spark, d):
    counts = A.top_counts(prepared(spark, d), "DIVISION", None)
    return _positioned(K.multi_key_sort(counts, [("collision_count", "desc"), ("DIVISION", "asc")]))


def q_categorical_sort(spark, d):
    counts = A.top_counts(prepared(spark, d), "severity_class", None)
    return _positioned(K.categorical_sort(counts, "severity_class", SEVERITY_CLASSES + [SEVERITY_OTHER]))


def q_preview(spark, d):
    return K.preview(prepared(spark, d).select(ID, "OCC_DATE_STR", "severity_class", "OCC_DATE"), 10,
                     order_by=[F.col("OCC_DATE").desc_nulls_last(), F.col(ID).asc()]).drop("OCC_DATE")


def q_concat_rows(spark, d):
    p = prepared(spark, d).select(ID, "severity_class")
    return K.concat_rows(FL.apply_collision_severity_filter(p, "Fatal"),
                         FL.apply_collision_severity_filter(p, "Injury"))


def q_trend_overlay(spark, d):
    # four series are counted from it: the incidents are prepared once
    p = materialize(prepared(spark, d).select("OCC_DATE", "severity_class"), "overlay-incidents")
    total = A.total_collisions_trend_over_time(p)
    forecast = T.forecast_collision_trend(total, horizon_days=30)
    return T.trend_overlay(A.severity_trend_over_time(p), total, forecast) \
        .withColumn("value", F.round("value", 6))


def q_densify_daily(spark, d):
    return T.densify_daily(A.total_collisions_trend_over_time(prepared(spark, d)))


def q_densify_daily_by_severity(spark, d):
    trend = A.severity_trend_over_time(prepared(spark, d))
    return T.densify_daily(trend, keys=["severity_type"])


def q_forecast_trend(spark, d):
    return T.forecast_collision_trend(A.total_collisions_trend_over_time(prepared(spark, d)), horizon_days=30) \
        .withColumn("value", F.round("value", 6))


def q_forecast_guard(spark, d):
    return T.forecast_guard(A.severity_trend_over_time(prepared(spark, d)), horizon_days=30,
                            keys=["severity_type"])


def q_reconcile_paths(spark, d):
    r = raw(spark, d)
    return reconcile_paths(C.clean(r), prepare_frame(r))


# --- frames, time and space joins ------------------------------------------------------

def q_rolling_means(spark, d):
    rolled = R.rolling_means(A.severity_trend_over_time(prepared(spark, d)), ["severity_type"], stripe_days=60)
    return rolled.withColumns({c: F.round(c, 9) for c in ("mean_7", "mean_28")})


def q_same_day_last_year(spark, d):
    yearly = R.same_day_last_year(A.severity_trend_over_time(prepared(spark, d)), ["severity_type"])
    return yearly.withColumn("last_year", F.col("last_year").cast("double"))


def q_rank_in_month(spark, d):
    return _midnight(R.rank_in_month(A.severity_trend_over_time(prepared(spark, d)), ["severity_type"]), "month")


def q_as_of_commits(spark, d):
    """Every fix with its author's last feature commit."""
    commits = fixture(spark, d, "commit_times")
    fixes = commits.filter("event_type = 'error'").select("author", "commit_id", "committed_at")
    features = commits.filter("event_type = 'click'").select(
        "author", F.col("committed_at").alias("feature_at"), F.col("commit_id").alias("feature_id"))
    return TJ.as_of_join(fixes, features, ["author"], "committed_at", "feature_at", ["feature_id"]).withColumn(
        "feature_id", F.col("feature_id").cast("double"))


def q_interval_join(spark, d):
    """Incidents dated inside the road works of their division."""
    incidents = prepared(spark, d).select(ID, "DIVISION", F.col("OCC_DATE").cast("date").alias("day"))
    works = fixture(spark, d, "works")
    held = TJ.interval_join(incidents, works, "day", "start_day", "end_day", ["DIVISION"])
    return _midnight(held.select(ID, "day", "work_id"), "day")


def q_interval_counts(spark, d):
    counts = TJ.interval_counts(prepared(spark, d), fixture(spark, d, "works"), "OCC_DATE", "work_id", "start_day",
                                "end_day", ["DIVISION"])
    return _midnight(counts, "first_day", "last_day")


def q_radius_counts(spark, d):
    near = TJ.radius_counts(points(spark, d), fixture(spark, d, "sites"), 400.0, "site_id", cell_rows=50)
    return near.withColumn("nearest_m", F.round("nearest_m", 3))


def _urgent_ids(spark, d):
    """Incidents of urgent orders placed by every fifth customer."""
    orders = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' and o_custkey % 5 = 0")
    return orders.select(F.concat(F.lit("EV-"), F.col("o_orderkey").cast("string")).alias(ID))


def q_bloom_semi_join(spark, d):
    return B.bloom_semi_join(prepared(spark, d).select(ID, "DIVISION", "severity_class"), _urgent_ids(spark, d), ID)


def q_bloom_anti_join(spark, d):
    return B.bloom_anti_join(prepared(spark, d).select(ID, "DIVISION", "severity_class"), _urgent_ids(spark, d), ID)


# --- subtotals, sketches, multisets ---------------------------------------------------

CUBE_DIMS = ["YEAR", "DIVISION", "severity_class"]


def q_multiset_compare(spark, d):
    r = raw(spark, d)
    columns = [ID, "OCC_HOUR", "DIVISION", "INJURY_COLLISIONS", "PEDESTRIAN"]
    return M.multiset_compare(C.clean(r), prepare_frame(r), columns)


def q_multiset_intersect(spark, d):
    r = raw(spark, d)
    return M.multiset_intersect(C.clean(r), prepare_frame(r), ["OCC_HOUR", "DIVISION", "PEDESTRIAN"])


def q_sketch_weeks(spark, d):
    return _midnight(SK.sketch_report(fixture(spark, d, "commit_times"), table(spark, d, "events")), "period")


# --- streams ------------------------------------------------------------------------

STREAM_DELAY = "2 days"


def _delivered(spark, d, file_rows=None):
    """Events written as the three files of a stream: most of them, a few that are still on time, and the late ones.

    With ``file_rows`` every task writes its own files, of at most so many
    rows: for a stream that takes all files at once.
    """
    events = table(spark, d, "events").select("event_id", "ts", "event_type", "user_id")
    path = scratch_path(spark, "stream-in")
    turn = F.col("event_id") % 97
    for part in (turn > 1, turn == 1, turn == 0):
        rows = events.filter(part)
        writer = rows.write.option("maxRecordsPerFile", int(file_rows)) if file_rows else rows.coalesce(1).write
        writer.mode("append").parquet(path)
    return path, events


def q_stream_windows(spark, d):
    path, events = _delivered(spark, d)
    stream = SW.file_stream(spark, path, events.schema)
    return SW.replay_windows(stream, "ts", "1 day", delay=STREAM_DELAY, keys=["event_type"])


def q_stream_sliding(spark, d):
    path, events = _delivered(spark, d)
    stream = SW.file_stream(spark, path, events.schema)
    return SW.replay_windows(stream, "ts", "2 days", "1 day", delay=STREAM_DELAY)


def q_stream_late_rows(spark, d):
    path, events = _delivered(spark, d)
    windows = SW.replay_windows(SW.file_stream(spark, path, events.schema), "ts", "1 day", delay=STREAM_DELAY)
    return SW.late_rows(windows, events)


SESSION_GAP = "5 hours"
SESSION_FILE_ROWS = 500_000  # nearly each is a session of its own where a task begins to merge them
ALL_FILES = 2 ** 31 - 1


def q_sessions(spark, d):
    return SS.sessions(table(spark, d, "events"), "ts", ["user_id"], SESSION_GAP)


def q_stream_sessions(spark, d):
    path, events = _delivered(spark, d, SESSION_FILE_ROWS)
    # a task reads one or two files, so what it holds does not grow with the input
    own = child_session(spark, **{"spark.sql.files.maxPartitionBytes": "8m"})
    stream = SW.file_stream(own, path, events.schema, files_per_trigger=ALL_FILES)
    return SS.replay_sessions(stream, "ts", ["user_id"], SESSION_GAP, STREAM_DELAY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources / sinks
    "scan_csv": q_scan_csv,
    "schema_contract": q_schema_contract,
    "write_prepared": q_write_prepared,
    "prepare_dataset": q_prepare_dataset,
    "scan_prepared": q_scan_prepared,
    "export_csv": q_export_csv,
    "export_summary": q_export_summary,
    "scan_activity_log": q_scan_activity_log,
    "scan_pr_json": q_scan_pr_json,
    "scan_pr_json_array": q_scan_pr_json_array,
    # cleaning
    "dedupe_rows": lambda s, d: C.dedupe_rows(raw(s, d)),
    "coerce_timestamp": q_coerce_timestamp,
    "coerce_numeric": q_coerce_numeric,
    "null_placeholders": q_null_placeholders,
    "quality_flags": q_quality_flags,
    "drop_invalid_coords": q_drop_invalid_coords,
    "clean": cleaned,
    "quality_report": lambda s, d: C.quality_report(raw(s, d)),
    "quality_report_csv": q_quality_report_csv,
    # derivations
    "normalize_flags": q_normalize_flags,
    "classify_severity": q_classify_severity,
    "calendar_parts": q_calendar_parts,
    "fatality_flag": q_fatality_flag,
    "grid_cell": q_grid_cell,
    "trim_dims": q_trim_dims,
    "prepare": prepared,
    "map_points": points,
    "rename_for_display": q_rename_for_display,
    "rename_weekday": q_rename_weekday,
    "rename_month": q_rename_month,
    # filters
    "filter_dims": q_filter_dims,
    "filter_prepared": q_filter_prepared,
    "filter_neighbourhood": q_filter_neighbourhood,
    "filter_severity": q_filter_severity,
    "filter_recent_days": q_filter_recent_days,
    "filter_road_user": q_filter_road_user,
    "filter_chain": q_filter_chain,
    "filter_classes": q_filter_classes,
    "heatmap_classes": q_heatmap_classes,
    "drop_missing_keys": q_drop_missing_keys,
    # aggregations
    "by_hour": lambda s, d: _positioned(A.collisions_by_hour(prepared(s, d))),
    "by_neighbourhood": lambda s, d: A.collisions_by_neighbourhood(prepared(s, d), top_n=10),
    "by_division": lambda s, d: A.collisions_by_division(prepared(s, d), top_n=10),
    "severity_summary": lambda s, d: A.collision_severity_analysis(prepared(s, d)),
    "by_day_of_week": lambda s, d: _positioned(A.collisions_by_day_of_week(prepared(s, d))),
    "by_month": lambda s, d: A.collisions_by_month(prepared(s, d)),
    "road_users": lambda s, d: A.road_user_analysis(prepared(s, d)),
    "road_users_normalized": lambda s, d: A.road_user_summary_normalized(cleaned(s, d)),
    "road_users_truthy": lambda s, d: A.road_user_with_automobile(prepared(s, d)),
    "severity_trend": lambda s, d: A.severity_trend_over_time(prepared(s, d), "All Severities"),
    "severity_trend_injury": lambda s, d: A.severity_trend_over_time(prepared(s, d), "Injury"),
    "total_trend": lambda s, d: A.total_collisions_trend_over_time(prepared(s, d)),
    "grid_clusters": lambda s, d: A.build_cluster_dataframe(points(s, d)),
    "kpis": lambda s, d: A.kpis(prepared(s, d)),
    "peak_hour": lambda s, d: A.peak_hour(prepared(s, d)),
    "distinct_options": lambda s, d: A.distinct_options(prepared(s, d)),
    "default_year": lambda s, d: A.default_year(prepared(s, d)),
    "map_viewport": q_map_viewport,
    "row_count": lambda s, d: A.row_count(prepared(s, d)),
    # sort / limit / sample
    "top_n": q_top_n,
    "multi_key_sort": q_multi_key_sort,
    "categorical_sort": q_categorical_sort,
    "preview": q_preview,
    "capped_sample": lambda s, d: K.capped_sample(points(s, d), MAP_ROW_CAP),
    # set operations
    "concat_rows": q_concat_rows,
    "trend_overlay": q_trend_overlay,
    "distinct_values": lambda s, d: K.distinct_values(prepared(s, d), "DIVISION"),
    # time series
    "densify_daily": q_densify_daily,
    "densify_daily_by_severity": q_densify_daily_by_severity,
    "forecast_trend": q_forecast_trend,
    "forecast_guard": q_forecast_guard,
    # joins and activity log
    "resolve_alias": lambda s, d: G.resolve_alias(_commits(s, d), _aliases(s, d))
    .select("commit_id", "member_id", "member"),
    "commits_by_member": lambda s, d: G.commits_by_member(_commits(s, d), _aliases(s, d)),
    "commits_per_day": lambda s, d: G.commits_per_day(_commits(s, d), _aliases(s, d)),
    "prs_by_author": lambda s, d: G.prs_by_author(_prs(s, d)),
    "roster_zero_fill": lambda s, d: G.roster_zero_fill(G.prs_by_member(_prs(s, d), _aliases(s, d)),
                                                        _aliases(s, d), ["prs"]),
    "left_merge_counts": lambda s, d: G.left_merge_counts(_commits(s, d), _prs(s, d), _aliases(s, d)),
    "fold_numstat": lambda s, d: G.fold_numstat(_numstat(s, d)),
    "roster_stats": lambda s, d: G.roster_stats(_numstat(s, d), _aliases(s, d)),
    "contribution_summary": lambda s, d: G.contribution_summary(_numstat(s, d), _prs(s, d), _aliases(s, d)),
    "commit_types": lambda s, d: G.commit_types(_commits(s, d)),
    "pr_state_counts": lambda s, d: G.pr_state_counts(_prs(s, d)),
    "reconcile_paths": q_reconcile_paths,
    # frames, time and space joins
    "rolling_means": q_rolling_means,
    "same_day_last_year": q_same_day_last_year,
    "rank_in_month": q_rank_in_month,
    "as_of_commits": q_as_of_commits,
    "interval_join": q_interval_join,
    "interval_counts": q_interval_counts,
    "radius_counts": q_radius_counts,
    "bloom_semi_join": q_bloom_semi_join,
    "bloom_anti_join": q_bloom_anti_join,
    # subtotals, sketches, multisets
    "cube_counts": lambda s, d: S.cube_counts(prepared(s, d), CUBE_DIMS),
    "rollup_counts": lambda s, d: S.rollup_counts(prepared(s, d), CUBE_DIMS),
    "grouping_set_counts": lambda s, d: S.grouping_set_counts(
        prepared(s, d), [["YEAR", "DIVISION"], ["severity_class"], []], CUBE_DIMS),
    "multiset_compare": q_multiset_compare,
    "multiset_intersect": q_multiset_intersect,
    "sketch_weeks": q_sketch_weeks,
    # streams
    "stream_windows": q_stream_windows,
    "stream_sliding": q_stream_sliding,
    "stream_late_rows": q_stream_late_rows,
    "sessions": q_sessions,
    "stream_sessions": q_stream_sessions,
}

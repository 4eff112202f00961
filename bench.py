"""Benchmark: the preparation job and the dashboard / activity queries.

Runs on local[$BENCH_CPUS] over $BENCH_SF_DIR (default /root/testdata/sf0.1)
and prints one JSON line. The raw incident table is first written as CSV
(untimed setup); the timed preparation job reads that CSV and writes the
prepared Parquet once; the dashboard queries then read it, as the dashboard
does. Raw-path queries (quality report, reconcile) read the CSV. One untimed
warm-up pass over the smallest tables ($BENCH_WARMUP_DIR, default the sibling
sf0.001 folder) runs first, so one-off JIT compilation and Python worker
start-up are not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from crashgrid.operators import activity as G  # noqa: E402
from crashgrid.operators import aggregates as A  # noqa: E402
from crashgrid.operators.cleaning import quality_report  # noqa: E402
from crashgrid.operators.derive import map_points  # noqa: E402
from crashgrid.operators.filters import DashboardParams, filter_chain  # noqa: E402
from crashgrid.operators.reconcile import reconcile_paths  # noqa: E402
from crashgrid.operators.cleaning import clean  # noqa: E402
from crashgrid.operators.sampling import capped_sample  # noqa: E402
from crashgrid.operators.timeseries import densify_daily, forecast_collision_trend  # noqa: E402
from crashgrid.plans.dashboard import dashboard_view, release  # noqa: E402
from crashgrid.plans.prepare import prepare_dataset  # noqa: E402
from crashgrid.session import get_spark, scratch_path  # noqa: E402
from crashgrid.sources.fixtures import fixture, raw_incidents  # noqa: E402
from crashgrid.sources.csv import load_dataset  # noqa: E402
from crashgrid.sources.export import export_results  # noqa: E402
from crashgrid.sources.parquet import get_prepared_data  # noqa: E402


def _scale_factor(sf_dir: str):
    name = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        return float(name)
    except ValueError:
        return name


def run_suite(spark, sf_dir: str, timings: dict | None) -> None:
    """Run every headline query once; record seconds per query when ``timings`` is given."""

    def run(name, build, action="collect"):
        t0 = time.perf_counter()
        df = build()
        if action == "collect":
            df.collect()
        else:
            df.write.format("noop").mode("overwrite").save()
        if timings is not None:
            timings[name] = round(time.perf_counter() - t0, 3)

    # Setup (untimed): the raw incident table lands as a CSV file set, which is
    # what the preparation job reads in production.
    raw_csv = export_results(raw_incidents(spark, sf_dir), scratch_path(spark, "bench-raw-csv"))
    raw = load_dataset(spark, raw_csv)
    prepared_path = scratch_path(spark, "bench-prepared")
    run("prepare", lambda: spark.read.parquet(prepare_dataset(spark, raw_csv, prepared_path)).limit(1))
    prepared = get_prepared_data(spark, prepared_path)
    view = filter_chain(prepared, DashboardParams(years=(1997, 1998), recent_days=365))
    points = map_points(prepared)
    aliases, commits = fixture(spark, sf_dir, "aliases"), fixture(spark, sf_dir, "commits")
    numstat, prs = fixture(spark, sf_dir, "numstat"), fixture(spark, sf_dir, "prs")

    run("quality_report", lambda: quality_report(raw))
    run("by_hour", lambda: A.collisions_by_hour(prepared))
    run("by_neighbourhood", lambda: A.collisions_by_neighbourhood(prepared, 10))
    run("by_division", lambda: A.collisions_by_division(prepared, 10))
    run("severity_summary", lambda: A.collision_severity_analysis(prepared))
    run("road_users", lambda: A.road_user_analysis(prepared))
    run("by_day_of_week", lambda: A.collisions_by_day_of_week(prepared))
    run("by_month", lambda: A.collisions_by_month(prepared))
    run("kpis", lambda: A.kpis(prepared))
    run("peak_hour", lambda: A.peak_hour(prepared))
    run("severity_trend", lambda: A.severity_trend_over_time(prepared))
    run("densify_daily", lambda: densify_daily(A.total_collisions_trend_over_time(prepared)))
    run("forecast_trend", lambda: forecast_collision_trend(A.total_collisions_trend_over_time(prepared), 30))
    run("filter_chain", lambda: view, action="noop")
    run("capped_sample", lambda: capped_sample(points, 6000), action="noop")
    run("grid_clusters", lambda: A.build_cluster_dataframe(points), action="noop")
    run("map_viewport", lambda: A.map_viewport(points))

    def full_view():
        panels = dashboard_view(prepared, DashboardParams(years=(1998,), recent_days=90, top_n=10,
                                                          forecast_horizon=7), 6000)
        try:
            for name, df in panels.items():
                if name != "filtered" and not name.startswith("_"):
                    df.collect()
        finally:
            release(panels)
        return spark.range(1)
    run("dashboard_view", full_view)
    run("reconcile_paths", lambda: reconcile_paths(clean(raw), prepared))
    run("fold_numstat", lambda: G.fold_numstat(numstat))
    run("contribution_summary", lambda: G.contribution_summary(numstat, prs, aliases))
    run("resolve_alias", lambda: G.resolve_alias(commits, aliases), action="noop")
    run("left_merge_counts", lambda: G.left_merge_counts(commits, prs, aliases))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    warmup_dir = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", app="crashgrid-bench", shuffle_partitions=cpus,
                      conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    # Untimed warm-up on the smallest tables: JIT compilation of the generated
    # code and Python worker start-up happen once, not inside the timings.
    if warmup_dir and os.path.isdir(warmup_dir) and os.path.abspath(warmup_dir) != os.path.abspath(sf_dir):
        run_suite(spark, warmup_dir, None)

    timings: dict[str, float] = {}
    run_suite(spark, sf_dir, timings)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": timings,
                      "sf": _scale_factor(sf_dir), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()

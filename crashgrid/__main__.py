"""Command line: ``python -m crashgrid <command> ...``.

  prepare RAW_CSV OUT            raw CSV -> cleaned, derived, partitioned Parquet
  report RAW_CSV                 quality report, then hourly / neighbourhood / severity counts
  validate RAW_CSV PREPARED      the same metrics from both paths, side by side
  view PREPARED [--years Y ...] [--divisions D ...] [--neighbourhoods N ...] [--severity S]
       [--recent-days N | --all-time] [--top N] [--horizon N] [--pedestrian] [--bicycle] [--motorcycle]
                                 every dashboard panel for one filter selection (defaults: latest
                                 year, last 30 days)
  contributions --numstat P --prs P --aliases P [--out DIR]
                                 roster summary from numstat logs, PR JSON and an alias CSV
"""

from __future__ import annotations

import argparse
import sys

from .operators import activity as G
from .operators import aggregates as A
from .operators.cleaning import clean, quality_report
from .operators.reconcile import reconcile_paths
from .operators.filters import DashboardParams
from .plans.dashboard import dashboard_view, default_params, export_view, release
from .plans.prepare import prepare_dataset
from .session import get_spark
from .sources.activity import read_aliases, read_numstat_log, scan_pr_json
from .sources.csv import load_dataset
from .sources.export import export_results, export_summary
from .sources.parquet import get_prepared_data


def show_table(df, rows: int) -> None:
    """Print at most ``rows`` rows and say so when there are more."""
    total = df.count()
    df.show(rows, truncate=False)
    if total > rows:
        print(f"(preview: first {rows} of {total} rows; use --out for all)")


def main(argv=None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="crashgrid", description=__doc__,
                                     formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    p = sub.add_parser("prepare"); p.add_argument("raw"); p.add_argument("out")
    r = sub.add_parser("report"); r.add_argument("raw"); r.add_argument("--top", type=int, default=10)
    v = sub.add_parser("validate"); v.add_argument("raw"); v.add_argument("prepared"); v.add_argument("--out")
    w = sub.add_parser("view"); w.add_argument("prepared")
    w.add_argument("--years", type=int, nargs="*"); w.add_argument("--divisions", nargs="*")
    w.add_argument("--neighbourhoods", nargs="*"); w.add_argument("--severity", default="All Severities")
    w.add_argument("--recent-days", type=int); w.add_argument("--all-time", action="store_true")
    w.add_argument("--map-sample-rows", type=int, default=6000, help="points kept for display in map_sample")
    w.add_argument("--out", help="folder for every panel and the filtered rows, as CSV")
    w.add_argument("--top", type=int, default=10); w.add_argument("--horizon", type=int, default=7)
    for flag in ("pedestrian", "bicycle", "motorcycle"):
        w.add_argument(f"--{flag}", action="store_true")
    c = sub.add_parser("contributions")
    c.add_argument("--numstat", required=True); c.add_argument("--prs", required=True)
    c.add_argument("--aliases", required=True); c.add_argument("--out")
    c.add_argument("--json-array", action="store_true", help="PR files hold JSON arrays")
    args = parser.parse_args(argv)
    spark = spark or get_spark()

    if args.command == "prepare":
        print(f"Prepared dataset written to: {prepare_dataset(spark, args.raw, args.out)}")
    elif args.command == "report":
        raw = load_dataset(spark, args.raw)
        print("DATA QUALITY REPORT")
        quality_report(raw).show(vertical=True, truncate=False)
        cleaned = clean(raw)
        show_table(A.collisions_by_hour(cleaned), 100)
        A.collisions_by_neighbourhood(cleaned, args.top).show(args.top, truncate=False)
        A.collision_severity_analysis(cleaned).show(truncate=False)
    elif args.command == "validate":
        raw = load_dataset(spark, args.raw)
        report = reconcile_paths(clean(raw), get_prepared_data(spark, args.prepared))
        if args.out:
            print(f"Report written to: {export_results(report, args.out)}")
        else:
            show_table(report, 1000)
    elif args.command == "view":
        prepared = get_prepared_data(spark, args.prepared)
        defaults = default_params(prepared)
        params = DashboardParams(
            years=tuple(args.years) if args.years else defaults.years,
            divisions=tuple(args.divisions) if args.divisions else None,
            neighbourhoods=tuple(args.neighbourhoods) if args.neighbourhoods else None,
            severity=args.severity, pedestrian=args.pedestrian, bicycle=args.bicycle,
            motorcycle=args.motorcycle,
            recent_days=None if args.all_time else (args.recent_days or defaults.recent_days),
            top_n=args.top, forecast_horizon=args.horizon)
        print(f"View: {params}")
        view = dashboard_view(prepared, params, args.map_sample_rows)
        try:
            if args.out:
                print(f"Filtered rows written to: {export_view(view, args.out + '/filtered')}")
            for name, df in view.items():
                if name == "filtered" or name.startswith("_"):
                    continue
                if args.out:
                    print(f"{name} written to: {export_results(df, args.out + '/' + name)}")
                elif name in ("map_points", "map_sample"):
                    print(f"{name}: {df.count()} points")
                else:
                    print(name)
                    show_table(df, 50)
        finally:
            release(view)
    elif args.command == "contributions":
        summary = G.contribution_summary(read_numstat_log(spark, args.numstat),
                                         scan_pr_json(spark, args.prs, json_array=args.json_array),
                                         read_aliases(spark, args.aliases))
        if args.out:
            print(f"Summary written to: {export_summary(summary, args.out)}")
        else:
            show_table(summary, 1000)
    return 0


if __name__ == "__main__":
    sys.exit(main())

from crashgrid.operators.filters import DashboardParams, filter_collisions_prepared
from crashgrid.plans.dashboard import dashboard_view, release
from crashgrid.plans.prepare import prepare_dataset, prepare_frame
from crashgrid.session import scratch_path
from crashgrid.sources.export import export_results
from crashgrid.sources.fixtures import raw_incidents
from data_paths import SF_SMALL
from plan_util import plan_text


def _rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.collect())


def test_prepare_dataset_csv_to_parquet_round_trip(spark):
    raw = raw_incidents(spark, SF_SMALL)
    csv_path = export_results(raw, scratch_path(spark, "raw"))
    out = prepare_dataset(spark, csv_path, scratch_path(spark, "prepared"))
    written = spark.read.parquet(out)
    expected = prepare_frame(raw)
    cols = sorted(expected.columns)
    assert sorted(written.columns) == cols
    assert _rows(written.select(*cols)) == _rows(expected.select(*cols))
    # the year is a folder partition, so a year filter prunes folders
    assert any("YEAR=1996" in f for f in written.inputFiles())
    plan = plan_text(written.filter("YEAR = 1996").select("EVENT_UNIQUE_ID"))
    assert "PartitionFilters: [isnotnull(YEAR" in plan and "ReadSchema: struct<EVENT_UNIQUE_ID:string>" in plan


def test_prepare_dataset_sizes_its_shuffle_and_restores_the_setting(spark):
    from crashgrid.plans.prepare import input_bytes
    raw = raw_incidents(spark, SF_SMALL)
    csv_path = export_results(raw, scratch_path(spark, "raw"))
    assert input_bytes(spark, csv_path) > 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = prepare_dataset(spark, csv_path, scratch_path(spark, "prepared"), shuffle_partitions=37)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert spark.read.parquet(out).count() == prepare_frame(raw).count()


def test_filter_prepared_falls_back_to_occ_year(spark):
    df = spark.createDataFrame([(2021.0, "D11"), (2022.0, "D12")], "OCC_YEAR double, DIVISION string")
    assert filter_collisions_prepared(df, years=[2022]).count() == 1


def test_dashboard_view_computes_every_panel(spark):
    prepared = prepare_frame(raw_incidents(spark, SF_SMALL))
    view = dashboard_view(prepared, DashboardParams(years=(1996, 1997, 1998), recent_days=365, top_n=5,
                                                    forecast_horizon=7), 6000)
    try:
        n = view["filtered"].count()
        assert n > 0
        assert view["kpis"].first()["total_collisions"] == n
        assert view["by_neighbourhood"].count() <= 5
        assert view["map_sample"].count() == min(n, 6000)
        assert len(view["severity"].collect()) == 3
        assert view["forecast"].count() in (0, 7)
        assert view["trend_overlay"].count() >= view["total_trend"].count()
        for name, df in view.items():
            df.limit(1).collect()
    finally:
        release(view)


def test_map_points_empty_without_coordinates(spark):
    from crashgrid.operators.derive import map_points
    df = spark.createDataFrame([("x",)], "severity_class string")
    out = map_points(df)
    assert out.columns == [] and out.count() == 0


def test_dashboard_view_unnarrowed_is_not_persisted(spark):
    prepared = prepare_frame(raw_incidents(spark, SF_SMALL))
    view = dashboard_view(prepared, DashboardParams(), 6000)
    assert not view["filtered"].is_cached
    assert view["kpis"].first()["total_collisions"] == prepared.count()
    release(view)


def test_export_view_writes_filtered_rows(spark):
    from crashgrid.plans.dashboard import export_view
    prepared = prepare_frame(raw_incidents(spark, SF_SMALL))
    view = dashboard_view(prepared, DashboardParams(years=(1997,)), 6000)
    try:
        path = export_view(view, scratch_path(spark, "view-export"))
        back = spark.read.option("header", True).csv(path)
        assert back.count() == view["filtered"].count() > 0
        assert set(back.columns) == set(prepared.columns)
    finally:
        release(view)


def test_shuffle_partitions_for_input_size():
    from crashgrid.session import shuffle_partitions_for
    assert shuffle_partitions_for(10 << 20) == 200                 # small input: the floor
    assert shuffle_partitions_for(10 << 40) == 40_960             # 10 TiB at 256 MiB each
    assert shuffle_partitions_for(100 << 40) == 409_600           # 100 TiB: grows on


def _rounded(row):
    """Row text with floats rounded (means differ in the last digits with summation order)."""
    return repr(tuple(round(v, 9) if isinstance(v, float) else v for v in row))


def test_persisted_view_caches_only_view_columns_and_matches_unpersisted(spark):
    from crashgrid.plans.dashboard import VIEW_COLUMNS
    prepared = prepare_frame(raw_incidents(spark, SF_SMALL))
    params = DashboardParams(years=(1997, 1998), recent_days=365, top_n=5, forecast_horizon=7)
    cached, plain = dashboard_view(prepared, params, 6000), dashboard_view(prepared, params, 6000, persist=False)
    try:
        assert cached["_rows"].is_cached and set(cached["_rows"].columns) <= set(VIEW_COLUMNS)
        assert len(cached["_rows"].columns) < len(prepared.columns)
        assert cached["filtered"].columns == prepared.columns
        for name in plain:
            if name.startswith("_"):
                continue
            a, b = cached[name], plain[name]
            assert a.schema == b.schema, name
            assert sorted(map(_rounded, a.collect())) == sorted(map(_rounded, b.collect())), name
    finally:
        release(cached)
        release(plain)

"""Oracle SQL (DuckDB dialect) for every registered query.

Each text restates the query's semantics directly in SQL over the same
shared tables, using the same fixture SQL as the Spark side. Used by the
correctness gate; none of it runs on Spark.
"""

from __future__ import annotations

from ..functions.coerce import NUMBER_PATTERN
from ..schema import (CSV_NULL_TOKENS, HEATMAP_CLASSES, MONTH_NAMES, PLACEHOLDER_NEIGHBOURHOODS,
                      POINT_DRAW_ORDER, REQUIRED_COLUMNS, STATUS_ACTIVE, STATUS_INACTIVE, WEEKDAYS)
from ..sources.fixtures import fixture_sql

WS = "(' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"
# The same layouts as schema.TIMESTAMP_FORMATS, in DuckDB's notation.
DUCK_TS_FORMATS = ["%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y"]


def q(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip(x: str) -> str:
    return f"trim(CAST({x} AS VARCHAR), {WS})"


def num(x: str) -> str:
    return (f"CASE WHEN regexp_full_match(CAST({x} AS VARCHAR), '{NUMBER_PATTERN}') "
            f"THEN TRY_CAST({strip(x)} AS DOUBLE) END")


def ts(x: str) -> str:
    return "coalesce(" + ", ".join(f"try_strptime({strip(x)}, '{f}')" for f in DUCK_TS_FORMATS) + ")"


def flag(x: str) -> str:
    return f"upper({strip(f'coalesce({x}, {chr(39)}{chr(39)})')})"


def placeholder(x: str) -> str:
    t = strip(f"coalesce({x}, '')")
    return f"CASE WHEN upper({t}) IN ({q(PLACEHOLDER_NEIGHBOURHOODS)}) THEN NULL ELSE {t} END"


MAP_COLS = ("EVENT_UNIQUE_ID, LAT_WGS84, LONG_WGS84, NEIGHBOURHOOD_158, OCC_HOUR, DIVISION, FATALITIES, "
            "OCC_DATE_STR, severity_class, lat_cluster, lon_cluster")

INCIDENT_BASE = f"""
WITH raw AS ({fixture_sql("raw_incidents")}),
csv_raw AS (SELECT {", ".join(f"CASE WHEN {c} IN ({q(CSV_NULL_TOKENS)}) THEN NULL ELSE {c} END AS {c}"
                             for c in ["EVENT_UNIQUE_ID", "OCC_DATE", "OCC_YEAR", "OCC_HOUR", "OCC_DOW",
                                       "DIVISION", "FATALITIES", "INJURY_COLLISIONS", "PD_COLLISIONS",
                                       "NEIGHBOURHOOD_158", "LONG_WGS84", "LAT_WGS84", "AUTOMOBILE",
                                       "MOTORCYCLE", "BICYCLE", "PEDESTRIAN"])} FROM raw),
typed AS (
  SELECT EVENT_UNIQUE_ID, {ts("OCC_DATE")} AS OCC_DATE, {num("OCC_YEAR")} AS OCC_YEAR,
    {num("OCC_HOUR")} AS OCC_HOUR, OCC_DOW, DIVISION, FATALITIES, INJURY_COLLISIONS, PD_COLLISIONS,
    {placeholder("NEIGHBOURHOOD_158")} AS NEIGHBOURHOOD_158,
    {num("LONG_WGS84")} AS LONG_WGS84, {num("LAT_WGS84")} AS LAT_WGS84,
    AUTOMOBILE, MOTORCYCLE, BICYCLE, PEDESTRIAN
  FROM (SELECT DISTINCT * FROM raw) d),
flagged AS (
  SELECT *, coalesce(LAT_WGS84 IS NOT NULL AND LONG_WGS84 IS NOT NULL AND LAT_WGS84 <> 0
                     AND LONG_WGS84 <> 0, false) AS HAS_VALID_COORDINATES,
         NEIGHBOURHOOD_158 IS NOT NULL AS HAS_VALID_NEIGHBOURHOOD
  FROM typed),
cleaned AS (SELECT * FROM flagged WHERE HAS_VALID_COORDINATES),
prepared AS (
  SELECT EVENT_UNIQUE_ID, OCC_DATE,
    OCC_YEAR, OCC_HOUR,
    OCC_DOW, {strip("DIVISION")} AS DIVISION, FATALITIES,
    {flag("INJURY_COLLISIONS")} AS INJURY_COLLISIONS, {flag("PD_COLLISIONS")} AS PD_COLLISIONS,
    {strip("NEIGHBOURHOOD_158")} AS NEIGHBOURHOOD_158, LONG_WGS84, LAT_WGS84, AUTOMOBILE,
    {flag("MOTORCYCLE")} AS MOTORCYCLE, {flag("BICYCLE")} AS BICYCLE, {flag("PEDESTRIAN")} AS PEDESTRIAN,
    HAS_VALID_COORDINATES, HAS_VALID_NEIGHBOURHOOD,
    strftime(OCC_DATE, '%Y-%m-%d') AS OCC_DATE_STR, CAST(year(OCC_DATE) AS DOUBLE) AS YEAR,
    CAST(month(OCC_DATE) AS DOUBLE) AS MONTH, CAST(day(OCC_DATE) AS DOUBLE) AS DAY,
    coalesce({num("FATALITIES")}, 0) > 0 AS HAS_FATALITY,
    CASE WHEN coalesce({num("FATALITIES")}, 0) > 0 THEN 'Fatal'
         WHEN {flag("INJURY_COLLISIONS")} = 'YES' THEN 'Injury'
         WHEN {flag("PD_COLLISIONS")} = 'YES' THEN 'Property Damage'
         ELSE 'Other' END AS severity_class,
    round_even(LAT_WGS84 * 1000, 0) / 1000 AS lat_cluster,
    round_even(LONG_WGS84 * 1000, 0) / 1000 AS lon_cluster
  FROM cleaned),
points AS (SELECT {MAP_COLS} FROM prepared WHERE LAT_WGS84 IS NOT NULL AND LONG_WGS84 IS NOT NULL)
"""

ACTIVITY_BASE = f"""
WITH aliases AS ({fixture_sql("aliases")}),
commits AS ({fixture_sql("commits")}),
numstat AS ({fixture_sql("numstat")}),
prs AS ({fixture_sql("prs")}),
lookup AS (
  SELECT alias_key, arg_max(member_id, member_id) AS member_id, arg_max(member, member_id) AS member
  FROM (SELECT lower({strip("alias")}) AS alias_key, member_id, member FROM aliases) a
  WHERE alias_key <> '' GROUP BY alias_key),
members AS (SELECT DISTINCT member_id, member FROM aliases),
resolved AS (
  SELECT c.*, l.member_id, l.member FROM commits c JOIN lookup l ON lower({strip("c.author")}) = l.alias_key),
lines AS (SELECT repo, line_no, {strip("txt")} AS line FROM numstat WHERE {strip("txt")} <> ''),
marked AS (
  SELECT *, string_split(line, chr(9)) AS parts,
    (len(string_split(line, chr(9))) <> 3 OR line_no = min(line_no) OVER (PARTITION BY repo)) AS is_header
  FROM lines),
attributed AS (
  SELECT *, last_value(CASE WHEN is_header THEN line END IGNORE NULLS)
    OVER (PARTITION BY repo ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS author
  FROM marked),
stats AS (
  SELECT author AS name,
    CAST(sum(CASE WHEN is_header THEN 1 ELSE 0 END) AS BIGINT) AS commits,
    CAST(sum(CASE WHEN NOT is_header AND regexp_full_match(parts[1], '[0-9]+') THEN CAST(parts[1] AS BIGINT)
             ELSE 0 END) AS BIGINT) AS insertions,
    CAST(sum(CASE WHEN NOT is_header AND regexp_full_match(parts[2], '[0-9]+') THEN CAST(parts[2] AS BIGINT)
             ELSE 0 END) AS BIGINT) AS deletions,
    CAST(sum(CASE WHEN NOT is_header THEN 1 ELSE 0 END) AS BIGINT) AS files_changed
  FROM attributed GROUP BY author),
member_stats AS (
  SELECT l.member_id, l.member, sum(commits) AS commits, sum(files_changed) AS files_changed,
         sum(insertions) AS insertions, sum(deletions) AS deletions
  FROM stats s JOIN lookup l ON lower({strip("s.name")}) = l.alias_key GROUP BY l.member_id, l.member),
pr_login AS (
  SELECT lower({strip("login")}) AS login, count(*) AS prs FROM prs
  WHERE login IS NOT NULL AND lower({strip("login")}) <> '' GROUP BY 1),
pr_member AS (
  SELECT l.member_id, l.member, CAST(sum(p.prs) AS BIGINT) AS prs
  FROM pr_login p JOIN lookup l ON p.login = l.alias_key GROUP BY l.member_id, l.member),
commit_member AS (
  SELECT m.member_id, m.member, CAST(coalesce(c.commits, 0) AS BIGINT) AS commits
  FROM members m LEFT JOIN (SELECT member_id, member, count(*) AS commits FROM resolved GROUP BY 1, 2) c
  ON m.member_id = c.member_id AND m.member = c.member),
summary AS (
  SELECT m.member_id, m.member,
    CAST(coalesce(s.commits, 0) AS BIGINT) AS commits, CAST(coalesce(s.files_changed, 0) AS BIGINT) AS files_changed,
    CAST(coalesce(s.insertions, 0) AS BIGINT) AS insertions, CAST(coalesce(s.deletions, 0) AS BIGINT) AS deletions,
    CAST(coalesce(p.prs, 0) AS BIGINT) AS prs,
    CASE WHEN coalesce(s.commits, 0) > 0 OR coalesce(p.prs, 0) > 0 THEN '{STATUS_ACTIVE}'
         ELSE '{STATUS_INACTIVE}' END AS status, h.github
  FROM members m
  LEFT JOIN (SELECT member_id, member, min(github) AS github FROM aliases GROUP BY 1, 2) h
    ON m.member_id = h.member_id AND m.member = h.member
  LEFT JOIN member_stats s ON m.member_id = s.member_id AND m.member = s.member
  LEFT JOIN (SELECT k.member_id, k.member, sum(pl.prs) AS prs FROM pr_login pl JOIN
               (SELECT DISTINCT member_id, member, lower({strip("alias")}) AS login FROM aliases
                WHERE lower({strip("alias")}) <> '') k ON pl.login = k.login GROUP BY 1, 2) p
    ON m.member_id = p.member_id AND m.member = p.member)
"""


def _counts(table: str, key: str, alias: str | None = None, where: str = "") -> str:
    alias = alias or key
    cond = f"{key} IS NOT NULL" + (f" AND {where}" if where else "")
    return f"SELECT {key} AS {alias}, count(*) AS collision_count FROM {table} WHERE {cond} GROUP BY 1"


def _stack(table: str, items, label: str, value: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS {label}, CAST(count_if({cond}) AS BIGINT) AS {value} FROM {table}"
        for name, cond in items)


def _recent(table: str, days: int) -> str:
    return (f"SELECT * FROM {table} WHERE (SELECT max(OCC_DATE) FROM {table}) IS NULL "
            f"OR OCC_DATE >= (SELECT max(OCC_DATE) FROM {table}) - INTERVAL {int(days)} DAY")


def _month_name(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {i} THEN '{m}'" for i, m in enumerate(MONTH_NAMES, 1)) + " END"


def _trend_severity(table: str) -> str:
    return (f"SELECT date_trunc('day', OCC_DATE) AS date, severity_class AS severity_type, count(*) AS value "
            f"FROM {table} WHERE OCC_DATE IS NOT NULL AND severity_class IN ('Fatal', 'Injury', 'Property Damage') "
            f"GROUP BY 1, 2")


def _trend_total(table: str) -> str:
    return f"SELECT date_trunc('day', OCC_DATE) AS date, count(*) AS value FROM {table} WHERE OCC_DATE IS NOT NULL GROUP BY 1"


def _placed(sql: str, order: str) -> str:
    return f"SELECT *, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position FROM ({sql}) counted"


def _forecast(table: str, horizon: int) -> str:
    """The smoothing fit as recursive SQL: one row per weight pair walks the days, on three ever finer lattices."""
    zero = "CAST(0 AS DOUBLE)"
    one = "CAST(1 AS DOUBLE)"
    ctes = [f"""seen AS (SELECT date, CAST(value AS DOUBLE) AS value FROM ({_trend_total(table)})),
        days AS MATERIALIZED (
          SELECT row_number() OVER (ORDER BY g.date) AS i, g.date, coalesce(seen.value, 0) AS y
          FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM seen) g
          LEFT JOIN seen ON g.date = seen.date),
        best0 AS (SELECT CAST(0.5 AS DOUBLE) AS a, CAST(0.5 AS DOUBLE) AS b)"""]
    for n, step, side in ((1, "0.01", 101), (2, "0.001", 21), (3, "0.0001", 21)):
        size = f"CAST({step} AS DOUBLE)"
        ctes.append(f"""grid{n} AS (
          SELECT least({one}, greatest({zero}, best.a + (x.k - {side // 2}) * {size})) AS a,
                 least({one}, greatest({zero}, best.b + (z.k - {side // 2}) * {size})) AS b
          FROM best{n - 1} best, range(0, {side}) x(k), range(0, {side}) z(k)),
        walk{n} AS (
          SELECT CAST(0 AS BIGINT) AS i, a, b, {zero} AS l0, {zero} AS t0, {one} AS l1, {zero} AS t1, {zero} AS l2,
                 {one} AS t2, {zero} AS uu, {zero} AS uv, {zero} AS vv, {zero} AS ur, {zero} AS vr, {zero} AS rr
          FROM grid{n}
          UNION ALL
          SELECT days.i, a, b,
            a * y + (1 - a) * (l0 + t0), b * ((a * y + (1 - a) * (l0 + t0)) - l0) + (1 - b) * t0,
            (1 - a) * (l1 + t1), b * ((1 - a) * (l1 + t1) - l1) + (1 - b) * t1,
            (1 - a) * (l2 + t2), b * ((1 - a) * (l2 + t2) - l2) + (1 - b) * t2,
            uu + (l1 + t1) * (l1 + t1), uv + (l1 + t1) * (l2 + t2), vv + (l2 + t2) * (l2 + t2),
            ur + (l1 + t1) * (y - (l0 + t0)), vr + (l2 + t2) * (y - (l0 + t0)),
            rr + (y - (l0 + t0)) * (y - (l0 + t0))
          FROM walk{n} JOIN days ON days.i = walk{n}.i + 1),
        solved{n} AS (
          SELECT *, (ur * vv - vr * uv) / (uu * vv - uv * uv) AS l, (vr * uu - ur * uv) / (uu * vv - uv * uv) AS t
          FROM walk{n} WHERE i = (SELECT max(i) FROM days) AND uu * vv - uv * uv > 0),
        best{n} AS MATERIALIZED (
          SELECT a, b, l0 + l * l1 + t * l2 AS level, t0 + l * t1 + t * t2 AS trend
          FROM solved{n}
          ORDER BY greatest(rr - 2 * l * ur - 2 * t * vr + l * l * uu + 2 * l * t * uv + t * t * vv, {zero}), a, b
          LIMIT 1)""")
    return f"""SELECT * FROM (WITH RECURSIVE {", ".join(ctes)}
        SELECT (SELECT max(date) FROM days) + INTERVAL 1 DAY * h AS date, round(level + h * trend, 6) AS value,
               'Forecast' AS series_type
        FROM best3, range(1, {int(horizon)} + 1) r(h) WHERE (SELECT count(*) FROM seen) >= 30)"""


def _peak(table: str) -> str:
    return f"""
SELECT CAST(h AS INTEGER) AS peak_hour_value,
       CASE WHEN h IS NULL THEN 'N/A' ELSE printf('%02d:00', CAST(h AS INTEGER)) END AS peak_hour
FROM (SELECT (SELECT OCC_HOUR FROM (SELECT OCC_HOUR, count(*) AS c FROM {table} WHERE OCC_HOUR IS NOT NULL GROUP BY 1)
              ORDER BY c DESC, OCC_HOUR ASC LIMIT 1) AS h)"""


def _metrics(table: str, normalized: bool) -> str:
    if normalized:
        road = [(n, f"{flag(c)} = 'YES'") for n, c in (("Pedestrian", "PEDESTRIAN"), ("Bicycle", "BICYCLE"),
                                                          ("Motorcycle", "MOTORCYCLE"))]
    else:
        road = [(n, f"{c} = 'YES'") for n, c in (("Pedestrian", "PEDESTRIAN"), ("Bicycle", "BICYCLE"),
                                                  ("Motorcycle", "MOTORCYCLE"))]
    severity = (f"SELECT 'severity' AS metric, severity_type AS key, value FROM ("
                + _stack(table, [(c, f"severity_class = '{c}'") for c in ("Fatal", "Injury", "Property Damage")],
                         "severity_type", "value") + ")") if normalized else None
    parts = [
        f"SELECT 'row_count' AS metric, '' AS key, count(*) AS value FROM {table}",
        f"SELECT 'peak_hour' AS metric, peak_hour AS key, 1 AS value FROM ({_peak(table)})",
        f"SELECT 'by_hour' AS metric, CAST(TRY_CAST(OCC_HOUR AS BIGINT) AS VARCHAR) AS key, count(*) AS value "
        f"FROM {table} WHERE OCC_HOUR IS NOT NULL GROUP BY OCC_HOUR",
        f"SELECT 'top_neighbourhood' AS metric, key, value FROM (SELECT NEIGHBOURHOOD_158 AS key, count(*) AS value "
        f"FROM {table} WHERE NEIGHBOURHOOD_158 IS NOT NULL GROUP BY 1 ORDER BY value DESC, key ASC LIMIT 10)",
        f"SELECT 'road_user' AS metric, road_user_type AS key, collision_count AS value FROM ("
        + _stack(table, road, "road_user_type", "collision_count") + ")",
    ]
    if severity:
        parts.append(severity)
    return " UNION ALL ".join(f"SELECT metric, key, CAST(value AS BIGINT) AS value FROM ({p})" for p in parts)


def _quality(table: str) -> str:
    return f"""SELECT CAST(count(*) AS BIGINT) AS total_rows,
        CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {table}) d) AS BIGINT) AS duplicate_rows,
        CAST(count_if(OCC_DATE IS NULL) AS BIGINT) AS missing_occ_date,
        CAST(count_if(OCC_HOUR IS NULL) AS BIGINT) AS missing_occ_hour,
        CAST(count_if(lat = 0 OR lon = 0 OR lat IS NULL OR lon IS NULL) AS BIGINT) AS invalid_coordinates,
        CAST(count_if(upper(coalesce(NEIGHBOURHOOD_158, '')) IN ({q(PLACEHOLDER_NEIGHBOURHOODS)})) AS BIGINT)
          AS placeholder_neighbourhoods,
        CAST(count_if(OCC_DATE IS NOT NULL AND parsed IS NULL) AS BIGINT) AS unparseable_occ_date
      FROM (SELECT *, {num('LAT_WGS84')} AS lat, {num('LONG_WGS84')} AS lon, {ts('OCC_DATE')} AS parsed
            FROM {table})"""


_ROAD3 = [("Pedestrian", "PEDESTRIAN"), ("Bicycle", "BICYCLE"), ("Motorcycle", "MOTORCYCLE")]

_TOKENS = q(CSV_NULL_TOKENS)

INCIDENT_SQL = {
    # --- sources
    "scan_csv": "SELECT " + ", ".join(
        f"CASE WHEN {c} IN ({_TOKENS}) THEN NULL ELSE {c} END AS {c}"
        for c in REQUIRED_COLUMNS[:4] + ["OCC_DOW"] + REQUIRED_COLUMNS[4:]) + " FROM raw",
    "schema_contract": "SELECT " + ", ".join(REQUIRED_COLUMNS) + " FROM raw",
    "write_prepared": "SELECT * FROM prepared",
    "prepare_dataset": "SELECT * FROM prepared",
    "scan_prepared": "SELECT * FROM prepared",
    "export_csv": _counts("prepared", "OCC_HOUR"),
    # --- cleaning
    "dedupe_rows": "SELECT DISTINCT * FROM raw",
    "coerce_timestamp": f"SELECT EVENT_UNIQUE_ID, {ts('OCC_DATE')} AS OCC_DATE FROM raw",
    "coerce_numeric": f"SELECT EVENT_UNIQUE_ID, {num('OCC_YEAR')} AS OCC_YEAR, {num('OCC_HOUR')} AS OCC_HOUR, "
                      f"{num('LAT_WGS84')} AS LAT_WGS84, {num('LONG_WGS84')} AS LONG_WGS84 FROM raw",
    "null_placeholders": f"SELECT EVENT_UNIQUE_ID, {placeholder('NEIGHBOURHOOD_158')} AS NEIGHBOURHOOD_158 FROM raw",
    "quality_flags": f"""SELECT EVENT_UNIQUE_ID,
        coalesce(lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0, false) AS HAS_VALID_COORDINATES,
        n IS NOT NULL AS HAS_VALID_NEIGHBOURHOOD
      FROM (SELECT EVENT_UNIQUE_ID, {num('LAT_WGS84')} AS lat, {num('LONG_WGS84')} AS lon,
                   {placeholder('NEIGHBOURHOOD_158')} AS n FROM raw)""",
    "drop_invalid_coords": f"""SELECT EVENT_UNIQUE_ID, lat AS LAT_WGS84, lon AS LONG_WGS84
      FROM (SELECT EVENT_UNIQUE_ID, {num('LAT_WGS84')} AS lat, {num('LONG_WGS84')} AS lon FROM raw)
      WHERE coalesce(lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0, false)""",
    "clean": "SELECT * FROM cleaned",
    "quality_report": _quality("raw"),
    "quality_report_csv": _quality("csv_raw"),
    # --- derivations
    "normalize_flags": "SELECT EVENT_UNIQUE_ID, INJURY_COLLISIONS, PD_COLLISIONS, PEDESTRIAN, BICYCLE, MOTORCYCLE "
                       "FROM prepared",
    "classify_severity": "SELECT EVENT_UNIQUE_ID, severity_class FROM prepared",
    "calendar_parts": "SELECT EVENT_UNIQUE_ID, OCC_DATE_STR, YEAR, MONTH, DAY FROM prepared",
    "fatality_flag": "SELECT EVENT_UNIQUE_ID, HAS_FATALITY FROM prepared",
    "grid_cell": "SELECT EVENT_UNIQUE_ID, lat_cluster, lon_cluster FROM prepared",
    "trim_dims": "SELECT EVENT_UNIQUE_ID, DIVISION, NEIGHBOURHOOD_158 FROM prepared",
    "prepare": "SELECT * FROM prepared",
    "map_points": "SELECT * FROM points",
    "rename_for_display": "SELECT OCC_HOUR AS Hour, count(*) AS Collisions, "
                          "CAST(row_number() OVER (ORDER BY OCC_HOUR) AS INTEGER) AS position FROM prepared "
                          "WHERE OCC_HOUR IS NOT NULL GROUP BY OCC_HOUR",
    # --- filters
    "filter_dims": "SELECT EVENT_UNIQUE_ID, OCC_YEAR, OCC_HOUR, DIVISION FROM cleaned "
                   "WHERE OCC_YEAR IN (1996, 1997) AND OCC_HOUR IN (8, 17) AND DIVISION IN ('D11', 'D12', 'D20')",
    "filter_prepared": "SELECT EVENT_UNIQUE_ID, YEAR, DIVISION, NEIGHBOURHOOD_158 FROM prepared "
                       "WHERE YEAR IN (1998) AND DIVISION IN ('D11', 'D15', 'D22')",
    "filter_neighbourhood": "SELECT EVENT_UNIQUE_ID, NEIGHBOURHOOD_158 FROM prepared "
                            "WHERE NEIGHBOURHOOD_158 = 'BUILDING (7)'",
    "filter_severity": "SELECT EVENT_UNIQUE_ID, severity_class FROM prepared WHERE severity_class = 'Injury'",
    "filter_recent_days": f"SELECT EVENT_UNIQUE_ID, OCC_DATE_STR FROM ({_recent('prepared', 90)})",
    "filter_road_user": "SELECT EVENT_UNIQUE_ID, PEDESTRIAN, BICYCLE FROM prepared "
                        "WHERE PEDESTRIAN = 'YES' OR BICYCLE = 'YES'",
    "filter_chain": f"""SELECT EVENT_UNIQUE_ID, YEAR, severity_class, MOTORCYCLE, OCC_DATE_STR FROM (
        {_recent("(SELECT * FROM prepared WHERE YEAR IN (1997, 1998) AND severity_class = 'Property Damage' "
                 "AND MOTORCYCLE = 'YES')", 180)})""",
    "filter_classes": "SELECT EVENT_UNIQUE_ID, severity_class, CAST(CASE " + " ".join(
        f"WHEN severity_class = '{c}' THEN {i}" for i, c in enumerate(POINT_DRAW_ORDER, 1))
        + f" END AS INTEGER) AS draw_order FROM prepared WHERE severity_class IN ({q(POINT_DRAW_ORDER)})",
    "heatmap_classes": "SELECT EVENT_UNIQUE_ID, severity_class, CAST(CASE " + " ".join(
        f"WHEN severity_class = '{c}' THEN {i}" for i, c in enumerate(HEATMAP_CLASSES, 1))
        + f" END AS INTEGER) AS draw_order FROM prepared WHERE severity_class IN ({q(HEATMAP_CLASSES)})",
    "drop_missing_keys": "SELECT EVENT_UNIQUE_ID FROM prepared "
                         "WHERE NEIGHBOURHOOD_158 IS NOT NULL AND DIVISION IS NOT NULL",
    # --- aggregations
    "by_hour": _placed(_counts("prepared", "OCC_HOUR"), "collision_count DESC, OCC_HOUR"),
    "by_neighbourhood": _counts("prepared", "NEIGHBOURHOOD_158")
                        + " ORDER BY collision_count DESC, NEIGHBOURHOOD_158 ASC LIMIT 10",
    "by_division": _counts("prepared", "DIVISION") + " ORDER BY collision_count DESC, DIVISION ASC LIMIT 10",
    "severity_summary": _stack("prepared", [(c, f"severity_class = '{c}'")
                                            for c in ("Fatal", "Injury", "Property Damage")],
                               "severity_type", "value"),
    "by_day_of_week": _placed(
        f"""SELECT CASE WHEN OCC_DOW IN ({q(WEEKDAYS)}) THEN OCC_DOW END AS day_of_week,
        count(*) AS collision_count FROM prepared WHERE OCC_DOW IS NOT NULL GROUP BY OCC_DOW""",
        "CASE day_of_week WHEN 'Monday' THEN 1 WHEN 'Tuesday' THEN 2 WHEN 'Wednesday' THEN 3 "
        "WHEN 'Thursday' THEN 4 WHEN 'Friday' THEN 5 WHEN 'Saturday' THEN 6 WHEN 'Sunday' THEN 7 ELSE 8 END"),
    "by_month": f"""SELECT month, count(*) AS collision_count, {_month_name("month")} AS month_name
        FROM (SELECT TRY_CAST(trunc(CAST(MONTH AS DOUBLE)) AS INTEGER) AS month FROM prepared)
        WHERE month IS NOT NULL GROUP BY month""",
    "road_users": _stack("prepared", [(n, f"{c} = 'YES'") for n, c in _ROAD3], "road_user_type", "collision_count"),
    "road_users_normalized": _stack("cleaned", [(n, f"{flag(c)} = 'YES'") for n, c in _ROAD3],
                                    "road_user_type", "collision_count"),
    "road_users_truthy": _stack("prepared", [(n, f"{c} = 'YES'") for n, c in _ROAD3 + [("Automobile", "AUTOMOBILE")]],
                                "road_user_type", "collision_count"),
    "severity_trend": _trend_severity("prepared"),
    "severity_trend_injury": f"SELECT * FROM ({_trend_severity('prepared')}) WHERE severity_type = 'Injury'",
    "total_trend": _trend_total("prepared"),
    "grid_clusters": "SELECT lat_cluster AS LAT_WGS84, lon_cluster AS LONG_WGS84, severity_class, "
                     "count(*) AS collision_count FROM points GROUP BY 1, 2, 3",
    "kpis": """SELECT count(*) AS total_collisions,
        CAST(count_if(severity_class = 'Fatal') AS BIGINT) AS fatal,
        CAST(count_if(severity_class = 'Injury') AS BIGINT) AS injury,
        CAST(count_if(severity_class = 'Property Damage') AS BIGINT) AS property_damage,
        CAST(count_if(PEDESTRIAN = 'YES') AS BIGINT) AS pedestrian,
        CAST(count_if(BICYCLE = 'YES') AS BIGINT) AS bicycle,
        CAST(count_if(MOTORCYCLE = 'YES') AS BIGINT) AS motorcycle FROM prepared""",
    "peak_hour": _peak("prepared"),
    "distinct_options": """SELECT DISTINCT option, value FROM (
        SELECT 'year' AS option, CAST(CAST(YEAR AS BIGINT) AS VARCHAR) AS value FROM prepared
        UNION ALL SELECT 'division', DIVISION FROM prepared
        UNION ALL SELECT 'neighbourhood', NEIGHBOURHOOD_158 FROM prepared) WHERE value IS NOT NULL""",
    "default_year": "SELECT CAST(max(YEAR) AS BIGINT) AS default_year FROM prepared",
    "map_viewport": """SELECT round(avg(LAT_WGS84), 9) AS center_lat, round(avg(LONG_WGS84), 9) AS center_lon,
        max(LAT_WGS84) - min(LAT_WGS84) AS lat_range, max(LONG_WGS84) - min(LONG_WGS84) AS lon_range,
        count(*) AS points,
        greatest(max(LAT_WGS84) - min(LAT_WGS84), max(LONG_WGS84) - min(LONG_WGS84)) AS spread,
        CAST(CASE WHEN greatest(max(LAT_WGS84) - min(LAT_WGS84), max(LONG_WGS84) - min(LONG_WGS84)) IS NULL THEN NULL
             WHEN greatest(max(LAT_WGS84) - min(LAT_WGS84), max(LONG_WGS84) - min(LONG_WGS84)) < 0.01 THEN 16
             WHEN greatest(max(LAT_WGS84) - min(LAT_WGS84), max(LONG_WGS84) - min(LONG_WGS84)) < 0.05 THEN 15
             WHEN greatest(max(LAT_WGS84) - min(LAT_WGS84), max(LONG_WGS84) - min(LONG_WGS84)) < 0.1 THEN 14
             WHEN greatest(max(LAT_WGS84) - min(LAT_WGS84), max(LONG_WGS84) - min(LONG_WGS84)) < 0.5 THEN 13
             ELSE 12 END AS INTEGER) AS zoom
        FROM points""",
    "row_count": "SELECT count(*) AS row_count FROM prepared",
    # --- sort / limit / sample
    "top_n": _counts("prepared", "NEIGHBOURHOOD_158") + " ORDER BY collision_count DESC, NEIGHBOURHOOD_158 LIMIT 15",
    "multi_key_sort": _placed(_counts("prepared", "DIVISION"), "collision_count DESC, DIVISION"),
    "categorical_sort": _placed(
        _counts("prepared", "severity_class"),
        "CASE severity_class WHEN 'Fatal' THEN 1 WHEN 'Injury' THEN 2 WHEN 'Property Damage' THEN 3 ELSE 4 END"),
    "preview": "SELECT EVENT_UNIQUE_ID, OCC_DATE_STR, severity_class FROM prepared "
               "ORDER BY OCC_DATE DESC NULLS LAST, EVENT_UNIQUE_ID ASC LIMIT 10",
    "capped_sample": """SELECT * FROM points WHERE severity_class = 'Fatal'
        UNION ALL
        SELECT * EXCLUDE (rn) FROM (
          SELECT *, row_number() OVER (ORDER BY md5('42:' || EVENT_UNIQUE_ID), EVENT_UNIQUE_ID) AS rn
          FROM points WHERE coalesce(severity_class <> 'Fatal', true))
        WHERE rn <= greatest(6000 - (SELECT count(*) FROM points WHERE severity_class = 'Fatal'), 0)""",
    # --- set operations
    "concat_rows": "SELECT EVENT_UNIQUE_ID, severity_class FROM prepared WHERE severity_class = 'Fatal' "
                   "UNION ALL SELECT EVENT_UNIQUE_ID, severity_class FROM prepared WHERE severity_class = 'Injury'",
    "trend_overlay": f"""SELECT date, severity_type AS series_type, CAST(value AS DOUBLE) AS value
        FROM ({_trend_severity("prepared")})
        UNION ALL SELECT date, 'Total', CAST(value AS DOUBLE) FROM ({_trend_total("prepared")})
        UNION ALL SELECT date, series_type, value FROM ({_forecast("prepared", 30)})""",
    "forecast_trend": _forecast("prepared", 30),
    "distinct_values": "SELECT DISTINCT DIVISION FROM prepared WHERE DIVISION IS NOT NULL",
    # --- time series
    "densify_daily": f"""SELECT g.date AS date, CAST(coalesce(t.value, 0) AS BIGINT) AS value
        FROM (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date
              FROM ({_trend_total("prepared")})) g
        LEFT JOIN ({_trend_total("prepared")}) t ON g.date = t.date""",
    "densify_daily_by_severity": f"""SELECT g.severity_type, g.date, CAST(coalesce(t.value, 0) AS BIGINT) AS value
        FROM (SELECT severity_type, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date
              FROM ({_trend_severity("prepared")}) t0 GROUP BY severity_type) g
        LEFT JOIN ({_trend_severity("prepared")}) t ON g.severity_type = t.severity_type AND g.date = t.date""",
    "forecast_guard": f"""SELECT severity_type, count(date) AS observed_days, count(date) >= 30 AS enough_data,
        count(date) < 30 AS horizon_exceeds_data FROM ({_trend_severity("prepared")}) GROUP BY severity_type""",
    # --- reconcile
    "reconcile_paths": f"""SELECT coalesce(r.metric, p.metric) AS metric, coalesce(r.key, p.key) AS key,
        r.value IS NOT NULL AS in_raw, CAST(coalesce(r.value, 0) AS BIGINT) AS raw_value,
        p.value IS NOT NULL AS in_prepared, CAST(coalesce(p.value, 0) AS BIGINT) AS prepared_value,
        CAST(coalesce(p.value, 0) - coalesce(r.value, 0) AS BIGINT) AS difference
        FROM ({_metrics("cleaned", False)}) r FULL OUTER JOIN ({_metrics("prepared", True)}) p
        ON r.metric = p.metric AND r.key = p.key""",
}

_DIMS = ["YEAR", "DIVISION", "severity_class"]


def _subtotals(sets: str) -> str:
    flags = ", ".join(f"grouping({c}) = 1 AS all_{c}" for c in _DIMS)
    return (f"SELECT {', '.join(_DIMS)}, {flags}, CAST(grouping({', '.join(_DIMS)}) AS INTEGER) AS grouping_id, "
            f"count(*) AS collision_count FROM prepared GROUP BY {sets}")


def _haversine(lat_a: str, lon_a: str, lat_b: str, lon_b: str) -> str:
    return (f"12742000.0 * asin(sqrt(least(1.0, power(sin(radians({lat_b} - {lat_a}) * 0.5), 2) + cos(radians({lat_a})) "
            f"* cos(radians({lat_b})) * power(sin(radians({lon_b} - {lon_a}) * 0.5), 2))))")


_URGENT = ("SELECT 'EV-' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 5 = 0")
_COMPARED = ["EVENT_UNIQUE_ID", "OCC_HOUR", "DIVISION", "INJURY_COLLISIONS", "PEDESTRIAN"]

INCIDENT_SQL |= {
    "rename_weekday": f"SELECT day_of_week AS Day, collision_count AS Collisions, position FROM ({INCIDENT_SQL['by_day_of_week']})",
    "rename_month": f"SELECT month_name AS Month, collision_count AS Collisions FROM ({INCIDENT_SQL['by_month']})",
    # --- frames, time and space joins
    "rolling_means": f"""SELECT date, severity_type, value,
        round(avg(value) OVER week, 9) AS mean_7, count(value) OVER week AS days_7,
        round(avg(value) OVER month, 9) AS mean_28, count(value) OVER month AS days_28
      FROM ({_trend_severity("prepared")})
      WINDOW week AS (PARTITION BY severity_type ORDER BY date RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW),
             month AS (PARTITION BY severity_type ORDER BY date RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW)""",
    "same_day_last_year": f"""SELECT t.date, t.severity_type, t.value, CAST(l.value AS DOUBLE) AS last_year
      FROM ({_trend_severity("prepared")}) t LEFT JOIN ({_trend_severity("prepared")}) l
        ON l.severity_type = t.severity_type AND l.date = t.date - INTERVAL 12 MONTHS""",
    "rank_in_month": f"""SELECT *, CAST(date_trunc('month', date) AS TIMESTAMP) AS month, CAST(dense_rank() OVER (
        PARTITION BY severity_type, date_trunc('month', date) ORDER BY value DESC) AS INTEGER) AS rank_in_month
      FROM ({_trend_severity("prepared")})""",
    "interval_join": f"""SELECT EVENT_UNIQUE_ID, CAST(CAST(OCC_DATE AS DATE) AS TIMESTAMP) AS day, work_id
      FROM prepared p JOIN ({fixture_sql("works")}) w ON p.DIVISION = w.DIVISION
        AND CAST(OCC_DATE AS DATE) BETWEEN start_day AND end_day""",
    "interval_counts": f"""SELECT work_id, count(p.OCC_DATE) AS points, CAST(min(CAST(OCC_DATE AS DATE)) AS TIMESTAMP) AS first_day,
        CAST(max(CAST(OCC_DATE AS DATE)) AS TIMESTAMP) AS last_day
      FROM ({fixture_sql("works")}) w LEFT JOIN prepared p ON p.DIVISION = w.DIVISION
        AND CAST(OCC_DATE AS DATE) BETWEEN start_day AND end_day GROUP BY work_id""",
    "radius_counts": f"""SELECT site_id, count(m) AS points, round(min(m), 3) AS nearest_m
      FROM ({fixture_sql("sites")}) s LEFT JOIN (
        SELECT site_id AS near_id, {_haversine("lat", "lon", "LAT_WGS84", "LONG_WGS84")} AS m
        FROM ({fixture_sql("sites")}) x JOIN points p ON abs(p.LAT_WGS84 - x.lat) < 0.01
      ) d ON d.near_id = s.site_id AND m <= 400 GROUP BY site_id""",
    "bloom_semi_join": f"SELECT EVENT_UNIQUE_ID, DIVISION, severity_class FROM prepared WHERE EVENT_UNIQUE_ID IN ({_URGENT})",
    "bloom_anti_join": f"SELECT EVENT_UNIQUE_ID, DIVISION, severity_class FROM prepared WHERE EVENT_UNIQUE_ID NOT IN ({_URGENT})",
    # --- subtotals and multisets
    "cube_counts": _subtotals(f"CUBE ({', '.join(_DIMS)})"),
    "rollup_counts": _subtotals(f"ROLLUP ({', '.join(_DIMS)})"),
    "grouping_set_counts": _subtotals("GROUPING SETS ((YEAR, DIVISION), (severity_class), ())"),
    "multiset_compare": f"""SELECT {', '.join(_COMPARED)}, CAST(sum(a) AS BIGINT) AS first_rows,
        CAST(sum(b) AS BIGINT) AS second_rows, CAST(sum(a) - sum(b) AS BIGINT) AS surplus FROM (
        SELECT {', '.join(_COMPARED)}, 1 AS a, 0 AS b FROM cleaned
        UNION ALL SELECT {', '.join(_COMPARED)}, 0, 1 FROM prepared)
      GROUP BY ALL HAVING sum(a) <> sum(b)""",
    "multiset_intersect": """SELECT OCC_HOUR, DIVISION, PEDESTRIAN, count(*) AS common FROM (
        SELECT OCC_HOUR, DIVISION, PEDESTRIAN FROM cleaned
        INTERSECT ALL SELECT OCC_HOUR, DIVISION, PEDESTRIAN FROM prepared) GROUP BY ALL""",
}

# The first of three files moves the watermark to its latest time less two days; that is in force for late rows
# from the third file on: a row of it counts if its window ends after that.
_STREAM = """
WITH marks AS (SELECT max(ts) FILTER (event_id % 97 > 1) - INTERVAL 2 DAYS AS first, max(ts) - INTERVAL 2 DAYS AS last
               FROM events),
kept AS (SELECT w, w + INTERVAL {days} DAYS AS e, event_type
         FROM (SELECT event_id, event_type, unnest(generate_series(
                 date_trunc('day', ts) - INTERVAL {before} DAYS, date_trunc('day', ts), INTERVAL 1 DAY)) AS w FROM events), marks
         WHERE event_id % 97 <> 0 OR w + INTERVAL {days} DAYS > first)"""

EVENT_SQL = {
    "as_of_commits": f"""WITH c AS ({fixture_sql("commit_times")}),
      r AS (SELECT author, committed_at AS feature_at, commit_id AS feature_id FROM c WHERE event_type = 'click'),
      l AS (SELECT author, commit_id, committed_at FROM c WHERE event_type = 'error')
      SELECT l.author, l.commit_id, l.committed_at, r.feature_at AS matched_feature_at, CAST(r.feature_id AS DOUBLE) AS feature_id
      FROM l LEFT JOIN r ON r.author = l.author AND r.feature_at <= l.committed_at
      QUALIFY row_number() OVER (PARTITION BY l.commit_id ORDER BY r.feature_at DESC, r.feature_id DESC) = 1""",
    "sketch_weeks": f"""SELECT CAST(date_trunc('week', committed_at) AS TIMESTAMP) AS period, count(*) AS rows,
        count(DISTINCT author) AS authors, true AS authors_within_bound, true AS median_within_bound
      FROM ({fixture_sql("commit_times")}) GROUP BY 1""",
    "stream_windows": _STREAM.format(days=1, before=0) + """
      SELECT w AS window_start, e AS window_end, event_type, count(*) AS events,
             e <= (SELECT last FROM marks) AS closed FROM kept GROUP BY ALL""",
    "stream_sliding": _STREAM.format(days=2, before=1) + """
      SELECT w AS window_start, e AS window_end, count(*) AS events, e <= (SELECT last FROM marks) AS closed
      FROM kept GROUP BY ALL""",
    "stream_late_rows": _STREAM.format(days=1, before=0) + """
      SELECT (SELECT count(*) FROM events) AS input_rows, (SELECT count(*) FROM kept) AS counted_rows,
             (SELECT count(*) FROM events) - (SELECT count(*) FROM kept) AS late_rows""",
    "sessions": """SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 5 HOURS AS session_end, count(*) AS events
      FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nr FROM (
        SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 5 HOURS
                  THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, nr""",
}
EVENT_SQL["stream_sessions"] = (f"SELECT * FROM ({EVENT_SQL['sessions']}) "
                                "WHERE session_end <= (SELECT max(ts) - INTERVAL 2 DAYS FROM events)")

ACTIVITY_SQL = {
    "scan_activity_log": f"SELECT {strip('author')} AS author, CAST(day AS VARCHAR) AS date, "
                         f"{strip('subject')} AS subject FROM commits",
    "scan_pr_json": "SELECT CAST(number AS DOUBLE) AS number, title, state, login FROM prs",
    "scan_pr_json_array": "SELECT CAST(number AS DOUBLE) AS number, title, state, login FROM prs",
    "export_summary": "SELECT * FROM summary",
    "resolve_alias": "SELECT commit_id, member_id, member FROM resolved",
    "commits_by_member": "SELECT * FROM commit_member",
    "commits_per_day": "SELECT CAST(CAST(day AS DATE) AS TIMESTAMP) AS day, count(*) AS commits FROM resolved GROUP BY 1",
    "prs_by_author": "SELECT login, prs FROM pr_login",
    "roster_zero_fill": "SELECT m.member_id, m.member, CAST(coalesce(p.prs, 0) AS BIGINT) AS prs FROM members m "
                        "FULL OUTER JOIN pr_member p ON m.member_id = p.member_id AND m.member = p.member",
    "left_merge_counts": "SELECT c.member_id, c.member, c.commits, CAST(coalesce(p.prs, 0) AS BIGINT) AS prs "
                         "FROM commit_member c LEFT JOIN pr_member p "
                         "ON c.member_id = p.member_id AND c.member = p.member",
    "fold_numstat": "SELECT * FROM stats",
    "roster_stats": """SELECT m.member_id, m.member,
        CAST(coalesce(s.commits, 0) AS BIGINT) AS commits, CAST(coalesce(s.files_changed, 0) AS BIGINT) AS files_changed,
        CAST(coalesce(s.insertions, 0) AS BIGINT) AS insertions, CAST(coalesce(s.deletions, 0) AS BIGINT) AS deletions
        FROM members m LEFT JOIN member_stats s ON m.member_id = s.member_id AND m.member = s.member""",
    "contribution_summary": "SELECT * FROM summary",
    "commit_types": f"""SELECT CASE WHEN k <> '' THEN k ELSE 'other' END AS commit_type, count(*) AS commits
        FROM (SELECT lower({strip('subject')}) AS s,
                     coalesce(regexp_extract(lower({strip('subject')}),
                              '^(feat|fix|docs|test|chore|refactor|merge)[(:]', 1), '') AS k FROM commits)
        WHERE s IS NOT NULL AND s <> '' GROUP BY 1""",
    "pr_state_counts": """SELECT count(*) AS total_prs, CAST(count_if(upper(state) = 'MERGED') AS BIGINT) AS merged_prs,
        CAST(count_if(upper(state) = 'OPEN') AS BIGINT) AS open_prs FROM prs""",
}


def oracle_sql() -> dict[str, str]:
    out = {k: INCIDENT_BASE + v for k, v in INCIDENT_SQL.items()}
    out.update({k: ACTIVITY_BASE + v for k, v in ACTIVITY_SQL.items()})
    out.update(EVENT_SQL)
    return out

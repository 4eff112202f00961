"""Column contract and fixed vocabularies.

Fixed values: the lists below must keep these exact spellings and this order
for results to agree with the analyses they reproduce.
"""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

REQUIRED_COLUMNS = [
    "EVENT_UNIQUE_ID",
    "OCC_DATE",
    "OCC_YEAR",
    "OCC_HOUR",
    "DIVISION",
    "FATALITIES",
    "INJURY_COLLISIONS",
    "PD_COLLISIONS",
    "NEIGHBOURHOOD_158",
    "LONG_WGS84",
    "LAT_WGS84",
    "AUTOMOBILE",
    "MOTORCYCLE",
    "BICYCLE",
    "PEDESTRIAN",
]

# Neighbourhood texts that mean "unknown" (compared upper-cased).
PLACEHOLDER_NEIGHBOURHOODS = ["NSA", "", "UNKNOWN", "N/A", "NONE"]

NUMERIC_COLUMNS = ["OCC_YEAR", "OCC_HOUR", "LAT_WGS84", "LONG_WGS84"]

# YES / NO / N/R flag columns normalised during preparation.
FLAG_COLUMNS = ["INJURY_COLLISIONS", "PD_COLLISIONS", "PEDESTRIAN", "BICYCLE", "MOTORCYCLE"]

SEVERITY_CLASSES = ["Fatal", "Injury", "Property Damage"]
SEVERITY_OTHER = "Other"
ALL_SEVERITIES = "All Severities"
# Draw order for point maps (least severe first) and the heatmap subset.
POINT_DRAW_ORDER = ["Other", "Property Damage", "Injury", "Fatal"]
HEATMAP_CLASSES = ["Fatal", "Injury", "Property Damage"]

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

ROAD_USERS = [("Pedestrian", "PEDESTRIAN"), ("Bicycle", "BICYCLE"), ("Motorcycle", "MOTORCYCLE")]
ROAD_USERS_WITH_AUTOMOBILE = ROAD_USERS + [("Automobile", "AUTOMOBILE")]

# Columns kept for map points, in this order, when present.
MAP_COLUMNS = [
    "LAT_WGS84", "LONG_WGS84", "NEIGHBOURHOOD_158", "OCC_HOUR", "DIVISION",
    "FATALITIES", "OCC_DATE_STR", "severity_class", "lat_cluster", "lon_cluster",
]

# Map sampling: row cap and seed.
MAP_ROW_CAP = 6000
MAP_SAMPLE_SEED = 42

# Viewport zoom ladder: (spread upper bound, zoom); anything wider gets 12.
ZOOM_LADDER = [(0.01, 16), (0.05, 15), (0.1, 14), (0.5, 13)]
ZOOM_WIDEST = 12

# Minimum observed days before a forecast is attempted.
FORECAST_MIN_DAYS = 30

# Commit subject types, in match order; unmatched non-blank subjects are "other".
COMMIT_TYPES = ["feat", "fix", "docs", "test", "chore", "refactor", "merge"]

# Contribution status labels: with commits or PRs, and without.
STATUS_ACTIVE = "Active contributor"
STATUS_INACTIVE = "No contributions yet"

# Empty peak-hour labels: validation report, dashboard.
PEAK_HOUR_NONE_REPORT = "N/A"
PEAK_HOUR_NONE_DASHBOARD = "-"

# Text tokens that the common CSV reader treats as missing by default.
CSV_NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Timestamp layouts tried in order when coercing OCC_DATE (Spark patterns),
# each with the text shape it can possibly parse. The shapes do not overlap,
# so at most one parse is attempted per value. Single-letter fields accept one
# or two digits ("2017-5-2" as well as "2017-05-02").
TIMESTAMP_FORMATS = [
    ("yyyy-M-d[ ]['T']H:m[:s][.SSSSSSSSS]", r"^[0-9]+-[0-9]+-[0-9]+[ T][0-9]+:[0-9]+(?::[0-9]+(?:\.[0-9]{1,9})?)?$"),
    ("yyyy-M[-d]", r"^[0-9]+-[0-9]+(?:-[0-9]+)?$"),
    ("yyyy/M/d[ H:m[:s]]", r"^[0-9]{4}/[0-9]+/[0-9]+(?: [0-9]+:[0-9]+(?::[0-9]+)?)?$"),
    ("M/d/yyyy[ h:m[:s] a]", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]+(?: [0-9]+:[0-9]+(?::[0-9]+)? [AaPp][Mm])?$"),
    ("M/d/yyyy H:m[:s]", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]+:[0-9]+(?::[0-9]+)?$"),
    ("yyyyMMdd", r"^[0-9]{8}$"),
    ("MMM d, yyyy", r"^(?:[0-9]{1,2} )?[A-Z][a-z]{2,8} (?:[0-9]{1,2}, )?[0-9]{4}$"),
]

# Dates with the month's name: "15 Jan 2024" and "January 15, 2024" are written as "Jan 15, 2024".
NAMED_MONTH_LAYOUT = "MMM d, yyyy"
NAMED_MONTH_PATTERN = (
    r"^(?:([0-9]{1,2}) )?(" + "|".join(m[:3] for m in MONTH_NAMES) + r")(?:"
    + "|".join(f"(?<={m[:3]}){m[3:]}" for m in MONTH_NAMES if m[3:]) + r")?(?: ([0-9]{1,2}),)? ([0-9]{4})$")
NAMED_MONTH_ORDER = "$2 $1$3, $4"

# A trailing zone (Z, +hh, +hhmm, +hh:mm) after a time of day. The rest is
# parsed by the layouts above and moved to UTC by the offset.
ZONE_PATTERN = r"^(.*[0-9]:[0-9]+(?::[0-9.]+)?) ?(Z|[+-][0-9]{2}(?::?[0-9]{2})?)$"

# --- end of fixed values ----------------------------------------------------


def missing_columns(columns, required) -> list[str]:
    """Required names absent from ``columns``, in declared order."""
    present = set(columns)
    return [c for c in required if c not in present]


def require_columns(df, required) -> None:
    """Raise ``ValueError`` naming every missing column (driver-side, no job)."""
    missing = missing_columns(df.columns, required)
    if missing:
        raise ValueError(f"Missing required columns: {missing}")

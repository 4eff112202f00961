"""crashgrid: incident analytics on Spark DataFrames.

Raw incident tables (CSV or Parquet) are checked against a column contract,
cleaned, enriched with severity / calendar / grid-cell columns and written as
a prepared Parquet dataset. Every analysis is a lazy DataFrame transform that
Catalyst plans; nothing is collected to the driver inside an operator.

Main entry points::

    from crashgrid import get_spark, load_dataset, prepare_dataset, get_prepared_data
    from crashgrid import DashboardParams, dashboard_view, release
"""

__version__ = "0.1.0"

from .operators.filters import DashboardParams  # noqa: E402
from .plans.dashboard import dashboard_view, default_params, export_view, release  # noqa: E402
from .plans.prepare import prepare_dataset, prepare_frame  # noqa: E402
from .session import get_spark  # noqa: E402
from .sources.csv import load_dataset  # noqa: E402
from .sources.parquet import get_prepared_data, write_prepared  # noqa: E402

__all__ = [
    "DashboardParams", "dashboard_view", "default_params", "export_view", "release",
    "prepare_dataset", "prepare_frame", "get_spark", "load_dataset", "get_prepared_data", "write_prepared",
]

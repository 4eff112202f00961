"""Input tables derived from the shared TPC-H-style test tables.

No incident CSV ships with the test data, so a raw incident table (all text,
with dirt: bad dates, text hours, placeholder neighbourhoods, zero
coordinates, padded flags, exact duplicates) is derived from
``orders JOIN customer``; the activity-log tables come from ``events``,
``orders`` and ``customer``. Each SQL text runs unchanged in Spark
(``{name}`` bound to a DataFrame) and in DuckDB (``{name}`` -> view name),
so the oracle and the engine read identical inputs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

RAW_INCIDENTS_SQL = """
with base as (
 select concat('EV-', cast(o_orderkey as string)) as EVENT_UNIQUE_ID,
  case when o_orderkey % 101 = 0 then 'not-a-date'
       when o_orderkey % 103 = 0 then null
       else cast(cast(o_orderdate as date) as string) end as OCC_DATE,
  cast(year(o_orderdate) as string) as OCC_YEAR,
  case when o_orderkey % 53 = 0 then null
       when o_orderkey % 59 = 0 then 'N/A'
       else cast((o_orderkey * o_custkey) % 24 as string) end as OCC_HOUR,
  case when o_orderkey % 61 = 0 then null else
   case (o_orderkey + o_custkey) % 7 when 0 then 'Monday' when 1 then 'Tuesday'
     when 2 then 'Wednesday' when 3 then 'Thursday' when 4 then 'Friday'
     when 5 then 'Saturday' else 'Sunday' end end as OCC_DOW,
  case when o_orderkey % 67 = 0 then null
       else concat('D', cast(11 + c_nationkey as string)) end as DIVISION,
  case when o_orderkey % 89 = 0 then '1' when o_orderkey % 83 = 0 then null
       when o_orderkey % 79 = 0 then 'x' else '0' end as FATALITIES,
  case when o_orderpriority = '1-URGENT' then ' yes ' else 'NO' end as INJURY_COLLISIONS,
  case when o_orderpriority = '5-LOW' then 'N/R' else 'YES' end as PD_COLLISIONS,
  case when o_orderkey % 29 = 0 then 'NSA' when o_orderkey % 31 = 0 then ' unknown '
       when o_orderkey % 37 = 0 then '' when o_orderkey % 41 = 0 then null
       when o_orderkey % 47 = 0 then concat('Old ', chr(34), 'Mill', chr(34), ', East', chr(92), 'West')
       else concat(c_mktsegment, ' (', cast(o_custkey % 30 as string), ')') end as NEIGHBOURHOOD_158,
  case when o_orderkey % 71 = 0 then '0'
       else concat('-79.', cast(200000 + (o_custkey * 104729) % 300000 as string)) end as LONG_WGS84,
  case when o_orderkey % 71 = 0 then '0' when o_orderkey % 73 = 0 then ''
       else concat('43.', cast(600000 + (o_orderkey * 7919) % 200000 as string)) end as LAT_WGS84,
  'YES' as AUTOMOBILE,
  case when o_orderkey % 17 = 0 then 'YES' else 'NO' end as MOTORCYCLE,
  case when o_orderkey % 13 = 0 then 'yes' else 'N/R' end as BICYCLE,
  case when o_orderkey % 11 = 0 then ' YES' else 'NO' end as PEDESTRIAN
 from {orders} join {customer} on o_custkey = c_custkey)
select * from base
union all
select * from base where cast(substr(EVENT_UNIQUE_ID, 4) as bigint) % 97 = 0
"""

# Roster: every customer is a member known by three aliases; a few have no public handle.
ALIAS_SQL = """
select member_id, member, alias,
  case when member_id % 19 <> 0 then concat('user_', cast(member_id as string)) end as github
from (
select c_custkey as member_id, c_name as member, lower(trim(c_name)) as alias from {customer}
union all
select c_custkey, c_name, concat('user_', cast(c_custkey as string)) from {customer}
union all
select c_custkey, c_name, concat('u', cast(c_custkey as string)) from {customer}) known
"""

COMMITS_SQL = """
select event_id as commit_id, cast(ts as date) as day,
  case user_id % 3 when 0 then concat(' USER_', cast(user_id as string), ' ')
                   when 1 then concat('U', cast(user_id as string))
                   else concat('user_', cast(user_id as string)) end as author,
  case event_type when 'click' then 'feat(ui): change' when 'view' then 'docs: change'
                  when 'error' then 'Fix(core): change' when 'signup' then 'plain words'
                  else '' end as subject
from {events}
"""

NUMSTAT_SQL = """
select user_id % 4 as repo, event_id * 3 as line_no,
       concat('user_', cast(user_id as string)) as txt from {events}
union all
select user_id % 4, event_id * 3 + 1,
       concat(cast(event_id % 50 as string), chr(9), cast(event_id % 7 as string), chr(9), 'a.py')
  from {events}
union all
select user_id % 4, event_id * 3 + 2, concat('-', chr(9), '-', chr(9), 'b.png')
  from {events} where event_id % 5 = 0
"""

PRS_SQL = """
select case when o_orderkey % 43 <> 0 then o_orderkey end as number,
  case when o_orderkey % 43 <> 0 then concat('PR ', cast(o_orderkey as string)) end as title,
  case when o_orderkey % 43 = 0 then null
       when o_orderstatus = 'F' then 'MERGED' when o_orderstatus = 'O' then 'OPEN' else 'CLOSED' end as state,
  concat('User_', cast(o_custkey as string)) as login
from {orders}
"""

# Road works per division: day ranges, a few of them very long.
WORKS_SQL = """
select o_orderkey as work_id, concat('D', cast(11 + o_custkey % 25 as string)) as DIVISION,
  cast(o_orderdate as date) as start_day,
  cast(o_orderdate as date) + cast(case when o_orderkey % 400 = 0 then 900 else o_custkey % 40 end as int) as end_day
from {orders} where o_orderkey % 20 = 0
"""

# Places to look around; some share their coordinates.
SITES_SQL = """
select s_suppkey as site_id,
  cast(43.6 as double) + cast((s_suppkey * 7919) % 200000 as double) / 1000000 as lat,
  cast(-79.2 as double) - cast((s_suppkey * 104729) % 300000 as double) / 1000000 as lon
from {supplier}
union all
select -1 - s_suppkey, cast(43.7 as double), cast(-79.35 as double) from {supplier} where s_suppkey % 10 = 0
"""

# Commits with their time; one author in three days of heavy work is a hot key.
COMMIT_TIMES_SQL = """
select event_id as commit_id, ts as committed_at, user_id, event_type,
  case when event_id % 3 = 0 then 'user_0' else concat('user_', cast(user_id as string)) end as author
from {events}
"""

FIXTURES = {
    "raw_incidents": (RAW_INCIDENTS_SQL, ("orders", "customer")),
    "aliases": (ALIAS_SQL, ("customer",)),
    "commits": (COMMITS_SQL, ("events",)),
    "numstat": (NUMSTAT_SQL, ("events",)),
    "prs": (PRS_SQL, ("orders",)),
    "works": (WORKS_SQL, ("orders",)),
    "sites": (SITES_SQL, ("supplier",)),
    "commit_times": (COMMIT_TIMES_SQL, ("events",)),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared test tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build a derived input table lazily from the shared tables."""
    sql, inputs = FIXTURES[name]
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in inputs})


def fixture_sql(name: str) -> str:
    """The same fixture text for an engine where the inputs are views."""
    sql, inputs = FIXTURES[name]
    for t in inputs:
        sql = sql.replace("{" + t + "}", t)
    return sql


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "raw_incidents")

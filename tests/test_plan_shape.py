"""Plan properties the design relies on at scale."""

import re

from crashgrid.operators import aggregates as A
from crashgrid.operators.cleaning import quality_report
from crashgrid.plans.prepare import prepare_frame
from crashgrid.sources.fixtures import raw_incidents
from data_paths import SF_SMALL
from plan_util import plan_text


def test_aggregates_combine_before_the_shuffle(spark):
    p = prepare_frame(raw_incidents(spark, SF_SMALL))
    for df in (A.collisions_by_hour(p), A.collisions_by_neighbourhood(p), A.kpis(p), quality_report(p)):
        text = plan_text(df)
        assert "partial_count" in text or "partial_sum" in text


def test_preparation_stays_in_the_jvm(spark):
    text = plan_text(prepare_frame(raw_incidents(spark, SF_SMALL)))
    for python_node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert python_node not in text
    tree = text.split("\n\n\n")[0]
    shuffles = re.findall(r"(?<!Broadcast)Exchange \(\d+\)", tree)
    assert len(shuffles) == 1   # the dedupe is the only shuffle


def test_hot_key_counts_are_exact(spark):
    rows = [(1.0,)] * 3000 + [(float(h),) for h in range(24) for _ in range(10)]
    df = spark.createDataFrame(rows, "OCC_HOUR double").repartition(16)
    out = {r[0]: r[1] for r in A.collisions_by_hour(df).collect()}
    assert out[1.0] == 3010 and sum(out.values()) == 3240


def test_commit_counts_aggregate_per_author_before_the_roster_join(spark):
    from crashgrid.operators.activity import commits_by_member, commits_per_day
    from crashgrid.sources.fixtures import fixture
    commits, aliases = fixture(spark, SF_SMALL, "commits"), fixture(spark, SF_SMALL, "aliases")
    for df in (commits_by_member(commits, aliases), commits_per_day(commits, aliases)):
        lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
        join = next(i for i, line in enumerate(lines) if "Join Inner" in line and "_key" in line)
        # the commit side of the join is already one row per author key (and day)
        assert re.search(r"Aggregate \[_key#\d+", lines[join + 1]), lines[join:join + 2]

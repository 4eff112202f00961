import json
import random

import pytest
from crashgrid.plans.prepare import prepare_dataset
from crashgrid.schema import REQUIRED_COLUMNS
from crashgrid.sources.activity import parse_commit_lines, parse_pr_json, scan_pr_json
from crashgrid.sources.csv import load_dataset
from crashgrid.sources.export import export_results, export_summary
from crashgrid.sources.parquet import get_prepared_data, write_prepared
from plan_util import plan_text


def text_rows(n, seed=1):
    """Rows with every kind of awkward text: quotes, commas, backslashes, blanks around."""
    draw = random.Random(seed)
    pieces = ['say "hi", x', "back\\\\slash", "a,b", " kept ", "ünï", "'q'", "semi;colon"]
    return [{c: draw.choice(pieces) + str(i) for c in REQUIRED_COLUMNS} for i in range(n)]


def write_csv(path, rows, columns=REQUIRED_COLUMNS, encoding="utf-8"):
    quote = lambda v: '"' + v.replace('"', '""') + '"' if any(x in v for x in ',"\n') else v
    lines = [",".join(columns)] + [",".join(quote(r[c]) for c in columns) for r in rows]
    path.write_text("\n".join(lines) + "\n", encoding=encoding)
    return str(path)


def test_every_text_survives_reading_and_our_own_writer(spark, tmp_path):
    rows = text_rows(60)
    read = load_dataset(spark, write_csv(tmp_path / "in.csv", rows))
    key = lambda r: r[REQUIRED_COLUMNS[0]] + r[REQUIRED_COLUMNS[-1]]
    assert sorted((r.asDict() for r in read.collect()), key=key) == sorted(rows, key=key)
    again = load_dataset(spark, export_results(read, str(tmp_path / "out")))
    assert sorted(again.collect()) == sorted(read.collect())


def test_missing_tokens_become_null_and_nothing_else(spark, tmp_path):
    rows = [dict.fromkeys(REQUIRED_COLUMNS, v) for v in ("N/A", "", "NULL", "none yet", "NSA")]
    got = [r[REQUIRED_COLUMNS[1]] for r in load_dataset(spark, write_csv(tmp_path / "n.csv", rows)).collect()]
    assert sorted(got, key=str) == [None, None, None, "NSA", "none yet"] or sorted(map(str, got)) == sorted(
        ["None", "None", "None", "none yet", "NSA"])


def test_a_file_with_another_column_order_is_refused(spark, tmp_path):
    rows = text_rows(3)
    write_csv(tmp_path / "a.csv", rows)
    write_csv(tmp_path / "b.csv", rows, REQUIRED_COLUMNS[::-1])
    with pytest.raises(Exception, match="(?i)header"):
        load_dataset(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("job", [load_dataset, lambda s, p: prepare_dataset(s, p, p + "-out")])
def test_absent_paths_and_columns(spark, tmp_path, job):
    with pytest.raises(FileNotFoundError, match="nowhere"):
        job(spark, str(tmp_path / "nowhere.csv"))
    short = list(REQUIRED_COLUMNS)[:-2]
    with pytest.raises(ValueError, match=REQUIRED_COLUMNS[-1]):
        job(spark, write_csv(tmp_path / "short.csv", text_rows(2), short))


def test_preparation_takes_globs_and_leaves_the_session_as_it_was(spark, tmp_path):
    for name, seed in (("p1.csv", 1), ("p2.csv", 2)):
        write_csv(tmp_path / name, [dict(r, LAT_WGS84="1.5", LONG_WGS84="2.5") for r in text_rows(2, seed)])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    out = prepare_dataset(spark, str(tmp_path / "p*.csv"), str(tmp_path / "out"), shuffle_partitions=3)
    assert spark.read.parquet(out).count() == 4
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_line_breaks_in_values_and_byte_order_marks(spark, tmp_path):
    row = dict(text_rows(1)[0], DIVISION="two\nlines")
    read = load_dataset(spark, write_csv(tmp_path / "m.csv", [row], encoding="utf-8-sig"), multiline=True)
    assert read.columns == list(REQUIRED_COLUMNS) and read.first()["DIVISION"] == "two\nlines"


def test_prepared_files_follow_the_data_not_the_tasks(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id", "cast(2000 + id % 3 as double) YEAR", "cast(id as string) OCC_DATE_STR")
    path = tmp_path / "prepared"
    write_prepared(rows.repartition(16), str(path))
    assert len(list(path.rglob("part-*.parquet"))) <= 6
    back = get_prepared_data(spark, str(path))
    assert sorted(r["id"] for r in back.where("YEAR = 2001").collect()) == list(range(1, 4000, 3))
    assert "PartitionFilters: [isnotnull(YEAR" in plan_text(back.filter("YEAR = 2001"))


def test_summary_is_written_by_many_tasks_unless_one_file_is_asked_for(spark, tmp_path):
    rows = spark.range(100).repartition(4)
    export_summary(rows, str(tmp_path / "many"))
    export_summary(rows, str(tmp_path / "one"), single_file=True)
    assert len(list((tmp_path / "many").glob("part-*"))) == 4 and len(list((tmp_path / "one").glob("part-*"))) == 1


def test_commit_lines(spark):
    lines = ["Zoë|2019-03-04|fix: a|b|c", " Ulf | 2019 | s ", "one|two", "", "no bars"]
    got = parse_commit_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted(map(tuple, got)) == sorted([("Zoë", "2019-03-04", "fix: a|b|c"), ("Ulf", "2019", "s")])


PULLS = [{"number": 7, "title": "x", "state": "OPEN", "author": {"login": "kim"}}, {"author": {"login": "only-author"}},
         {"number": 9, "author": None}]
WANT = sorted([(7, "x", "OPEN", "kim"), (None, None, None, "only-author"), (9, None, None, None)], key=str)


def test_pull_requests_may_lack_any_field(spark, tmp_path):
    lines = [*map(json.dumps, PULLS), "{broken", "", "17"]
    got = parse_pr_json(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted(map(tuple, got), key=str) == WANT
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps(PULLS[:2], indent=2))
    (tmp_path / "one" / "b.json").write_text(json.dumps(PULLS[2:]))
    got = scan_pr_json(spark, str(tmp_path / "one"), json_array=True).collect()
    assert sorted(map(tuple, got), key=str) == WANT
    (tmp_path / "many.json").write_text(json.dumps(PULLS[:1]) + "\n" + json.dumps(PULLS[1:]) + "\n")
    got = scan_pr_json(spark, str(tmp_path / "many.json"), json_array=True, multiline=False).collect()
    assert sorted(map(tuple, got), key=str) == WANT

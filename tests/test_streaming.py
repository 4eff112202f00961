import datetime as dt
import random

from pyspark.sql import functions as F

from crashgrid.session import scratch_path
from crashgrid.streaming.sessions import replay_sessions, sessions
from crashgrid.streaming.windows import file_stream, late_rows, replay_windows, window_counts

START = dt.datetime(2024, 3, 1)


def events(spark, rows):
    return spark.createDataFrame([(k, None if h is None else START + dt.timedelta(hours=h)) for k, h in rows],
                                 "kind string, ts timestamp")


def stream(spark, batches):
    path = scratch_path(spark, "test-stream")
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(path)
    return file_stream(spark, path, events(spark, []).schema)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_replay_equals_the_batch_result_and_marks_closed_windows(spark):
    rng = random.Random(5)
    rows = sorted(((rng.choice("abc"), rng.randrange(240)) for _ in range(400)), key=lambda r: r[1])
    parts = [rows[s:s + 100] for s in range(0, 400, 100)]
    for window, slide in (("1 day", None), ("2 days", "1 day")):
        replayed = replay_windows(stream(spark, parts), "ts", window, slide, "1 day", ["kind"])
        columns = ["window_start", "window_end", "kind", "events"]
        assert as_set(replayed, *columns) == as_set(window_counts(events(spark, rows), "ts", window, slide, keys=["kind"]), *columns)
        mark = START + dt.timedelta(hours=max(h for _, h in rows) - 24)
        assert all(r["closed"] == (r["window_end"] <= mark) for r in replayed.collect())


def test_late_rows_are_left_out_and_counted(spark):
    parts = [[("a", 100), ("a", 1)], [("a", 101)], [("a", 2), ("a", 99)]]  # 2 comes when day one is long closed
    replayed = replay_windows(stream(spark, parts), "ts", "1 day", delay="1 day", keys=["kind"])
    assert {(r["window_start"], r["events"]) for r in replayed.collect()} == {
        (START, 1), (START + dt.timedelta(days=4), 3)}
    everything = events(spark, [r for p in parts for r in p])
    assert late_rows(replayed, everything).first().asDict() == {"input_rows": 5, "counted_rows": 4, "late_rows": 1}


def test_rows_without_time_belong_to_no_window(spark):
    replayed = replay_windows(stream(spark, [[("a", None), (None, 3)]]), "ts", "1 day", keys=["kind"])
    assert [(r["kind"], r["events"]) for r in replayed.collect()] == [(None, 1)]


def plain_sessions(rows, gap):
    out = {}
    for k in {k for k, _ in rows}:
        times = sorted(h for q, h in rows if q == k and h is not None)
        run = []
        for h in times:
            if run and h - run[-1] > gap:
                out[k, run[0], run[-1] + gap] = len(run)
                run = []
            run.append(h)
        if run:
            out[k, run[0], run[-1] + gap] = len(run)
    return {(k, START + dt.timedelta(hours=s), START + dt.timedelta(hours=e), n) for (k, s, e), n in out.items()}


def test_sessions_equal_brute_force_also_as_a_stream(spark):
    rng = random.Random(6)
    rows = sorted(((rng.choice(["hot"] * 5 + ["a", None]), rng.randrange(500)) for _ in range(200)), key=lambda r: r[1])
    rows = list(dict.fromkeys(rows)) + [("a", None)]
    want = plain_sessions(rows, 5)
    columns = ["kind", "session_start", "session_end", "events"]
    assert as_set(sessions(events(spark, rows), "ts", ["kind"], "5 hours"), *columns) == want
    timed = [r for r in rows if r[1] is not None]
    replayed = replay_sessions(stream(spark, [timed[:70], timed[70:140], timed[140:]]), "ts", ["kind"], "5 hours", "10 hours")
    mark = START + dt.timedelta(hours=max(h for _, h in timed) - 10)
    assert as_set(replayed, *columns) == {s for s in want if s[2] <= mark}
    assert sessions(events(spark, []), "ts", ["kind"], "5 hours").count() == 0
    assert sessions(events(spark, []), "ts", ["kind"], "5 hours").filter(F.col("events") > 0).isEmpty()


def test_the_session_query_reads_files_of_bounded_rows_in_one_batch(spark, tmp_path, monkeypatch):
    from crashgrid.plans import catalog
    rng = random.Random(7)
    rows = [(i, START + dt.timedelta(minutes=rng.randrange(20_000)), "view", rng.randrange(9)) for i in range(970)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, user_id long") \
        .write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr(catalog, "SESSION_FILE_ROWS", 50)
    taken, kept = [], catalog.SW.file_stream
    monkeypatch.setattr(catalog.SW, "file_stream", lambda s, path, *a, **k: taken.append(path) or kept(s, path, *a, **k))
    found = catalog.q_stream_sessions(spark, str(tmp_path))
    files = spark.read.parquet(taken[0]).groupBy(F.input_file_name().alias("f")).count()
    assert files.agg(F.max("count")).first()[0] <= 50 and files.count() >= 970 / 50
    columns = ["user_id", "session_start", "session_end", "events"]
    mark = max(t for _, t, _, _ in rows) - dt.timedelta(days=2)
    want = sessions(spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, user_id long"), "ts",
                    ["user_id"], "5 hours")
    assert as_set(found, *columns) == {s for s in as_set(want, *columns) if s[2] <= mark}

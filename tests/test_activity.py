from collections import defaultdict

from crashgrid.operators.activity import (alias_lookup, commit_types, contribution_summary, fold_numstat,
                                          left_merge_counts, pr_state_counts, resolve_alias, roster_zero_fill)


def brute_fold(lines):
    """Plain sequential fold over (repo, line_no, txt), the baseline to compare with."""
    stats = defaultdict(lambda: [0, 0, 0, 0])
    by_repo = defaultdict(list)
    for repo, n, txt in lines:
        by_repo[repo].append((n, txt))
    for repo in by_repo:
        author = None
        for _, raw in sorted(by_repo[repo]):
            line = raw.strip()
            if not line:
                continue
            parts = line.split("\t")
            if len(parts) == 3 and author:
                if parts[0].isdigit():
                    stats[author][1] += int(parts[0])
                if parts[1].isdigit():
                    stats[author][2] += int(parts[1])
                stats[author][3] += 1
            else:
                author = line
                stats[author][0] += 1
    return {k: tuple(v) for k, v in stats.items()}


def test_fold_numstat_matches_sequential_fold_across_chunks(spark):
    import random
    rnd = random.Random(3)
    lines = []
    for repo in range(3):
        n = 0
        # a stat-looking first line becomes an author line
        lines.append((repo, n, "1\t2\tx.py")); n += 1
        for _ in range(60):
            lines.append((repo, n, rnd.choice(["ann", "Bob", " carol "]))); n += 1
            for _ in range(rnd.randint(0, 4)):
                add = rnd.choice(["3", "-", "10"])
                lines.append((repo, n, f"{add}\t{rnd.randint(0, 5)}\tf.py")); n += 1
            if rnd.random() < 0.2:
                lines.append((repo, n, "   ")); n += 1
    df = spark.createDataFrame(lines, "repo int, line_no bigint, txt string")
    expected = brute_fold(lines)
    for chunk in (7, 50, 1 << 20):
        got = {r["name"]: (r["commits"], r["insertions"], r["deletions"], r["files_changed"])
               for r in fold_numstat(df, chunk_lines=chunk).collect()}
        assert got == expected, chunk


def aliases(spark):
    return spark.createDataFrame([
        (1, "Ann Lee", "Ann Lee"), (1, "Ann Lee", "annl"), (2, "Bo Ray", "Bo Ray"), (2, "Bo Ray", "bo"),
        (3, "Cy Doe", "Cy Doe"), (3, "Cy Doe", "annl"),   # clash: the later member wins
    ], "member_id int, member string, alias string")


def test_alias_lookup_last_wins_and_resolution_drops_unknown(spark):
    look = {r["alias_key"]: r["member"] for r in alias_lookup(aliases(spark)).collect()}
    assert look["annl"] == "Cy Doe"
    commits = spark.createDataFrame([(" ANN LEE ",), ("BO",), ("github-actions",)], "author string")
    got = sorted(r["member"] for r in resolve_alias(commits, aliases(spark)).collect())
    assert got == ["Ann Lee", "Bo Ray"]


def test_zero_fill_and_merge(spark):
    al = aliases(spark)
    counts = spark.createDataFrame([(1, "Ann Lee", 4)], "member_id int, member string, prs bigint")
    rows = roster_zero_fill(counts, al, ["prs"]).collect()
    assert [(r["member"], r["prs"]) for r in rows] == [("Ann Lee", 4), ("Bo Ray", 0), ("Cy Doe", 0)]
    commits = spark.createDataFrame([("bo",), ("Bo Ray",), ("ann lee",)], "author string")
    prs = spark.createDataFrame([(1, "t", "OPEN", "ANN LEE")], "number bigint, title string, state string, login string")
    rows = left_merge_counts(commits, prs, al).collect()
    assert [(r["member"], r["commits"], r["prs"]) for r in rows] == [
        ("Bo Ray", 2, 0), ("Ann Lee", 1, 1), ("Cy Doe", 0, 0)]


def test_contribution_summary_status_and_any_alias_prs(spark):
    al = aliases(spark)
    numstat = spark.createDataFrame([(0, 0, "bo"), (0, 1, "5\t1\ta.py")], "repo int, line_no bigint, txt string")
    prs = spark.createDataFrame([(1, "t", "MERGED", "annl"), (2, "t", "OPEN", "nobody")],
                                "number bigint, title string, state string, login string")
    rows = {r["member"]: r for r in contribution_summary(numstat, prs, al).collect()}
    assert rows["Bo Ray"]["commits"] == 1 and rows["Bo Ray"]["insertions"] == 5
    assert rows["Bo Ray"]["status"] == "Active contributor"
    # a login counts for every member that lists it among its aliases
    assert rows["Ann Lee"]["prs"] == 1 and rows["Cy Doe"]["prs"] == 1
    st = pr_state_counts(prs).first()
    assert (st["total_prs"], st["merged_prs"], st["open_prs"]) == (2, 1, 1)


def test_commit_types(spark):
    df = spark.createDataFrame([("feat(ui): x",), ("Fix: y",), ("fixup z",), ("",), ("  ",), ("merge: m",)],
                               "subject string")
    got = {r[0]: r[1] for r in commit_types(df).collect()}
    assert got == {"feat": 1, "fix": 1, "other": 1, "merge": 1}


def test_commit_counts_with_a_hot_author_match_per_row_resolution(frame):
    """One author writes a third of the commits; counting per author before the
    roster join must equal resolving every row and counting afterwards."""
    from crashgrid.operators.activity import commits_by_member, commits_per_day
    import datetime as dt
    authors = [" Ann " if i % 3 == 0 else ("bob" if i % 3 == 1 else f"x{i % 7}") for i in range(300)]
    days = [dt.date(2024, 1, 1 + i % 5) if i % 11 else None for i in range(300)]
    commits = frame({"author": authors, "day": days}, "author string, day date")
    al = frame({"member_id": [1, 1, 2, 3], "member": ["Ann", "Ann", "Bob", "Cy"],
                "alias": ["ann", "ANN2", "Bob ", "cy"]}, "member_id int, member string, alias string")
    resolved = resolve_alias(commits, al).collect()
    want_member = defaultdict(int)
    want_day = defaultdict(int)
    for r in resolved:
        want_member[r["member"]] += 1
        if r["day"] is not None:
            want_day[r["day"]] += 1
    got = {r["member"]: r["commits"] for r in commits_by_member(commits, al).collect()}
    assert got == {"Ann": want_member["Ann"], "Bob": want_member["Bob"], "Cy": 0}
    assert got["Ann"] == 100
    per_day = {r["day"].date(): r["commits"] for r in commits_per_day(commits, al).collect()}
    assert per_day == dict(want_day)


def test_hot_author_is_dealt_into_parts(spark):
    aliases = spark.createDataFrame([(1, "Ann", "ann"), (2, "Bob", "bob")], "member_id long, member string, alias string")
    rows = [("Ann ", i) for i in range(500)] + [("BOB", i) for i in range(5)] + [("who", 1), (None, 2)]
    commits = spark.createDataFrame(rows, "author string, n int")
    for hot_rows in (7, 1_000_000):
        got = resolve_alias(commits, aliases, hot_rows=hot_rows)
        assert got.columns == ["author", "n", "member_id", "member"]
        assert sorted((r["member"], r["n"]) for r in got.collect()) == sorted(
            [("Ann", i) for i in range(500)] + [("Bob", i) for i in range(5)])

"""Contribution statistics over commit and pull-request logs.

Inputs are tables: commit headers (author, date/day, subject), numstat log
lines (repo, line_no, txt), pull requests (number, title, state, login) and
a roster of aliases (member_id, member, alias). Joins against the roster are
plain equi-joins; Spark broadcasts the roster only when its measured size is
under the broadcast threshold and otherwise shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_key, strip
from ..schema import COMMIT_TYPES, STATUS_ACTIVE, STATUS_INACTIVE, require_columns

STAT_COLUMNS = ["commits", "files_changed", "insertions", "deletions"]


# --- J1: aliases --------------------------------------------------------------

def alias_lookup(aliases: DataFrame) -> DataFrame:
    """Unique (alias_key -> member_id, member); on a clash the later roster entry wins."""
    require_columns(aliases, ["member_id", "member", "alias"])
    pick = F.max_by(F.struct("member_id", "member"), F.col("member_id"))
    return (aliases.select(norm_key("alias").alias("alias_key"), "member_id", "member")
            .filter(F.col("alias_key") != "")
            .groupBy("alias_key").agg(pick.alias("_m"))
            .select("alias_key", F.col("_m.member_id").alias("member_id"), F.col("_m.member").alias("member")))


def roster(aliases: DataFrame) -> DataFrame:
    """Distinct (member_id, member)."""
    return aliases.select("member_id", "member").distinct()


HOT_ROWS = 1_000_000  # rows of one author that one task joins


def resolve_alias(df: DataFrame, aliases: DataFrame, column: str = "author", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Map a name/handle/alias column (stripped, lower-cased) to its member.

    Adds member_id and member; rows that match no alias are dropped. Rows per
    author are counted first (one partial aggregate). An author with more than
    ``hot_rows`` is dealt into parts by row content and that author's lookup
    row is repeated per part; all others are joined as they are. The hot
    authors, at most rows / ``hot_rows``, are one scalar map.
    """
    require_columns(df, [column])
    keyed = df.withColumn("_key", norm_key(column))
    sizes = keyed.groupBy("_key").agg(F.ceil(F.count(F.lit(1)) / F.lit(int(hot_rows))).cast("int").alias("_n"))
    hot = sizes.filter((F.col("_n") > 1) & F.col("_key").isNotNull()).agg(
        F.map_from_entries(F.collect_list(F.struct("_key", "_n")))).scalar()
    parts = lambda key: F.coalesce(F.try_element_at(hot, key), F.lit(1))
    lookup = alias_lookup(aliases).withColumn("_salt", F.explode(F.sequence(F.lit(0), parts(F.col("alias_key")) - 1)))
    return (keyed.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), parts(F.col("_key"))).cast("int"))
            .join(lookup.withColumnRenamed("alias_key", "_key"), ["_key", "_salt"], "inner")
            .drop("_key", "_salt"))


# --- J3: zero fill --------------------------------------------------------------

def roster_zero_fill(counts: DataFrame, aliases: DataFrame, value_cols) -> DataFrame:
    """Every roster member appears, with 0 for absent values; rows outside the
    roster are kept (full join). Sorted by member."""
    value_cols = list(value_cols)
    members = roster(aliases)
    joined = members.join(counts, on=["member_id", "member"], how="full")
    return (joined.select("member_id", "member",
                          *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in value_cols])
            .orderBy("member", "member_id"))


# --- G6 / G7 / J2: commit and PR counts by member ------------------------------

def _resolved_counts(commits: DataFrame, aliases: DataFrame, column: str = "author", **extra) -> DataFrame:
    """Commits per (alias key, extra columns...) joined to their member, as ``_n``.

    Counting before the roster join lets the partial aggregate collapse a
    prolific author inside every task, so the join (and its shuffle) sees one
    row per distinct key instead of one per commit; an author holding a third
    of all commits is then one row, not a third of the join input.
    """
    require_columns(commits, [column])
    per_key = (commits.select(norm_key(column).alias("_key"), *[v.alias(k) for k, v in extra.items()])
               .groupBy("_key", *extra).agg(F.count(F.lit(1)).alias("_n")))
    lookup = alias_lookup(aliases)
    return per_key.join(lookup, per_key["_key"] == lookup["alias_key"], "inner").drop("_key", "alias_key")


def commits_by_member(commits: DataFrame, aliases: DataFrame) -> DataFrame:
    """Resolved commits per member, every member present, commits desc."""
    counts = (_resolved_counts(commits, aliases).groupBy("member_id", "member")
              .agg(F.sum("_n").cast("bigint").alias("commits")))
    return (roster_zero_fill(counts, aliases, ["commits"])
            .orderBy(F.desc("commits"), F.asc("member"), F.asc("member_id")))


def commits_per_day(commits: DataFrame, aliases: DataFrame, day_col: str = "day") -> DataFrame:
    """Resolved commits per calendar day, ascending."""
    day = F.to_date(F.col(day_col)).cast("timestamp_ntz")
    resolved = _resolved_counts(commits, aliases, day=day)
    return (resolved.filter(F.col("day").isNotNull())
            .groupBy("day").agg(F.sum("_n").cast("bigint").alias("commits")).orderBy("day"))


def prs_by_author(prs: DataFrame) -> DataFrame:
    """Pull requests per normalised login (blank logins ignored)."""
    require_columns(prs, ["login"])
    return (prs.select(norm_key("login").alias("login")).filter(F.col("login").isNotNull() & (F.col("login") != ""))
            .groupBy("login").agg(F.count(F.lit(1)).alias("prs")))


def prs_by_member(prs: DataFrame, aliases: DataFrame) -> DataFrame:
    """G4 (resolved): pull requests per member via the alias lookup."""
    by_login = prs_by_author(prs)
    lookup = alias_lookup(aliases)
    return (by_login.join(lookup, by_login["login"] == lookup["alias_key"], "inner")
            .groupBy("member_id", "member").agg(F.sum("prs").cast("bigint").alias("prs")))


def left_merge_counts(commits: DataFrame, prs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Commits per member left-joined with PRs per member (missing -> 0),
    commits desc then PRs desc."""
    left = commits_by_member(commits, aliases)
    right = prs_by_member(prs, aliases)
    return (left.join(right, on=["member_id", "member"], how="left")
            .select("member_id", "member", "commits", F.coalesce("prs", F.lit(0)).cast("bigint").alias("prs"))
            .orderBy(F.desc("commits"), F.desc("prs"), F.asc("member"), F.asc("member_id")))


# --- G1: numstat fold ------------------------------------------------------------

def fold_numstat(log: DataFrame, chunk_lines: int = 1 << 20) -> DataFrame:
    """G1: per author text: commits, files_changed, insertions, deletions (commits desc).

    A log is ordered lines per repo. A line with three tab-separated parts is
    a file stat belonging to the latest author line above it; any other
    non-blank line (and the first line of a repo) is an author line starting
    a commit. Non-digit insertions/deletions (binary files) count as 0.

    Attaching each stat to its author is a forward fill. To stay parallel
    even when one repo holds most lines, lines are cut into fixed chunks of
    ``chunk_lines``. One aggregate summarises every (repo, chunk): its first
    line and its last non-stat line. A window over that small summary gives
    each chunk the repo's first line and the author carried in from earlier
    chunks; the fill itself then runs inside each (repo, chunk) window, so no
    task ever holds more than one chunk.
    """
    require_columns(log, ["repo", "line_no", "txt"])
    parts = F.split(F.col("line"), "\t")
    lines = (log.select("repo", "line_no", strip("txt").alias("line"))
             .filter(F.col("line").isNotNull() & (F.col("line") != ""))
             .withColumns({"_parts": parts, "_chunk": F.floor(F.col("line_no") / F.lit(int(chunk_lines)))})
             .withColumn("_stat", F.size("_parts") == 3))
    entry = F.struct(F.col("line_no").alias("n"), F.col("line").alias("author"))

    summary = lines.groupBy("repo", "_chunk").agg(
        F.min(entry).alias("_first"),
        F.max(F.when(~F.col("_stat"), entry)).alias("_last_text"))
    whole_repo = Window.partitionBy("repo")
    before = Window.partitionBy("repo").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    repo_first = F.min("_first").over(whole_repo)
    # the chunk's last author line: its last non-stat line, or the repo's first line if that is later
    last_author = F.greatest(F.col("_last_text"),
                             F.when(F.col("_first.n") == F.col("_repo_first.n"), F.col("_first")))
    chunks = (summary.withColumn("_repo_first", repo_first)
              .withColumn("_last_author", last_author)
              .select("repo", "_chunk", F.col("_repo_first.n").alias("_first_line"),
                      F.last("_last_author", ignorenulls=True).over(before).alias("_carry")))

    marked = (lines.join(chunks, ["repo", "_chunk"], "inner")
              .withColumn("_header", ~F.col("_stat") | (F.col("line_no") == F.col("_first_line"))))
    in_chunk = Window.partitionBy("repo", "_chunk").orderBy("line_no") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.last(F.when(F.col("_header"), F.col("line")), ignorenulls=True).over(in_chunk)
    attributed = marked.withColumn("author", F.coalesce(own, F.col("_carry.author")))

    def digits(i):
        p = F.get(F.col("_parts"), i)
        return F.when(p.rlike("^[0-9]+$"), p.try_cast("bigint")).otherwise(F.lit(0))

    is_stat = ~F.col("_header")
    rows = attributed.select(
        "author",
        F.when(F.col("_header"), 1).otherwise(0).alias("c"),
        F.when(is_stat, 1).otherwise(0).alias("f"),
        F.when(is_stat, digits(0)).otherwise(0).alias("i"),
        F.when(is_stat, digits(1)).otherwise(0).alias("d"),
    )
    return (rows.groupBy(F.col("author").alias("name"))
            .agg(F.sum("c").cast("bigint").alias("commits"),
                 F.sum("i").cast("bigint").alias("insertions"),
                 F.sum("d").cast("bigint").alias("deletions"),
                 F.sum("f").cast("bigint").alias("files_changed"))
            .orderBy(F.desc("commits"), F.asc("name")))


def _member_stats(numstat: DataFrame, aliases: DataFrame, chunk_lines: int) -> DataFrame:
    stats = fold_numstat(numstat, chunk_lines)
    return (resolve_alias(stats, aliases, column="name").groupBy("member_id", "member")
            .agg(*[F.sum(c).cast("bigint").alias(c) for c in STAT_COLUMNS]))


def roster_stats(numstat: DataFrame, aliases: DataFrame, chunk_lines: int = 1 << 20) -> DataFrame:
    """Numstat totals per roster member (aliases merged, others dropped, zeros kept),
    commits desc."""
    return (roster_zero_fill(_member_stats(numstat, aliases, chunk_lines), aliases, STAT_COLUMNS)
            .orderBy(F.desc("commits"), F.asc("member"), F.asc("member_id")))


# --- G2 / G3 ---------------------------------------------------------------------

def commit_types(commits: DataFrame, subject_col: str = "subject") -> DataFrame:
    """Commits per conventional type prefix ("type(" or "type:"), else 'other';
    blank subjects are not counted."""
    lowered = F.lower(strip(subject_col))
    pattern = "^(" + "|".join(COMMIT_TYPES) + ")[(:]"
    kind = F.regexp_extract(lowered, pattern, 1)
    return (commits.select(lowered.alias("_s"), kind.alias("_k"))
            .filter(F.col("_s").isNotNull() & (F.col("_s") != ""))
            .select(F.when(F.col("_k") != "", F.col("_k")).otherwise(F.lit("other")).alias("commit_type"))
            .groupBy("commit_type").agg(F.count(F.lit(1)).alias("commits"))
            .orderBy(F.desc("commits"), F.asc("commit_type")))


def pr_state_counts(prs: DataFrame) -> DataFrame:
    """One row: total_prs, merged_prs, open_prs."""
    state = F.upper(F.coalesce(F.col("state").cast("string"), F.lit("")))
    return prs.agg(F.count(F.lit(1)).alias("total_prs"),
                   F.count_if(state == "MERGED").alias("merged_prs"),
                   F.count_if(state == "OPEN").alias("open_prs"))


# --- J4 ---------------------------------------------------------------------------

def contribution_summary(numstat: DataFrame, prs: DataFrame, aliases: DataFrame,
                         chunk_lines: int = 1 << 20) -> DataFrame:
    """Roster LEFT JOIN commit stats LEFT JOIN PR counts, with a status.

    PRs count for a member when the login equals any of the member's aliases.
    Both sides are aggregated per member before joining, so nothing fans out.
    An alias table with a ``github`` column passes each member's (smallest)
    handle on.
    """
    stats = _member_stats(numstat, aliases, chunk_lines)
    keys = (aliases.select("member_id", "member", norm_key("alias").alias("login"))
            .filter(F.col("login") != "").distinct())
    pr_counts = (prs_by_author(prs).join(keys, "login", "inner")
                 .groupBy("member_id", "member").agg(F.sum("prs").cast("bigint").alias("prs")))
    out = (roster(aliases)
           .join(stats, ["member_id", "member"], "left")
           .join(pr_counts, ["member_id", "member"], "left"))
    vals = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in STAT_COLUMNS + ["prs"]}
    out = out.select("member_id", "member", *[v.alias(k) for k, v in vals.items()])
    status = F.when((F.col("commits") > 0) | (F.col("prs") > 0), STATUS_ACTIVE).otherwise(STATUS_INACTIVE)
    out = out.withColumn("status", status)
    if "github" in aliases.columns:
        handles = aliases.groupBy("member_id", "member").agg(F.min("github").alias("github"))
        out = out.join(handles, ["member_id", "member"], "left")
    return out.orderBy("member", "member_id")

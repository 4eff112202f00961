"""URL filter: allow/block rules by host and path, then a weighted vocabulary."""

from __future__ import annotations

from pathlib import Path
from typing import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): the rules of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: term -> (class, points). One strict term rejects; soft ones if ``MIN_SOFT`` distinct terms have ``LIMIT`` points.
Vocabulary = dict[str, tuple[str, int]]
TERMS_FILE = Path(__file__).with_name("url_terms.tsv")
MIN_SOFT, LIMIT = 2, 100
MAX_TERMS = 100_000  # terms that the workers' automaton may hold


def _checked(rows: Iterable[tuple[str, str, int]]) -> Vocabulary:
    out: Vocabulary = {}
    for term, kind, points in rows:
        if not term or kind not in ("strict", "soft") or term != term.lower() or out.setdefault(term, (kind, points)) != (kind, points):
            raise ValueError(f"bad vocabulary entry: {term!r}, {kind!r}, {points!r}")
    if len(out) > MAX_TERMS:
        raise ValueError(f"a vocabulary holds at most {MAX_TERMS} terms")
    return out


def read_vocabulary(path: str | Path = TERMS_FILE) -> Vocabulary:
    """Terms from a text file: term, class and points, tab-separated; lines that begin with # are comments."""
    lines = (x.rstrip("\n").split("\t") for x in Path(path).open(encoding="utf-8") if x.strip() and x[0] != "#")
    return _checked((term, kind, int(points)) for term, kind, points in lines)


def collect_vocabulary(terms: DataFrame) -> Vocabulary:
    """Terms from a table (term, class, points) of at most ``MAX_TERMS`` distinct rows, lower-cased; more raise."""
    rows = terms.select(lower_ascii(F.col("term")).alias("t"), "class", F.col("points").cast("int").alias("p")).distinct()
    return _checked((r["t"], r["class"], r["p"]) for r in rows.limit(MAX_TERMS + 1).collect())


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path after the first ``://``; both empty without one."""
    pattern = r"://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; nulls if none does.

    A rule fits its host and all subdomains if the path starts with its path.
    Of rules with equal text, the first listed wins.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    pick = lambda values: F.coalesce(*(F.when(f, F.lit(v)) for f, v in zip(fits, values, strict=True)),
                                     F.lit(None).cast("string"))
    return pick([h + p for _, h, p in ordered]), pick([v for v, _, _ in ordered])


def vocabulary_column(url_col: str, vocabulary: Vocabulary):
    """Column: distinct strict and soft terms of a URL, and the points of its soft terms.

    A term counts only where no ASCII letter or digit stands directly before
    or after it. One Aho-Corasick pass finds all terms at once.
    """
    terms = dict(vocabulary)

    @pandas_udf("strict int, soft int, points int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for term in terms:
            automaton.add_word(term, term)
        if terms:
            automaton.make_automaton()
        fold = str.maketrans(UPPER, LOWER)
        inner = set(LOWER + "0123456789")
        for urls in batches:
            rows = []
            for url in urls:
                text, found = (url or "").translate(fold), set()
                for end, term in automaton.iter(text) if terms else ():
                    start = end - len(term) + 1
                    if (start == 0 or text[start - 1] not in inner) and (
                            end + 1 == len(text) or text[end + 1] not in inner):
                        found.add(term)
                soft = [terms[t][1] for t in found if terms[t][0] == "soft"]
                rows.append((len(found) - len(soft), len(soft), sum(soft)))
            yield pd.DataFrame(rows, columns=["strict", "soft", "points"]).astype("int32")

    return count(F.col(url_col))


def rejected(counts: Column, min_soft: int = MIN_SOFT, limit: int = LIMIT) -> Column:
    """One strict term, or ``min_soft`` distinct soft terms with ``limit`` points together."""
    return (counts["strict"] >= 1) | ((counts["soft"] >= min_soft) & (counts["points"] >= limit))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
               vocabulary: Vocabulary | None = None, min_soft: int = MIN_SOFT, limit: int = LIMIT) -> DataFrame:
    """Per row of ``pages``: id, host, path, rule, verdict, n_strict, n_soft, soft_points.

    ``verdict`` is the longest fitting rule's; without one, ``block`` if the
    whole URL is ``rejected`` by the vocabulary (the file beside this module,
    if none is given), else ``allow``. A null URL, and one without ``://``,
    has empty host and path and fits no rule; its text is still scanned (null:
    no terms). Repeated rows are judged each; other columns are ignored; an
    empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    out = pages.select(F.col(id_col), host.alias("host"), path.alias("path"),
                       vocabulary_column(url_col, read_vocabulary() if vocabulary is None else vocabulary).alias("v"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    own = F.when(rejected(F.col("v"), min_soft, limit), "block").otherwise("allow")
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                      F.col("v.strict").alias("n_strict"), F.col("v.soft").alias("n_soft"),
                      F.col("v.points").alias("soft_points"))


def filter_pages(pages: DataFrame, url_col: str = "url", rules=RULES, vocabulary: Vocabulary | None = None,
                 min_soft: int = MIN_SOFT, limit: int = LIMIT) -> DataFrame:
    """``pages`` without the rows whose URL is blocked; repeated rows stay repeated."""
    host, path = host_and_path(F.col(url_col))
    _, verdict = matching_rule(host, path, rules)
    counts = vocabulary_column(url_col, read_vocabulary() if vocabulary is None else vocabulary)
    return pages.where(F.coalesce(verdict == "allow", ~rejected(counts, min_soft, limit)))


def oracle_sql() -> str:
    """DuckDB SQL for the registered query."""
    fold = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    words = read_vocabulary()
    rows = ", ".join(f"('{t}', '{kind}', {points})" for t, (kind, points) in words.items())
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in ordered]
    case = lambda values: "CASE " + " ".join(
        f"WHEN {f} THEN '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    return f"""
WITH terms AS (SELECT * FROM (VALUES {rows}) v(term, kind, points)),
parts AS (
  SELECT row_number() OVER () AS r, page_id, {fold} AS low,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
hits AS (
  SELECT r, count(*) FILTER (kind = 'strict')::INT AS n_strict, count(*) FILTER (kind = 'soft')::INT AS n_soft,
         coalesce(sum(points) FILTER (kind = 'soft'), 0)::INT AS soft_points
  FROM parts JOIN terms ON contains(low, term) AND regexp_matches(low, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)')
  GROUP BY r),
counted AS (SELECT page_id, host, path, coalesce(n_strict, 0) AS n_strict, coalesce(n_soft, 0) AS n_soft,
                   coalesce(soft_points, 0) AS soft_points FROM parts LEFT JOIN hits USING (r))
SELECT page_id, host, path, {case([h + p for _, h, p in ordered])} AS rule,
       coalesce({case([v for v, _, _ in ordered])},
                CASE WHEN n_strict >= 1 OR (n_soft >= {MIN_SOFT} AND soft_points >= {LIMIT}) THEN 'block'
                     ELSE 'allow' END) AS verdict,
       n_strict, n_soft, soft_points FROM counted"""

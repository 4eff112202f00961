"""Filter interaction audit over failing-id relations.

Each filter has one stored table of the rows that fail it. Whatever the order
of the filters, what a step removes depends only on which filters ran before
it, so the prefixes of all orders are the subsets of the filters. The walk
starts from every failing row of every filter; one left-anti join per filter
extends all prefixes without it by that filter and keeps the rows that survive
it, which leaves each prefix with the rows that the next filter removes. Rows
removed earlier are its redundancies, rows never removed the survivors. Label
losses are the same walk over the failing rows that are in left-semi joins
with the label tables.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, materialize

KINDS = ("removed", "good", "toxic")
#: Stored row numbers take a few bits each, many times that in a broadcast; so no id table is broadcast by its file size.
JOIN = "merge"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A-D of a text: short, repetitive, shouting, markup."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n_words < 200, "B": 100 * n_distinct.cast("long") < 50 * n_words.cast("long"),
            "C": 100 * capitals.cast("long") > 2 * F.length(text).cast("long"), "D": text.rlike(r"[#$%&*|]")}


def failing_rows(docs: DataFrame, filters: Mapping[str, Column], copies: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text", part_col: str = "source") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Rows (row, id, part) of the table, numbered, and one table (row, part) of failing rows per filter.

    ``filters`` gives the failure conditions over the columns of ``docs``, a
    null condition passes; ``copies`` names one more filter, failed by a text
    that equals the text of any smaller id (null text: empty). A row without
    an id has no smaller one and is none's smaller.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text"),
        *(F.coalesce(c, F.lit(False)).alias(f"fails_{name}") for name, c in filters.items()))
    rows = materialize(rows, "audit-rows")
    failing = {name: rows.where(F.col(f"fails_{name}")).select("row", "part") for name in filters}
    if copies:
        # copies meet as one partial row per task; both join sides are plain exchanges, so a hot text is split
        first = rows.where("id is not null").groupBy("text").agg(F.min("id").alias("first"), F.max("id").alias("last"))
        first = materialize(first.where("first < last").select("text", "first"), "audit-first-ids")
        failing[copies] = rows.join(first.hint(JOIN), "text").where("id > first").select("row", "part")
    return rows.select("row", "id", "part"), {f: materialize(t, f"audit-fails-{f}") for f, t in failing.items()}


def removals(failing: Mapping[str, DataFrame], labelled: Mapping[str, DataFrame]) -> DataFrame:
    """Removed rows per part, kind, prefix and filter (mask, filter: bit i of mask is the i-th filter in the prefix).

    ``failing`` has each filter's failing rows (row, part), ``labelled`` tables
    of rows (row) to count apart. All joins are on ``row``, which is unique: no
    key is hot, and one partitioning serves them all. A failing row takes part
    in at most 16 subsets for each filter that it fails.
    """
    subjects = None
    for bit, name in enumerate(failing):
        fails = failing[name].select("row", "part", F.lit(bit).alias("filter"))
        subjects = fails if subjects is None else subjects.unionByName(fails)
    walked = subjects.withColumn("kind", F.lit("removed"))
    for kind, ids in labelled.items():
        walked = walked.unionByName(subjects.join(ids.hint(JOIN), "row", "left_semi").withColumn("kind", F.lit(kind)))
    walked = walked.withColumn("mask", F.lit(0))
    for bit, name in enumerate(failing):
        # each prefix goes on without this filter, and with it for the rows that survive it
        ways = F.when(F.col("filter") == bit, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1 << bit)))
        walked = walked.withColumn("added", F.explode(ways))
        fails = failing[name].select(F.col("row").alias("failed")).hint(JOIN)
        walked = walked.join(fails, (F.col("row") == F.col("failed")) & (F.col("added") > 0), "left_anti")
        walked = walked.withColumn("mask", F.col("mask") + F.col("added")).drop("added")
    return walked.groupBy("part", "kind", "mask", "filter").agg(F.count(F.lit(1)).alias("n"))


def audit_orders(parts: DataFrame, removed: DataFrame, names: list[str]) -> DataFrame:
    """One row per part, order of the filters and step, from the counts of ``removals`` and rows per part (part, total).

    A part's counts, at most 3 x 80, are one map; every order looks its
    prefixes up there, so nothing is joined per order.
    """
    full = (1 << len(names)) - 1
    orders = [list(o) for o in permutations(range(len(names)))]
    key = lambda kind, mask, f: KINDS.index(kind) * 1024 + mask * 16 + f
    kinds = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i * 1024)))
    coded = removed.select("part", (F.element_at(kinds, F.col("kind")) + F.col("mask") * 16 + F.col("filter")).alias("k"), "n")
    found = coded.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"))
    rows = parts.join(found, "part", "left").withColumn("counts", F.coalesce("counts", F.map_from_arrays(
        F.array().cast("array<int>"), F.array().cast("array<long>"))))
    at = lambda k: F.coalesce(F.try_element_at("counts", k), F.lit(0).cast("long"))

    entries, shares = [], {f: {} for f in range(len(names))}
    for order in orders:
        before, keys = 0, []
        for step, f in enumerate(order):
            keys.append(key("removed", before, f))
            shares[f][before] = shares[f].get(before, 0) + 1
            entries.append((("".join(names[i] for i in order)), step + 1, f, before, list(keys)))
            before |= 1 << f
    lookup = F.from_json(F.lit(_json(entries)), "array<struct<o:string,s:int,f:int,b:int,k:array<int>>>")
    shapley = F.array(*(sum((F.lit(n).cast("long") * at(F.lit(key("removed", b, f))) for b, n in shares[f].items()),
                            F.lit(0).cast("long")) for f in range(len(names))))
    rows = rows.select("part", "total", "counts", shapley.alias("shapley")).withColumn("e", F.explode(lookup))
    own = F.col("e.b") * 16 + F.col("e.f")
    alone = F.lit(full) - F.expr("shiftleft(1, e.f)")
    gone = F.aggregate("e.k", F.lit(0).cast("long"), lambda acc, k: acc + at(k))
    return rows.select(
        "part", F.col("e.o").alias("filter_order"), F.col("e.s").alias("step"), (F.col("total") - gone).alias("kept"),
        at(own).alias("removed"), (at(F.col("e.f")) - at(own)).alias("redundant"),
        at(alone * 16 + F.col("e.f")).alias("unique_fails"), at(own + 1024).alias("good_lost"),
        at(own + 2048).alias("toxic_lost"), F.element_at("shapley", F.col("e.f") + 1).alias("shapley"))


def _json(entries: list[tuple]) -> str:
    return json.dumps([dict(zip("osfbk", e, strict=True)) for e in entries])


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """Five text filters in all 120 orders, per value of ``part_col``.

    Returns part (null: empty string), filter_order, step, kept (rows after
    the step), removed (here), redundant (rows that fail the step's filter but
    were removed earlier), unique_fails (that fail no other filter), good_lost
    and toxic_lost (removed here and labelled so) and shapley (the filter's
    removals summed over all orders).

    Null texts are empty. Repeated rows count each; rows without an id count
    too, without labels, and are no copies. An id with several labels has each
    of them. Other columns are ignored; an empty table gives no rows.
    """
    text = free_name(docs, "text_or_empty")
    docs = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit("")))
    rows, failing = failing_rows(docs, text_filters(F.col(text)), "E", id_col, text, part_col)
    labelled = {}
    for kind, column in (("good", "quality"), ("toxic", "toxic")):
        ids = labels.where(F.col(column) == 1).select(F.col(id_col).alias("id"))
        labelled[kind] = materialize(rows.join(ids.hint(JOIN), "id", "left_semi").select("row"), f"audit-{kind}")
    removed = materialize(removals(failing, labelled), "audit-removals")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("total"))
    return audit_orders(parts, removed, list(failing))

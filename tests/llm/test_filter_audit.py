import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from crashgrid.llm.filter_audit import audit_filters, failing_rows, removals, text_filters
from plan_util import plan_text

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
           "shapley"]


def fails_of(rows, i):
    doc_id, text, _ = rows[i]
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = set()
    if len(words) < 200:
        fails.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        fails.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        fails.add("C")
    if re.search("[#$%&*|]", text):
        fails.add("D")
    if doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows):
        fails.add("E")
    return fails


def brute(rows, labels):
    fails = [fails_of(rows, i) for i in range(len(rows))]
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    out = []
    for part in sorted({r[2] or "" for r in rows}):
        mine = [i for i in range(len(rows)) if (rows[i][2] or "") == part]
        shapley, made = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            alive = set(mine)
            for step, f in enumerate(order, 1):
                gone = {i for i in alive if f in fails[i]}
                redundant = sum(f in fails[i] for i in mine) - len(gone)
                alive -= gone
                shapley[f] += len(gone)
                made.append([part, "".join(order), step, len(alive), len(gone), redundant,
                             sum(fails[i] == {f} for i in mine), sum(rows[i][0] in good for i in gone),
                             sum(rows[i][0] in toxic for i in gone), f])
        out += [(*m[:-1], shapley[m[-1]]) for m in made]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", True) for r in rows],
                                 "doc_id long, text string, source string, row int, kind string, fails_A boolean")


def label_table(spark, rows):
    return spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, quality int, toxic int, row int")


def texts(rng):
    words = [f"w{i}" for i in range(400)]
    return rng.choice([None, "", "short", " ".join(rng.sample(words, 250)), " ".join(["a", "b"] * 150),
                       " ".join(rng.sample(words, 220)) + " AAAA BBBB CCCC DDDD EEEE", "same $ text", "w " * 30_000,
                       " ".join(words[:210]), " ".join(words[:210]), "X\x0bY Z " * 120])


def test_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(60)]), texts(rng), rng.choice([None, "", "a", "b"])) for _ in range(120)]
    rows += rows[:15] + [(900, " ".join(f"clean{i}" for i in range(300)), "all clean")]
    labels = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(50)]
    got = audit_filters(table(spark, rows), label_table(spark, labels))
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, labels)


def test_empty_tables(spark):
    assert audit_filters(table(spark, []), label_table(spark, [])).count() == 0
    got = audit_filters(table(spark, [(1, "a", "s")]), label_table(spark, [])).collect()
    assert len(got) == 600 and {r["good_lost"] for r in got} == {0}


def test_walk_shuffles_each_relation_once_by_row(spark):
    docs = table(spark, [(i, f"text {i % 7} $", "s") for i in range(40)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, failing = failing_rows(docs, text_filters(F.col("text")), "E")
        plan = plan_text(removals(failing, {}), "simple")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("LeftAnti") == 5 and plan.count("Exchange") == 7  # walk, five relations, final counts
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan

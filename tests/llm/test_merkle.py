import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from crashgrid.llm.merkle import audit, build_manifest, document_audit, fold, proofs, sibling_paths, subtree
from plan_util import plan_text

DDL = "doc_id long, text string, lang string, source string, n_chars long, digest string, g string, pos int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, text=None):
    return h("".join(map(framed, (row[0], row[3], row[2], row[4], row[1] if text is None else text))))


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + arity])) for i in range(0, len(levels[-1]), arity)])
    return levels


def path_of(levels, i, arity):
    path = []
    for level in levels[:-1]:
        s = i - i % arity
        path.append(("".join(level[s:i]), "".join(level[i + 1:s + arity])))
        i //= arity
    return path


def brute(rows, arity=8):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = [tree([leaf_of(r) for r in groups[name]], arity) for name in names]
    upper = tree([t[-1][0] for t in trees], arity)
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            path = path_of(trees[k], i, arity) + path_of(upper, k, arity)
            given = leaf_of(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                given = leaf_of(r, r[1].translate(LOWER))
            for left, right in path:
                given = h(left + given + right)
            out.append((r[0], leaf_of(r), trees[k][-1][0], upper[-1][0], h("".join(a + b for a, b in path)), given,
                        given == upper[-1][0]))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], DDL)


def made(seed, n, langs=("en", "de", "ü", "Z", "")):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "", "Ab Cü", "x" * 5000, f"T{i}"]),
             rng.choice([None, *langs]), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(n)]
    return rows + rows[:n // 4]  # repeated rows


@pytest.mark.parametrize("n,arity,stored", [(1, 8, 3), (9, 8, 1), (150, 2, 2), (300, 3, 1), (300, 8, 3)])
def test_equals_brute_force(spark, n, arity, stored):
    rows = made(n, n)
    got = document_audit(table(spark, rows), arity, stored)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, arity)


def test_many_groups_and_a_hot_repeated_row(spark):
    rows = [(i, "A", f"l{i:03d}", "s", 1) for i in range(70)] + [(5, "Same", "hot", "s", 1)] * 200
    got = sorted(map(tuple, document_audit(table(spark, rows), 8, 1).collect()), key=str)
    assert got == brute(rows)


def test_proofs_lead_to_the_root_and_detect_a_change(spark):
    docs = table(spark, [(i, f"Text {i}", "en" if i % 3 else "de", "s", i) for i in range(90)])
    manifest = build_manifest(docs, ["doc_id", "text"], arity=4, stored_every=2)
    rows = proofs(manifest).collect()
    assert len(rows) == 90
    for r in rows:
        path = [(s["left"], s["right"]) for s in r["proof"]]
        assert fold(r["leaf"], path) == manifest.root
        assert fold(h("other"), path) != manifest.root
    assert all(r["verified"] for r in audit(manifest).collect())
    changed = build_manifest(docs.withColumn("text", F.when(F.col("doc_id") == 7, "other").otherwise(F.col("text"))),
                             ["doc_id", "text"], arity=4, stored_every=2)
    assert changed.root != manifest.root


def test_only_every_few_levels_are_stored(spark):
    docs = table(spark, [(i, "t", "en", "s", i) for i in range(100)])
    manifest = build_manifest(docs, ["doc_id"], arity=2, stored_every=3)
    assert [level.count() for level in manifest.groups.levels] == [13, 2, 1]  # 100, 13 and 2 nodes in blocks of 8
    assert max(len(r["nodes"]) for level in manifest.groups.levels for r in level.collect()) == 8


def test_empty_table(spark):
    got = document_audit(table(spark, []))
    assert got.count() == 0 and got.columns[0] == "doc_id"
    assert proofs(build_manifest(table(spark, []), ["doc_id"])).count() == 0


def test_no_global_window_and_no_cross_join(spark):
    text = plan_text(document_audit(table(spark, made(1, 50))))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_subtree_paths():
    nodes = [h(str(i)) for i in range(11)]
    levels = subtree(nodes, 4, 2, False)
    assert [len(x) for x in levels] == [11, 3, 1]
    assert all(fold(n, p) == levels[-1][0] for n, p in zip(nodes, sibling_paths(levels, 4), strict=True))
    assert subtree(nodes[:1], 4, 2, True) == [nodes[:1]]
    assert len(subtree(nodes[:1], 4, 2, False)) == 3  # a lone last run is hashed like any other

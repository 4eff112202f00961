"""Merkle manifest of a dataset by checkpoint and recompute.

Every row is a leaf. The leaves of a group are ranked by id and hashed upward,
``arity`` neighbours at a time; the groups' roots form one more tree above.
Only every ``stored_every``-th level is written, as blocks of
``arity ** stored_every`` neighbouring nodes, each one aligned subtree. A proof
descends from the root over the stored levels: a task regenerates the missing
interior nodes of a block from its stored nodes, emits every node's siblings
below the path of the block's top, and discards them.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

STEP = "array<struct<left:string,right:string>>"  # siblings on either side, level by level upward
_STEP = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_ROWS = 1_000  # rows of an output batch: a few MB of paths


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:`` and the value: no two rows give the same concatenation."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the framed values."""
    return F.sha2(F.concat(*map(framed, values)), 256)


def subtree(nodes: list[str], arity: int, stored_every: int, whole: bool) -> list[list[str]]:
    """Levels of one aligned subtree, its stored nodes first: up to one root if it is the ``whole`` tree,
    else exactly ``stored_every`` levels up (a last run of few, even one, is hashed like any other)."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= stored_every:
        below = levels[-1]
        levels.append([digest("".join(below[i:i + arity])) for i in range(0, len(below), arity)])
    return levels


def sibling_paths(levels: list[list[str]], arity: int) -> Iterator[list[tuple[str, str]]]:
    """For every node of the lowest level: (left, right) siblings per level up to the subtree's top."""
    steps = []
    for level in levels[:-1]:
        runs = [level[i:i + arity] for i in range(0, len(level), arity)]
        steps.append([("".join(run[:j]), "".join(run[j + 1:])) for run in runs for j in range(len(run))])
    for i in range(len(levels[0])):
        path = []
        for step in steps:
            path.append(step[i])
            i //= arity
        yield path


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = digest(left + leaf + right)
    return leaf


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` plus ``pos`` (rank in its group ``g``, from 0) and ``n`` (the group's size), in range partitions.

    No task holds a group: rows are numbered within partitions of the sorted
    table, and each partition's share of a group gets its start from the
    counts of those before it. ``order`` must tell all rows of a group apart.
    """
    dealt = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    stored = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    stored = stored.withColumn("part", F.shiftright("at", 33))
    counts = stored.groupBy("part", "g").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("m"))
    group = Window.partitionBy("g")  # a row per partition that holds some of the group
    starts = counts.select("part", "g", "low", F.sum("m").over(group).alias("n"),
                           (F.sum("m").over(group.orderBy("part")) - F.col("m")).alias("before"))
    return stored.join(starts, ["part", "g"]).withColumn("pos", F.col("before") + F.col("at") - F.col("low")).drop(
        "part", "at", "low", "before")


@dataclass
class Tree:
    """Stored levels of the trees of all groups, lowest first, and their roots (g, level, top)."""
    levels: list[DataFrame]  # g, block, n (the group's nodes on the level), nodes: array of (pos, digest, ...)
    roots: DataFrame
    arity: int
    stored_every: int


def _in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _rows(batches) -> Iterator[dict]:
    """One row at a time: only one block is held as Python objects."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def grow(nodes: DataFrame, name: str, arity: int, stored_every: int, extra: tuple[str, ...] = ()) -> Tree:
    """Trees over ``nodes`` (g, pos, n, digest and ``extra`` columns kept beside the lowest level)."""
    width = arity ** stored_every
    top = pa.schema([("g", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("top", pa.string())])

    def tops(batches):
        made = ((r["g"], r["block"], r["n"], subtree([x["digest"] for x in r["nodes"]], arity, stored_every,
                                                     r["n"] <= width)[-1][0]) for r in _rows(batches))
        yield from _in_batches(made, top)

    levels, roots = [], []
    while True:
        kept = F.struct("pos", "digest", *(extra if not levels else ()))
        blocks = nodes.groupBy("g", F.floor(F.col("pos") / width).alias("block")).agg(
            F.max("n").alias("n"), F.array_sort(F.collect_list(kept)).alias("nodes"))  # at most ``width`` nodes
        levels.append(materialize(blocks, f"{name}-level-{len(levels) * stored_every}"))
        made = materialize(levels[-1].select("g", "block", "n", "nodes").mapInArrow(
            tops, "g string, block long, n long, top string"), f"{name}-tops")
        roots.append(made.where(F.col("n") <= width).select("g", F.lit(len(levels) - 1).alias("level"), "top"))
        nodes = made.where(F.col("n") > width).select(
            "g", F.col("block").alias("pos"), F.ceil(F.col("n") / width).alias("n"), F.col("top").alias("digest"))
        if nodes.isEmpty():
            break
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    return Tree(levels, found, arity, stored_every)


def descend(tree: Tree, above: DataFrame | None, name: str) -> DataFrame:
    """The lowest level's blocks with ``path`` and ``subroot``: the siblings of each block's top up to the root.

    ``above`` has the path of every group's root (g, path), None that nothing
    is above. One stored level after the other, nodes get their siblings
    inside the block and their block's path.
    """
    arity, stored_every, width = tree.arity, tree.stored_every, tree.arity ** tree.stored_every
    schema = pa.schema([("g", pa.string()), ("block", pa.int64()), ("subroot", pa.string()), ("path", _STEP)])
    start = tree.roots.withColumn("path", F.array().cast(STEP)) if above is None else tree.roots.join(above, "g")
    start = start.select("g", "level", F.lit(0).cast("long").alias("block"),
                                               F.col("top").alias("subroot"), "path")
    start = materialize(start, f"{name}-root-paths")

    def below(batches):
        def made():
            for r in _rows(batches):
                up = [(s["left"], s["right"]) for s in r["path"]]
                levels = subtree([x["digest"] for x in r["nodes"]], arity, stored_every, r["n"] <= width)
                for node, path in zip(r["nodes"], sibling_paths(levels, arity)):
                    yield r["g"], node["pos"], r["subroot"], [{"left": a, "right": b} for a, b in path + up]
        yield from _in_batches(made(), schema)

    paths = None
    for k in range(len(tree.levels) - 1, -1, -1):
        own = start.where(F.col("level") == k).drop("level")
        paths = own if paths is None else own.unionByName(paths)
        blocks = tree.levels[k].join(paths, ["g", "block"])
        if k:
            paths = materialize(blocks.select("g", "n", "nodes", "subroot", "path").mapInArrow(
                below, f"g string, block long, subroot string, path {STEP}"), f"{name}-paths-{k}")
    return blocks


@dataclass
class Manifest:
    """The stored forest: one tree per group, one tree over the groups' roots, and the root of all (null if empty)."""
    groups: Tree
    upper: Tree | None
    root: str | None


def build_manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang",
                   altered: Column | None = None, arity: int = 8, stored_every: int = 3) -> Manifest:
    """Write the manifest of ``docs`` to the shared folder.

    A leaf digests ``columns`` in this order, each ``-`` if null, else byte
    count, ``:`` and value. Per group, leaves ascend by id (null first, equal
    ids by digest; repeated rows are leaves of their own); a null group is a
    group, before all others. ``altered`` may give another leaf digest per row,
    which ``audit`` holds against the manifest. Other columns are ignored; an
    empty table has no root.
    """
    leaf = leaf_digest(*(F.col(c) for c in columns))
    leaves = docs.select(
        F.when(F.col(group_col).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string"))).alias("g"),
        F.col(id_col).cast("long").alias("id"), leaf.alias("digest"),
        (F.lit(None).cast("string") if altered is None else altered).alias("altered"),
        F.monotonically_increasing_id().alias("tie"))  # tells repeated rows apart; which is which does not matter
    leaves = ranked(materialize(leaves, "merkle-leaves"), ["id", "digest", "tie"], "merkle").drop("tie")
    groups = grow(leaves, "merkle", arity, stored_every, ("id", "altered"))
    tops = groups.roots.select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("top").alias("digest"))
    if tops.isEmpty():
        return Manifest(groups, None, None)
    upper = grow(ranked(tops, ["id"], "merkle-groups"), "merkle-groups", arity, stored_every, ("id",))
    return Manifest(groups, upper, upper.roots.first()["top"])


def _with_paths(manifest: Manifest) -> DataFrame:
    """Leaf blocks of all groups with their paths to the root of all."""
    arity, stored_every = manifest.upper.arity, manifest.upper.stored_every
    width = arity ** stored_every
    schema = pa.schema([("g", pa.string()), ("path", _STEP)])

    def to_groups(batches):
        def made():
            for r in _rows(batches):
                up = [(s["left"], s["right"]) for s in r["path"]]
                levels = subtree([x["digest"] for x in r["nodes"]], arity, stored_every, r["n"] <= width)
                for node, path in zip(r["nodes"], sibling_paths(levels, arity)):
                    yield node["id"], [{"left": a, "right": b} for a, b in path + up]
        yield from _in_batches(made(), schema)

    above = descend(manifest.upper, None, "merkle-groups").select("n", "nodes", "path").mapInArrow(
        to_groups, f"g string, path {STEP}")
    return descend(manifest.groups, materialize(above, "merkle-group-paths"), "merkle")


def _extract(manifest: Manifest, emit, schema: pa.Schema, ddl: str) -> DataFrame:
    arity, stored_every = manifest.groups.arity, manifest.groups.stored_every
    width = arity ** stored_every

    def run(batches):
        def made():
            for r in _rows(batches):
                up = [(s["left"], s["right"]) for s in r["path"]]
                levels = subtree([x["digest"] for x in r["nodes"]], arity, stored_every, r["n"] <= width)
                for node, path in zip(r["nodes"], sibling_paths(levels, arity)):
                    yield emit(node, r["subroot"], path + up)
        yield from _in_batches(made(), schema)

    return _with_paths(manifest).select("n", "nodes", "subroot", "path").mapInArrow(run, ddl)


def proofs(manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """Per leaf: id, leaf, subroot and ``proof``, its siblings (left, right) from the leaf's level to the root."""
    if manifest.root is None:
        return manifest.groups.roots.sparkSession.createDataFrame([], f"{id_col} long, leaf string, subroot string, proof {STEP}")
    schema = pa.schema([(id_col, pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof", _STEP)])

    def emit(node, subroot, path):
        return node["id"], node["digest"], subroot, [{"left": a, "right": b} for a, b in path]

    return _extract(manifest, emit, schema, f"{id_col} long, leaf string, subroot string, proof {STEP}")


def audit(manifest: Manifest, id_col: str = "doc_id") -> DataFrame:
    """Per leaf: id, leaf, subroot, root, proof_sha256 (of its siblings, joined upward, left to right), folded_root
    (from the altered leaf, else its own, and the siblings) and verified (folded_root equals root)."""
    ddl = f"{id_col} long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    root = manifest.root
    if root is None:
        return manifest.groups.roots.sparkSession.createDataFrame([], ddl)
    schema = pa.schema([(id_col, pa.int64()), *((c, pa.string()) for c in (
        "leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])

    def emit(node, subroot, path):
        folded = fold(node["altered"] or node["digest"], path)
        proof = digest("".join(left + right for left, right in path))
        return node["id"], node["digest"], subroot, root, proof, folded, folded == root

    return _extract(manifest, emit, schema, ddl)


def document_audit(docs: DataFrame, arity: int = 8, stored_every: int = 3) -> DataFrame:
    """``audit`` of the documents table by language, where every row whose crc32(doc_id) 3 divides had the capital
    letters A-Z of its text lower-cased after the manifest was made. Rows with a null id are never altered."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = leaf_digest(*(lower if c == "text" else F.col(c) for c in columns))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return audit(build_manifest(docs, columns, altered=F.when(chosen, tampered), arity=arity, stored_every=stored_every))

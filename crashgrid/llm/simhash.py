"""SimHash near-duplicates through one-wildcard segment variants.

Fingerprints within ``max_bits`` bits are cut into ``max_bits // 2 + 1``
segments, so at least one segment differs by one bit at most. Every distinct
segment value is indexed under each of its one-wildcard variants; two values
that meet under a variant differ in exactly that bit, and a variant never
holds more than two values. Fingerprints that meet through equal or paired
segment values are compared in blocks of bounded size.
"""

from __future__ import annotations

from itertools import repeat
from typing import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .components import connected_components
from .shared import free_name, materialize

HASH_SEED = 42
STEP = 1 << 16  # shingles hashed at a time


def fingerprint_bytes(text: bytes | None, shingle: int) -> int:
    """Signed 64-bit SimHash of one text; 0 if it has no words.

    ``bytes.lower`` folds A-Z only and ``bytes.split`` cuts at space and
    \\x09-\\x0D only, which are the word rules of the operator.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        return _signed(xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED))
    total = len(words) - shingle + 1
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, total, STEP):
        part = words[start:start + STEP + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
        n = len(part) - shingle + 1
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(HASH_SEED)), dtype="<u8", count=n)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little"))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint_column(text_col: str, shingle: int = 3):
    """Column: SimHash of a text column as a signed long."""

    @pandas_udf("long")
    def fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_bytes(t, shingle) for t in texts], dtype="int64")

    return fingerprints(F.col(text_col).cast("binary"))


def hex16(col) -> "F.Column":
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def segment_bounds(max_bits: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments that cover 64 bits."""
    count = max_bits // 2 + 1
    edges = [64 * i // count for i in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False)]


def _tile_links(left: np.ndarray, right: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest spanning the links between two blocks of fingerprints.

    Labels sink to the smallest position over the match matrix until nothing
    changes; each fingerprint is then linked to its label's fingerprint, so a
    tile never returns more links than it has members.
    """
    close = np.bitwise_count(left[:, None] ^ right[None, :]) <= max_bits
    if not close.any():
        return left[:0], left[:0]
    far = len(left) + len(right)
    to_left = np.arange(len(left))
    to_right = np.where(close, to_left[:, None], far).min(axis=0)
    while True:
        new_left = np.minimum(to_left, np.where(close, to_right[None, :], far).min(axis=1))
        new_right = np.minimum(to_right, np.where(close, new_left[:, None], far).min(axis=0))
        if (new_left == to_left).all() and (new_right == to_right).all():
            break
        to_left, to_right = new_left, new_right
    hit = to_right < far
    a = np.concatenate([left, right[hit]])
    b = left[np.concatenate([to_left, to_right[hit]])]
    return a[a != b], b[a != b]


def near_links(nodes: DataFrame, max_bits: int = 3, block_rows: int = 256) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``nodes(fp)`` within ``max_bits``.

    ``nodes`` holds distinct signed 64-bit fingerprints. Two fingerprints are
    connected through the result exactly if a chain of pairs within
    ``max_bits`` connects them. Inside a tile the links are a spanning forest,
    so groups of thousands of near copies give no quadratic output.
    """
    bounds = segment_bounds(max_bits)
    cut = F.array(*(F.struct(F.lit(i).alias("seg"),
                             F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << width) - 1)
                                                                       if width < 64 else F.lit(-1)).alias("val"))
                    for i, (lo, width) in enumerate(bounds)))
    members = nodes.select("fp", F.explode(cut).alias("s")).select("fp", "s.seg", "s.val")
    values = materialize(members.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")), "segment-values")

    width_of = F.element_at(F.array(*(F.lit(w) for _, w in bounds)), F.col("seg") + 1)
    # the stored values are few bytes and so few splits; each becomes up to 32 variants
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    variants = values.repartition(parts, "seg", "val").select("seg", "val", F.explode(F.sequence(F.lit(0), width_of - 1)).alias("pos"))
    variants = variants.select("seg", "pos", "val", F.expr("val & ~shiftleft(1L, pos)").alias("rest"))
    crossing = variants.groupBy("seg", "pos", "rest").agg(F.min("val").alias("va"), F.max("val").alias("vb"))
    crossing = crossing.where("va <> vb").select("seg", "va", "vb")
    pairs = materialize(crossing.union(values.where("n > 1").select("seg", F.col("val").alias("va"),
                                                                    F.col("val").alias("vb"))), "segment-pairs")

    used = pairs.select("seg", F.explode(F.array("va", "vb")).alias("val")).distinct()
    sizes = materialize(values.join(used, ["seg", "val"]).select(
        "seg", "val", F.ceil(F.col("n") / block_rows).cast("int").alias("n_blocks")), "segment-sizes")
    blocks = members.join(sizes, ["seg", "val"]).withColumn(
        "block", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"))
    blocks = materialize(blocks.groupBy("seg", "val", "block").agg(F.collect_list("fp").alias("fps")), "blocks")

    left = blocks.select("seg", F.col("val").alias("va"), F.col("block").alias("ba"), F.col("fps").alias("left"))
    right = blocks.select("seg", F.col("val").alias("vb"), F.col("block").alias("bb"), F.col("fps").alias("right"))
    tiles = pairs.join(left, ["seg", "va"]).join(right, ["seg", "vb"])
    tiles = tiles.where("va <> vb or ba <= bb").select("left", "right")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_tile_links(np.asarray(x, dtype=np.int64).view(np.uint64),
                                 np.asarray(y, dtype=np.int64).view(np.uint64), max_bits)
                     for x, y in zip(_lists(batch.column(0)), _lists(batch.column(1)), strict=True)]
            a = np.concatenate([f[0] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            b = np.concatenate([f[1] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return tiles.mapInArrow(link, "a long, b long")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return (flat[i:j] for i, j in zip(ends, ends[1:], strict=False))


def fingerprint_components(nodes: DataFrame, max_bits: int = 3, block_rows: int = 256) -> DataFrame:
    """(fp, root, component_id) from ``nodes(fp, first_id)``.

    ``root`` is the component's smallest fingerprint and names it;
    ``component_id`` is the smallest ``first_id`` in it (nulls ignored).
    """
    roots = connected_components(near_links(nodes.select("fp"), max_bits, block_rows))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    labelled = materialize(labelled.select("fp", "root", "first_id"), "labelled")
    least = materialize(labelled.groupBy("root").agg(F.min("first_id").alias("component_id")), "least-ids")
    return labelled.join(least, "root").select("fp", "root", "component_id")


def _classified(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int,
                block_rows: int) -> DataFrame:
    """(id, fp, root, component_id) per row of ``docs``."""
    prints = docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, shingle).alias("fp"))
    prints = materialize(prints, "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "distinct-prints")
    classes = materialize(fingerprint_components(nodes, max_bits, block_rows), "classes")
    return prints.join(classes, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 3, block_rows: int = 256) -> DataFrame:
    """Per row of ``docs``: id, ``fingerprint`` (16 hex digits), ``component_id``.

    Words are runs without space and \\x09-\\x0D, A-Z lower-cased; shingles are
    ``shingle`` joined words, repeats included (fewer words: the whole
    sequence). A bit is set if over half of the shingles' XXH64 hashes set it.
    Rows link at ``max_bits`` or fewer differing bits; ``component_id`` is the
    smallest id reachable.

    Null, empty and word-less texts have fingerprint zero and link like any
    other. Repeated rows appear as often as in the input. A null id is kept
    and never becomes a component's id unless the component has only null ids
    (then it is null). Other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    rows = _classified(docs, id_col, text_col, shingle, max_bits, block_rows)
    return rows.select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                           max_bits: int = 3, block_rows: int = 256) -> DataFrame:
    """``docs`` without near-duplicates: the row with the smallest id of each component.

    Columns are those of ``docs``. Several rows with the kept id (repeated
    rows, or the null ids of a component that has no other) give one row: the
    one with the smallest fingerprint, and any one of equal rows. Only ids and
    fingerprints are compared; texts move once, to meet the kept ids.
    """
    rows = _classified(docs, id_col, text_col, shingle, max_bits, block_rows)
    first = rows.where("id <=> component_id").groupBy("root").agg(F.min("fp").alias("fp"),
                                                                 F.first("component_id").alias("id"))
    kept_id, kept_fp = free_name(docs, "kept_id"), free_name(docs, "kept_fp")
    kept = materialize(first.select(F.col("id").alias(kept_id), F.col("fp").alias(kept_fp)), "kept")
    met = docs.join(kept, docs[id_col].eqNullSafe(kept[kept_id]))
    met = met.where(fingerprint_column(text_col, shingle) == F.col(kept_fp))
    return met.dropDuplicates([kept_id, kept_fp]).select(*(docs[c] for c in docs.columns))

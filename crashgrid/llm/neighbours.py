"""Nearest neighbours by a block matrix join over int8 tiles.

Vectors are quantised to int8 with one scale each; the norm of what rounding
lost is kept. A tile multiplies a block of queries with a block of candidates
in int8, which bounds every inner product from both sides (Cauchy-Schwarz on
the lost parts). Pairs whose upper bound reaches the k-th best lower bound
survive; they are recomputed in double precision on the original vectors and
merged into one heap of k per query. Tasks own tiles of one query block and
one stripe of candidate blocks, so their work is bounded on both sides; the
heaps of a query's stripes are merged last. The result is exact.
"""

from __future__ import annotations

import heapq
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

LEVELS = 127
_SLACK = 1e-9  # bounds are widened by this share of the norms, above double rounding


def quantise(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, norms, and norms of the rounding error, by row."""
    peak = np.abs(vectors).max(axis=1)
    scale = peak / LEVELS
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    lost = vectors - codes * scale[:, None]
    return codes, scale, np.sqrt((vectors ** 2).sum(axis=1)), np.sqrt((lost ** 2).sum(axis=1))


def tile_bounds(queries, candidates) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products between two quantised blocks.

    int8 products summed in float32 are exact up to about 1,000 dimensions
    (127 * 127 * 1,040 < 2**24); wider vectors are summed in float64.
    """
    (qc, qs, qn, ql), (cc, cs, cn, cl) = queries, candidates
    kind = np.float32 if qc.shape[1] <= 1024 else np.float64
    middle = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    # <q, c> - <q', c'> = <q - q', c> + <q', c - c'>, and |q'| <= |q| + |q - q'|
    reach = ql[:, None] * cn[None, :] + (qn + ql)[:, None] * cl[None, :]
    reach += _SLACK * qn[:, None] * cn[None, :]
    return middle - reach, middle + reach


def exact_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed dimension by dimension in double precision."""
    out = np.zeros(len(queries))
    for d in range(queries.shape[1]):
        out += queries[:, d] * candidates[:, d]
    return out


def search_tile(heaps: dict, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> None:
    """Offer a tile's candidates to the heaps of its queries; heap items are (score, -vec_id)."""
    low, high = tile_bounds(quantise(q), quantise(c))
    own = q_ids[:, None] == c_ids[None, :]
    low[own], high[own] = -np.inf, -np.inf
    floor = np.full(len(q_ids), -np.inf)
    if low.shape[1] > k:
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k]
    for i, query in enumerate(q_ids.tolist()):
        if len(heaps.get(query, ())) == k:
            floor[i] = max(floor[i], heaps[query][0][0])
    rows, columns = np.nonzero((high >= floor[:, None]) & ~own)
    for start in range(0, len(rows), 1 << 16):
        r, s = rows[start:start + (1 << 16)], columns[start:start + (1 << 16)]
        for query, vec, score in zip(q_ids[r].tolist(), c_ids[s].tolist(), exact_scores(q[r], c[s]).tolist(),
                                     strict=True):
            heap = heaps.setdefault(query, [])
            if len(heap) < k:
                heapq.heappush(heap, (score, -vec))
            elif (score, -vec) > heap[0]:
                heapq.heapreplace(heap, (score, -vec))


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
            k: int = 20, block_rows: int = 1024, stripe_blocks: int = 16, block_bytes: int = 8 << 20) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product, for each row of ``queries``.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id; a query is never its own neighbour (by id). Vectors that are
    null, empty, all zero, or hold null or non-finite components take no
    part, on either side, nor do null ids. Repeated rows (equal id) count
    once, with the smallest vector. Vectors of another length than a query's
    are no candidates for it. Fewer candidates than ``k`` are all returned;
    empty tables give no rows.

    A block has ``block_rows`` vectors, fewer if they are wider than
    ``block_bytes`` together; a task's tile is a query block against
    ``stripe_blocks`` candidate blocks.
    """
    vector = F.col(vector_col).cast("array<double>")
    usable = (F.col("id").isNotNull() & (F.size("v") > 0)
              & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
              & F.exists("v", lambda x: x != 0))

    def blocks(table: DataFrame, name: str) -> DataFrame:
        rows = table.select(F.col(id_col).cast("long").alias("id"), vector.alias("v")).where(usable)
        rows = rows.groupBy("id").agg(F.min("v").alias("v")).withColumn("width", F.size("v"))
        rows = materialize(rows, name)
        fit = F.greatest(F.lit(1), F.least(F.lit(block_rows), F.floor(F.lit(block_bytes) / (8 * F.col("width")))))
        count = rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).select(
            "width", F.ceil(F.col("n") / fit).cast("int").alias("blocks"))
        # hashed into blocks of about block_rows, whatever the ids look like
        dealt = rows.join(count, "width").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        return materialize(dealt.groupBy("width", "blocks", "block").agg(
            F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("values")), name + "-blocks")

    query_blocks, candidate_blocks = blocks(queries, "query-vectors"), blocks(vectors, "candidate-vectors")
    # Every candidate block meets every query block of its width, as the search demands: candidate blocks are
    # copied once per query block, query blocks once per stripe, and both meet under the tile's two numbers.
    stripes = candidate_blocks.select("width", F.ceil(F.col("blocks") / stripe_blocks).cast("int").alias("stripes")).distinct()
    per_width = query_blocks.select("width", F.col("blocks").alias("query_blocks")).distinct()
    asked = query_blocks.join(stripes, "width").select(
        "width", "block", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"), "ids", "values")
    candidates = candidate_blocks.join(per_width, "width").select(
        "width", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("block"),
        F.floor(F.col("block") / stripe_blocks).cast("int").alias("stripe"),
        F.col("ids").alias("c_ids"), F.col("values").alias("c_values"))
    tiles = asked.join(candidates, ["width", "block", "stripe"]).select("width", "ids", "values", "c_ids", "c_values")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column(0)[i].as_py()
                q_ids, q, c_ids, c = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in (1, 2, 3, 4))
                search_tile(heaps, q_ids, q.reshape(-1, width), c_ids, c.reshape(-1, width), k)
        found = [(query, -vec, score) for query, heap in heaps.items() for score, vec in heap]
        for start in range(0, len(found), 50_000):
            part = list(zip(*found[start:start + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()),
                                              pa.array(part[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = tiles.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    """Row count and an order-free checksum of an edge table."""
    row = edges.agg(F.count(F.lit(1)).alias("n"),
                    F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _to_smallest(neighbours: DataFrame, name: str) -> DataFrame:
    """Add ``m``, the smallest of ``u`` and its neighbours ``v``, to each (u, v).

    The minimum is a partial aggregate. It is written out before it is joined
    back, so both join sides are plain exchanges and adaptive execution can
    split a node that has very many neighbours.
    """
    mins = neighbours.groupBy("u").agg(F.min("v").alias("least_v"))
    mins = materialize(mins.select("u", F.least("u", "least_v").alias("m")), name)
    return neighbours.join(mins, "u")


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root: smallest reachable node.

    Each round links every node's larger neighbours to its smallest neighbour
    (large star), then every node's smaller neighbours to the smallest (small
    star). It ends when a round leaves the table unchanged: then each node is
    linked to its component's minimum only. Rounds grow with the logarithm of
    the component size. Self-links and nulls are ignored; no edges give no
    rows. Raises ``RuntimeError`` if ``max_rounds`` do not suffice.
    """
    a, b = F.col("a").cast("long"), F.col("b").cast("long")
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), (a != b).alias("use"))
    edges = materialize(edges.where("use").select("a", "b").distinct(), "links")
    state = _fingerprint(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_smallest(both, "large-mins").where("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        small = _to_smallest(large, "small-mins")
        small = small.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            small.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
        edges = materialize(small, "small-star")
        before, state = state, _fingerprint(edges)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

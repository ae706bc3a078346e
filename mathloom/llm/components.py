"""Connected components by alternating large-star and small-star contraction.

Joins are of rows to one row a node, so a node with very many neighbours is skew of one side only, which
the adaptive skew join splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathloom.storage import drop, materialize


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v), distinct again afterwards."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = (
        both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").select(
        F.explode(
            F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        ).alias("e")
    )
    return small.select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Rows (node, component): component is the smallest node id reachable from node.

    ``edges`` holds pairs of comparable ids in columns ``a`` and ``b``; direction, repetition
    and self loops do not matter, rows with a null end are ignored. Nodes without an edge to
    another node are not returned. Nothing is gathered on the driver but two numbers a round;
    every round is written to the shared folder, so lineage does not grow.
    """
    x, y = F.col(a), F.col(b)
    now = materialize(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(),
        "edges",
    )
    state = None
    for _ in range(max_rounds):
        nxt = materialize(_stars(now), "edges")
        drop(now)
        now = nxt
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        state = seen
    raise RuntimeError("components did not settle")

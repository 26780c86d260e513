"""Connected components of a distributed edge table (alternating large and small stars).

Each round replaces a node's edges by edges to its smallest neighbour, until the table stops changing;
what is left is a star per component. Only edges are handled, so nodes without one cost nothing.
A hub is no bottleneck: minima are combined map-side, and rows of a hub meet its one minimum in a
join that adaptive execution may split. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    out = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have u > v: all of v are smaller neighbours of u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    joined = edges.join(least, F.col("u") == F.col("w"))
    out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return out.select("e.u", "e.v").where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node that has an edge, and the smallest node it is connected to.

    ``edges``: two long columns ``u`` and ``v``, in either direction, repeats and loops allowed; edges
    with a null end are left out.
    """
    now = materialize(
        edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        again = _mark(now)
        if again == mark or again[0] == 0:
            break
        mark = again
        following = materialize(_small_star(_large_star(now)), "edges")
        drop_scratch(now)
        now = following
    else:
        raise RuntimeError("components didn't settle")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.lit(0)), F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0))).first()
    return tuple(row)

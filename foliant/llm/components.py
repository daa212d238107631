"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Scratch


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Each round replaces an edge by one to a smaller node of the same component, until every edge
    points at the smallest one. The tables of each round are written to the shared folder, so a
    lost executor costs no more than that round, and both sides of each join come from an exchange
    that adaptive execution can split where a hub holds many edges. The joins are sort-merge ones at
    every size, as nodes grow with the edges and none are to be collected in the driver. Edges with a null end, and
    loops, are no links; an empty table gives an empty one.
    """
    cur = scratch.write(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    sign = _sign(cur)
    while sign[0]:
        low = scratch.write(cur.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "low")
        large = scratch.write(
            cur.join(low.hint("merge"), cur.v == low.k, "left").select("u", F.coalesce("m", "v").alias("v")).distinct(), "large"
        )
        low2 = scratch.write(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low2.hint("merge"), large.u == low2.k)
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .union(low2.select("k", "m"))
            .distinct()
        )
        new = scratch.write(small, "edges")
        for old in (cur, low, large, low2):
            scratch.drop(old)
        was, cur = sign, new
        sign = _sign(cur)
        if sign == was:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _sign(edges: DataFrame) -> tuple:
    """Count and two checksums; the edges are distinct, so equal signs mean equal tables."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())

"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakesteward.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of the directed edges."""
    mark = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum((mark % 2**31).cast("decimal(38,0)")), F.bit_xor(mark)).first())


def components(edges: DataFrame) -> DataFrame:
    """``row``, ``component``: the smallest node of the component, for every node of ``edges`` (a, b).

    Both steps join every edge with the smallest neighbour of one of its ends. The edges are the
    left side, so that a node with very many of them is split, and smallest neighbours come from an
    aggregation that combines within tasks. Every step is stored; self loops only name their node.
    """
    nodes = edges.select(F.col("a").alias("row")).unionByName(edges.select(F.col("b").alias("row"))).distinct()
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = saved(current, "components")
    before = _state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: larger neighbours hang on the smallest one
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = saved(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: smaller neighbours and the node itself hang on the smallest one
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        current = saved(small, "components")
        after = _state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("u").alias("row"), F.col("v").alias("component"))
    return nodes.join(roots, "row", "left").select("row", F.coalesce("component", "row").alias("component"))

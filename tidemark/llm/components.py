"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import drop, keep, keep_counted, meet


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a written table, and their number and a sum over them, seen while writing."""
    seen = Observation()
    edges = keep(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)).alias("sum")), "stars")
    return edges, (seen.get["n"], seen.get["sum"] or 0)


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of links (a, b) that isn't the smallest of its component.

    Each round hangs every node below the smallest neighbour it sees, so chains halve;
    no node's neighbours are gathered, only their minimum, and a node with many stays spread
    over tasks. Each round is written to the shared folder, and so is the result. Self links and nulls are ignored;
    no links give no rows.
    """
    edges, before = _kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u <> v").distinct())
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        least, n = keep_counted(least, "least")
        large = meet(both, least, n, "u", 2 * before[0]).filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        old = edges
        edges, after = _kept(small)
        drop(old, least)
        if after == before:
            break
        before = after
    out = keep(edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id"), "components")
    drop(edges)
    return out

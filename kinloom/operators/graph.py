"""Claims that faces are one person, closed transitively."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .blocks import numbered


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, by large-star and small-star rounds."""
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    while True:
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            break
        state = seen
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def truth(claims: DataFrame, excluded: DataFrame) -> DataFrame:
    """(node, label) from claims (a, b): labels T1, T2, ... by falling size; excluded nodes (node) still pass claims on; groups of one count for nothing."""
    comp = components(claims).join(excluded.select("node"), "node", "left_anti")
    sizes = comp.groupBy("component").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    named = numbered(sizes, [F.col("n").desc(), "first"], "place").select("component", F.concat(F.lit("T"), (F.col("place") + 1).cast("string")).alias("label"))
    return comp.join(named, "component").select("node", "label")


def contradictions(components_: DataFrame, different: DataFrame) -> DataFrame:
    """Pairs (a, b) called different whose nodes are in one component."""
    of = lambda c: components_.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    return different.join(of("a"), "a").join(of("b"), "b").where("ca = cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """Edges a, b (any order, repeats and loops allowed) -> node, root: the smallest node it reaches.

    Alternates large-star and small-star steps: both keep the components and shorten the paths, until
    every edge leads to a root. Each step aggregates before it shuffles, and its result is written to the
    checkpoint folder, so a lost executor costs one step at most.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = mark
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(least, large["a"] == least["u"]).select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        now = checkpointed(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a <> b").distinct())

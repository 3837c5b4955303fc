"""Connected components of an edge table that may be larger than any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattloom.llm.common import delete_dir, materialise, shared_dir


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that each node with an edge reaches. Nodes without edges have no row.

    Alternating star steps. In the large step every neighbour above a node is tied to the node's least neighbour; in the
    small step those below are. Stars only ever flatten, so the rounds grow with the logarithm of the longest chain, and
    no step puts a component in one task: minima are combined before the shuffle and joins may be split.
    Each round is written to the shared folder, and the round before is deleted.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    here = shared_dir(spark)
    pairs = materialise(pairs, here)
    state = _fingerprint(pairs)
    while True:
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        moved = small.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        next_pairs = moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        there = shared_dir(spark)
        pairs = materialise(next_pairs, there)
        delete_dir(spark, here)
        here, before, state = there, state, _fingerprint(pairs)
        if state == before:
            break
    root = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root.withColumn("component", F.col("node")))


def _fingerprint(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]

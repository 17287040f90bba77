"""Connected components of a table of links, by alternating star contraction.

Every round links the neighbours of a node to the smallest of them, first those
above it, then those below.  Minima are partial aggregates and the joins back
may be split by Spark, so a node with a third of all links is no single task.
Each round is written to the shared folder; only two numbers reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavec.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("u", "v")
    lowest = both.groupBy("u").agg(F.min("v").alias("m"))
    lowest = lowest.select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").filter("v != m").select("v", "m")
    return moved.union(lowest.select("u", "m")).toDF("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes of ``links(a, b)`` but the roots themselves.

    ``root`` is the smallest node of the component.
    """
    current = stored(links.filter("a != b").select("a", "b").distinct(), "links")
    seen = None
    # every round brings nodes nearer to their root, so it ends
    while True:
        current = stored(_small_star(_large_star(current)).distinct(), "links")
        mark = current.agg(
            F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("a", "b") % 1000003)
        ).first()
        if mark == seen:
            return current.toDF("node", "root")
        seen = mark

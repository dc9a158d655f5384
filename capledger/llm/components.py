"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.sources.scratch import stored

MAX_ROUNDS = 60


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    return moved.unionByName(least.withColumnRenamed("m", "v")).distinct()


def component_labels(links: DataFrame) -> DataFrame:
    """(node, component): each linked node and the least node it is connected with.

    ``links`` has node columns u and v; direction, repeats and loops don't matter.
    Nodes without links are not in the result. Every round writes its table, so a lost
    executor costs a read; nothing but a count and a checksum reaches the driver.
    """
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = stored(ordered, "links")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        now = stored(_small_star(stored(_large_star(now), "large-star")), "small-star")
        last, state = state, _state(now)
        if last == state:
            break
    else:
        raise RuntimeError("the links did not contract")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()

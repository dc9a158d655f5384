"""Exact medians of groups too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capledger.functions.columns import computed_once
from capledger.operators.bounded import lookup_join
from capledger.sources.scratch import stored

BLOCKS = 256        # cuts of a large group
STRIDE = 16         # every 16th cut is compared first, then the 15 behind it
SMALL_GROUP = 20_000  # rows, or distinct values with their counts, that one task may sort


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """(keys, out): the median of ``value`` per group, the mean of the middle two for even counts.

    Equal values are counted first, and the counts stored. Groups of up to ``SMALL_GROUP`` rows are one
    aggregate each. Approximate quantiles cut each larger group into
    blocks of about 1/256 of its distinct values; only block totals are ranked per
    group, and the block that holds the middle is cut again until one task may sort it.
    """
    given, group = keys, "__group"
    if keys:  # one key, so that NULLs meet in joins as they do in groups
        df, keys = df.withColumn(group, F.struct(*keys)), [group]
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    counts = stored(rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")), "counts")
    large = stored(counts.groupBy(*keys).agg(F.sum("n").alias("m"), F.count(F.lit(1)).alias("values")).where(F.col("m") > SMALL_GROUP), "large-groups")
    most = large.agg(F.max("values")).first()[0]

    def direct(few: DataFrame) -> DataFrame:
        return few.groupBy(*keys).agg(F.percentile("v", 0.5, F.col("n")).alias(out)).select(*[F.col(f"{group}.{c}") for c in given], out)

    if most is None:
        return direct(counts)
    if not keys:
        return _median_by_blocks(counts.withColumn(group, F.lit(0)), [group], most, True).select(F.col("median").alias(out))
    big = large.select(*keys)
    found = _median_by_blocks(lookup_join(counts, big, keys, "left_semi"), keys, most, False).select(*[F.col(f"{group}.{c}") for c in given], F.col("median").alias(out))
    return found.unionByName(direct(lookup_join(counts, big, keys, "left_anti")))


def _median_by_blocks(counts: DataFrame, keys: list[str], most: int, single: bool) -> DataFrame:
    """(keys, median) of groups that are too large for one task, from the counts of their values.

    A round keeps the block of a group that holds its middle, or the two that do: with the error of the cuts
    at most 1/102 of its distinct values, of which a group has ``most``. Rounds go on until ``SMALL_GROUP`` are
    left, or ``BLOCKS`` where that is more. ``single`` tells that there is one group.
    """
    ranks = None
    while True:
        placed = _placed(counts, keys, single)
        whole = Window.partitionBy(*keys)
        blocks = placed.groupBy(*keys, "block").agg(F.sum("n").alias("size")).withColumns({
            "start": F.sum("size").over(whole.orderBy("block")) - F.col("size"), "m": F.sum("size").over(whole)})
        blocks = blocks.withColumns({"lo": F.floor((F.col("m") + 1) / 2), "hi": F.floor((F.col("m") + 2) / 2)}) if ranks is None else blocks.join(ranks, keys)
        middle = stored(blocks.where((F.col("start") < F.col("hi")) & (F.col("start") + F.col("size") >= F.col("lo"))).select(*keys, "block", "start", "lo", "hi"), "middle")
        ranks = middle.groupBy(*keys).agg((F.min("lo") - F.min("start")).alias("lo"), (F.min("hi") - F.min("start")).alias("hi"))
        counts = lookup_join(placed, middle.select(*keys, "block"), [*keys, "block"], "left_semi", tiny=single).drop("block")
        most = most * 5 // (2 * BLOCKS) + 1
        if most <= max(SMALL_GROUP, BLOCKS):
            break
        counts = stored(counts, "middle-values")
    ranked = counts.join(ranks, keys).withColumn("last", F.sum("n").over(Window.partitionBy(*keys).orderBy("v")))

    def at(rank: str):
        here = (F.col(rank) <= F.col("last")) & (F.col(rank) > F.col("last") - F.col("n"))
        return F.max(F.when(here, F.col("v")))

    return ranked.groupBy(*keys).agg(((at("lo") + at("hi")) / 2).alias("median"))


def _placed(counts: DataFrame, keys: list[str], single: bool) -> DataFrame:
    """(keys, v, n, block): where each value stands among some 256 cuts of its group."""
    steps = [i / BLOCKS for i in range(1, BLOCKS)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("v", steps, F.lit(8 * BLOCKS)).alias("cuts"))
    met = lookup_join(counts, cuts if single else stored(cuts, "cuts"), keys, "inner", tiny=single)
    coarse = F.filter("cuts", lambda c, i: (i + 1) % STRIDE == 0)
    return computed_once(met, {"c": _below(coarse)}).select(
        *keys, "v", "n",
        (F.col("c") * STRIDE + _below(F.slice("cuts", F.col("c") * STRIDE + 1, F.lit(STRIDE - 1)))).alias("block"),
    )


def _below(cuts):
    return F.size(F.filter(cuts, lambda c: c < F.col("v")))

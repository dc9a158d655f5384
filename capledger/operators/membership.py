"""Comparing a population of entities with a reference list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.operators.bounded import few_rows, lookup_join
from capledger.sources.scratch import stored


def flag_membership(df: DataFrame, listed: DataFrame, on: str, flag: str = "is_listed") -> DataFrame:
    """Adds whether ``on`` occurs in ``listed``; every row is kept, NULL keys are not listed."""
    names = listed.select(on).where(F.col(on).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return lookup_join(df, names, [on], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def flag_any_member(df: DataFrame, listed: DataFrame, keys: str, on: str, flag: str = "is_listed") -> DataFrame:
    """Like ``flag_membership`` for an array of keys: true when any of them is listed.

    A short list is held against each array in place. Beyond that the rows are stored under
    a number of their own, and their keys looked up.
    """
    names = listed.select(on).where(F.col(on).isNotNull()).distinct()
    few = few_rows(names)
    if few is not None:
        held = F.array(*[F.lit(r[0]) for r in few]).cast(f"array<{names.schema[on].dataType.simpleString()}>")
        return df.withColumn(flag, F.coalesce(F.arrays_overlap(keys, held), F.lit(False)))
    rows = stored(df.withColumn("__row", F.monotonically_increasing_id()), "keyed-rows")
    each = rows.select("__row", F.explode(keys).alias(on))
    hits = flag_membership(each, names, on, flag).where(flag).select("__row").distinct().withColumn(flag, F.lit(True))
    return rows.join(hits, "__row", "left").withColumn(flag, F.coalesce(flag, F.lit(False))).drop("__row")


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, n): how many distinct keys are in both populations, or in one only.

    Each side is reduced to its distinct keys before they meet, by one grouping
    over the union of both.
    """
    tagged = left.select(F.col(key), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(F.col(key), F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    sides = tagged.where(F.col(key).isNotNull()).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    side = F.when((F.col("l") == 1) & (F.col("r") == 1), "both").when(F.col("l") == 1, "left_only").otherwise("right_only")
    return sides.groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("n"))


def non_filers(listed: DataFrame, filings: DataFrame, key: str, area: str, monthly_rate: Column) -> DataFrame:
    """Listed entities without a filing, and what a month of not filing costs them."""
    filed = filings.select(key).where(F.col(key).isNotNull()).distinct()
    missing = listed.join(filed, key, "left_anti")
    return missing.withColumn("monthly_penalty", F.col(area) * monthly_rate)

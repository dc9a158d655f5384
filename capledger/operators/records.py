"""Extracted records on their way into the fact tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.functions.columns import computed_once
from capledger.functions.vocabulary import FactKind
from capledger.operators.bounded import lookup_join
from capledger.operators.ordered import first_per_key
from capledger.sources.scratch import stored
from capledger.sources.tables import read_table

NUMBER = "decimal(38,18)"
BUCKET, BUCKETS = "_key_bucket", 256


def rows_by_column(
    matches: DataFrame, rows: DataFrame, on: list[str], label: str, value: str,
    label_column: str = "label_column", value_column: str = "value_column", cells: str = "cells",
) -> DataFrame:
    """Label and value of every row of the matched tables, from the columns each match names.

    Rows that lack one of the two are left out.
    """
    hit = lookup_join(rows, matches, on, "inner")
    read = hit.withColumns({
        label: F.try_element_at(cells, F.col(label_column)),
        value: F.try_element_at(cells, F.col(value_column)),
    })
    return read.where(F.col(label).isNotNull() & F.col(value).isNotNull()).drop(cells, label_column, value_column)


def stamp_from_parent(df: DataFrame, parents: DataFrame, on: str, column: str) -> DataFrame:
    """What is known of the document overrides what its records say."""
    known = parents.select(on, F.col(column).alias("__known"))
    joined = lookup_join(df, known, [on], "left")
    return joined.withColumn(column, F.coalesce("__known", column)).drop("__known")


@dataclass(frozen=True)
class Rules:
    required: tuple[str, ...]
    numbers: tuple[str, ...]
    allowed: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @classmethod
    def of(cls, kind: FactKind, strict: bool = False) -> Rules:
        allowed = ((kind.label, kind.allowed),) if strict and kind.allowed else ()
        return cls(kind.required, (kind.number,), allowed)


def one_number(c: Column) -> Column:
    """Text that is exactly one number; two numbers in a cell are none."""
    return F.trim(c.cast("string")).try_cast(NUMBER)


def validate(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(ok, rejected): ok rows have typed numbers; rejected rows have ``failing``, the fields
    that are missing or not usable, and a ``reason`` that names them."""
    failing = [F.when(F.col(c).isNull(), c) for c in rules.required]
    failing += [F.when(one_number(F.col(c)).isNull(), c) for c in rules.numbers]
    failing += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*ok), c) for c, ok in rules.allowed]
    judged = computed_once(df, {"__bad": F.filter(F.array(*failing), lambda c: c.isNotNull())})
    ok = judged.where(F.size("__bad") == 0).drop("__bad").withColumns(
        {c: one_number(F.col(c)) for c in rules.numbers}
    )
    rejected = judged.where(F.size("__bad") > 0).withColumnRenamed("__bad", "failing").withColumn(
        "reason", F.concat(F.lit("not usable: "), F.array_join("failing", ", ")))
    return ok, rejected


def insert_new(target: DataFrame, batch: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows of ``batch`` to append: new keys only, the first in ``order`` of each.

    NULL key columns equal each other. A key repeated many times shrinks to one row
    before it is shuffled.
    """
    first = first_per_key(batch, key, [F.col(c).asc_nulls_last() for c in order])
    held = target.select(*[F.col(c).alias(f"__{c}") for c in key])
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return first.join(held, same, "left_anti")


def add_new(spark: SparkSession, path: str, batch: DataFrame, key: list[str], order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Appends what ``insert_new`` says to a table kept in hash buckets of the key, and returns it.

    Of the table, only the key columns of the buckets that the batch has keys in are read. The append is one
    commit, so a batch that failed can be given again, and one given twice adds nothing the second time.
    ``key`` and ``buckets`` must not change over a table's life, nor the types of the key columns, as their
    hash decides the bucket: that raises ValueError. Two batches must not be added at the same moment.
    """
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    batch = stored(first_per_key(batch, key, [F.col(c).asc_nulls_last() for c in order]).withColumn(BUCKET, bucket), "batch")
    held = read_table(spark, path, merge=False)
    if held is None:
        fresh = batch
    else:
        changed = [c for c in key if held.schema[c].dataType != batch.schema[c].dataType]
        if changed:
            raise ValueError(f"the table has other types of {changed}")
        touched = sorted(r[0] for r in batch.select(BUCKET).distinct().collect())  # as many as buckets
        fresh = stored(insert_new(held.where(F.col(BUCKET).isin(touched)), batch, key, order), "added")
    fresh.hint("rebalance", BUCKET).write.mode("append").partitionBy(BUCKET).parquet(path)
    return fresh.drop(BUCKET)


def read_added(spark: SparkSession, path: str) -> DataFrame | None:
    """What ``add_new`` has added so far."""
    held = read_table(spark, path)
    return None if held is None else held.drop(BUCKET)


def extraction_counts(records: DataFrame, rejected: DataFrame, concept: str = "concept") -> DataFrame:
    """(concept, extracted, skipped): records before validation and how many it rejected."""
    both = records.select(concept, F.lit(1).alias("r"), F.lit(0).alias("s")).unionByName(
        rejected.select(concept, F.lit(0).alias("r"), F.lit(1).alias("s"))
    )
    return both.groupBy(concept).agg(F.sum("r").alias("extracted"), F.sum("s").alias("skipped"))


def union_records(from_tables: DataFrame, from_prose: DataFrame) -> DataFrame:
    return from_tables.unionByName(from_prose, allowMissingColumns=True)

"""What a reader asks of the projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.functions.filings import USAGE_LABELS
from capledger.operators.rollup import entity_verdict, mix_shares
from capledger.sources.tables import read_table, write_table

ROW_GROUP_BYTES = 16 * 1024 * 1024  # a lookup reads at least one row group of each column
_INDEX = "_files"                   # in the table's folder, where scans of the table do not see it


def entity_lookup(projections: DataFrame, entity: str, value, order: str = "period_start") -> DataFrame:
    """One entity's rows in period order; the filter reaches the scan."""
    return projections.where(F.col(entity) == value).orderBy(order)


def write_serving(projections: DataFrame, path: str, entity: str = "property_id", order: str = "period_start", row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Replaces the table that readers look entities up in.

    Rows are dealt by ranges of (entity, order) and sorted, so that an entity is in one file or
    a few that follow one another, however many rows it has; row groups are small and have a Bloom filter of the
    entity. An index of each file's first and last entity is written into the table's folder and takes
    its place together with it.
    """
    placed = projections.repartitionByRange(F.col(entity), F.col(order)).sortWithinPartitions(entity, order)
    write_table(placed, path, options={
        "parquet.block.size": str(row_group_bytes), f"parquet.bloom.filter.enabled#{entity}": "true",
    }, finish=lambda beside: _index_files(projections.sparkSession, beside, entity))


def _index_files(spark: SparkSession, path: str, entity: str) -> None:
    """(file_name, first, last) of each file, NULL entities left out, in one pass over one column."""
    held = read_table(spark, path, merge=False)
    if held is None:
        return
    names = held.select(F.col("_metadata.file_name").alias("file_name"), F.col(entity).alias("e"))
    spans = names.groupBy("file_name").agg(F.min("e").alias("first"), F.max("e").alias("last"))
    spans.where("first IS NOT NULL").orderBy("first").write.parquet(f"{path}/{_INDEX}")


def files_of(spark: SparkSession, path: str, value) -> list[str]:
    """The files of a serving table that may hold this entity: those whose span includes it."""
    index = spark.read.parquet(f"{path.rstrip('/')}/{_INDEX}")
    hit = index.where(F.lit(value).between(F.col("first"), F.col("last")))
    return sorted(f"{path.rstrip('/')}/{r['file_name']}" for r in hit.select("file_name").collect())


def serving_lookup(spark: SparkSession, path: str, value, entity: str = "property_id", order: str = "period_start") -> DataFrame:
    """One entity's rows in order, from the files that the index names; no other file is opened."""
    held = read_table(spark, path, merge=False)
    if held is None:
        raise ValueError(f"no serving table at {path}")
    files = files_of(spark, path, value)
    rows = spark.read.schema(held.schema).parquet(*files) if files else held.where("false")
    return entity_lookup(rows, entity, value, order)


def verdicts(projections: DataFrame) -> DataFrame:
    return entity_verdict(projections, "property_id", "potential_penalty_usd")


def usage_mix(projections: DataFrame) -> DataFrame:
    """Usage shares of each property; its usage is the same in all periods, so one is read."""
    first = projections.groupBy("property_id").agg(
        F.min_by(F.struct(*USAGE_LABELS), "period_start").alias("u")
    ).select("property_id", "u.*")
    return mix_shares(first, ["property_id"], USAGE_LABELS)

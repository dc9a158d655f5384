"""Versions of documents: one active version per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.operators.bounded import lookup_join
from capledger.operators.ordered import first_per_key, ordered_scan
from capledger.sources.scratch import stored


def version_history(deliveries: DataFrame, key: str, order: list[str], content: str, block: Column) -> DataFrame:
    """(key, order, content, version_id, active_flag): a version per change of content.

    A delivery equal to the one before it is skipped. ``block`` cuts the deliveries
    of one key into ordered pieces, see ``ordered_scan``.
    """
    seen = ordered_scan(deliveries.select(key, *order, content), [key], order, block,
                        previous={"__before": F.struct(F.col(content))})
    changed = seen.where(F.col("__before").isNull() | ~F.col(f"__before.{content}").eqNullSafe(F.col(content)))
    return ordered_scan(
        stored(changed.drop("__before"), "versions"), [key], order, block,
        totals={"version_id": F.lit(1)}, following={"__next": F.lit(1)},
    ).withColumn("active_flag", F.col("__next").isNull()).drop("__next")


def active_versions(registry: DataFrame, key: str = "document_key") -> DataFrame:
    """The highest active version of each key."""
    return first_per_key(registry.where("active_flag"), [key], [F.col("version_id").desc()])


def upsert_versions(registry: DataFrame, incoming: DataFrame, force: bool = False, order: list[str] | None = None) -> DataFrame:
    """The registry after a delivery of documents, with what happened to each row.

    ``incoming`` has document_key, document_hash and embed_model; of several deliveries
    of one key the last in ``order`` counts, ties settled by the least hash. ``outcome`` is
    kept, skipped (same content), replaced (no longer active) or added. A new version has
    the number after the highest one that the key ever had, active or not.
    """
    fresh = first_per_key(incoming, ["document_key"], [*[F.col(c).desc_nulls_last() for c in order or []], F.col("document_hash")])
    highest = registry.groupBy("document_key").agg(F.max("version_id").alias("__highest"))
    now = active_versions(registry).select(
        "document_key", F.col("document_hash").alias("__old"), F.col("version_id").alias("__version")
    )
    judged = fresh.join(now, "document_key", "left").join(highest, "document_key", "left").withColumn(
        "__same", F.coalesce(F.col("__old") == F.col("document_hash"), F.lit(False)) & F.lit(not force)
    )
    version = F.coalesce(F.col("__highest"), F.lit(0)) + 1
    added = judged.where(~F.col("__same")).select(
        F.sha2(F.concat_ws("|", "document_key", version.cast("string")), 256).alias("rag_id"),
        "document_key", "document_hash", "embed_model",
        version.alias("version_id"), F.lit(True).alias("active_flag"), F.lit("added").alias("outcome"),
    )
    verdict = judged.select("document_key", "__same", F.col("__version"))
    standing = lookup_join(registry, verdict, ["document_key"], "left")
    hit = F.col("active_flag") & (F.col("version_id") == F.col("__version"))
    outcome = F.when(hit & F.col("__same"), "skipped").when(hit & ~F.col("__same"), "replaced").otherwise("kept")
    old = standing.withColumn("outcome", outcome).withColumn(
        "active_flag", F.when(F.col("outcome") == "replaced", False).otherwise(F.col("active_flag"))
    )
    return old.select(*added.columns).unionByName(added)

"""Summaries of filings and projections."""

from __future__ import annotations

from functools import reduce
from operator import and_

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from capledger.functions.columns import AMOUNT, quantity
from capledger.operators.compliance import COMPLIANT, EXCEEDS, NO_CAP
from capledger.operators.quantile import exact_median
from capledger.sources.scratch import stored


_YEARS = 100_000


def entity_verdict(projections: DataFrame, entity: str, penalty: str = "penalty") -> DataFrame:
    """One row per entity: from when it exceeds its cap and the largest penalty,
    or that no cap is known, or until when it is compliant."""
    exceeds = F.col("status") == EXCEEDS
    # Both years of a period in one number, which hash aggregation can carry.
    period = F.col("period_start").cast("long") * _YEARS + F.col("period_end")
    per_entity = projections.groupBy(entity).agg(
        F.min(F.when(exceeds, period)).alias("__first"),
        F.max(F.when(exceeds, F.coalesce(F.col(penalty), F.lit(0)))).alias("max_penalty"),
        F.bool_and(F.col("status") == NO_CAP).alias("__unknown"),
        F.max(period).alias("__last"),
    )
    verdict = (
        F.when(F.col("__first").isNotNull(), EXCEEDS).when(F.col("__unknown"), NO_CAP).otherwise(COMPLIANT)
    )
    return per_entity.select(
        entity,
        verdict.alias("verdict"),
        F.floor(F.col("__first") / _YEARS).cast("int").alias("exceeds_from"),
        (F.col("__first") % _YEARS).cast("int").alias("exceeds_to"),
        "max_penalty",
        F.when(verdict == COMPLIANT, F.col("__last") % _YEARS).cast("int").alias("compliant_through"),
    )


def mix_shares(df: DataFrame, keep: list[str], measures: Mapping[str, str]) -> DataFrame:
    """(keep, measure, usage, share): the non-zero usages of each row as shares of their sum."""
    used = [F.struct(F.lit(label).alias("measure"), F.col(c).alias("usage")) for c, label in measures.items()]
    present = F.filter(F.array(*used), lambda m: m["usage"].isNotNull() & (m["usage"] != 0))
    whole = F.aggregate(present, F.lit(0.0), lambda acc, m: acc + m["usage"])
    return df.select(*keep, F.inline(present), whole.alias("__whole")).select(
        *keep, "measure", "usage", (F.col("usage") / F.nullif(F.col("__whole"), F.lit(0.0))).alias("share")
    )


def contribution_shares(df: DataFrame, keep: list[str], total: str, parts: Mapping[str, str]) -> DataFrame:
    """(keep, measure, amount, share): what each part adds to the recalculated total of its row."""
    each = [F.struct(F.lit(label).alias("measure"), F.col(c).alias("amount")) for c, label in parts.items()]
    present = F.filter(F.array(*each), lambda m: m["amount"].isNotNull() & (m["amount"] != 0))
    share = F.col("amount").cast("double") / F.nullif(F.col(total).cast("double"), F.lit(0.0))
    return df.select(*keep, total, F.inline(present)).select(*keep, "measure", "amount", share.alias("share"))


def deviation(
    df: DataFrame, reported: str, recalculated: str, cap: str, limit: float = 0.30,
) -> DataFrame:
    """How far recalculated amounts are from reported ones: compared entities, the
    median relative gap, gaps over ``limit``, and verdicts that differ.

    The gaps are stored, because counting and ranking them are separate passes.
    """
    rep, calc = F.col(reported).cast("double"), F.col(recalculated).cast("double")
    rows = stored(df.where(rep.isNotNull() & calc.isNotNull() & (rep != 0)).select(
        (F.abs(calc - rep) / F.abs(rep)).alias("gap"),
        ((quantity(F.col(reported)) > F.col(cap)) != (F.col(recalculated).cast(AMOUNT) > F.col(cap))).alias("flips"),
    ), "gaps")
    counts = rows.agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(F.col("gap") > limit).alias("over_limit"),
        F.count_if(F.col("flips")).alias("verdict_flips"),
    )
    median = exact_median(rows, [], "gap", "median_gap")
    return counts.select("*", median.scalar().alias("median_gap"))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, fill_rate): share of rows with a usage above zero, all columns in one pass."""
    return _per_column(df, columns, lambda c: F.coalesce(F.col(c) > 0, F.lit(False)), "fill_rate")


def missing_share(df: DataFrame, columns: list[str], placeholders: list[str]) -> DataFrame:
    """(column, missing_share): share of rows that are NULL or hold a placeholder."""
    return _per_column(
        df, columns, lambda c: F.col(c).isNull() | F.coalesce(F.col(c).cast("string").isin(*placeholders), F.lit(False)),
        "missing_share",
    )


def _per_column(df: DataFrame, columns: list[str], test, out: str) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(test(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(f"c{i}") / F.nullif(F.col("n"), F.lit(0))).alias(out))
        for i, c in enumerate(columns)
    ])
    return row.select(F.inline(pairs))


def duplicate_audit(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(outcome, keys): keys that occur more than once, by whether their values
    are equal, partly missing, all missing, or different."""
    per_key = df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("given"), F.min(value).alias("lo"), F.max(value).alias("hi")
    ).where("n > 1")
    outcome = (
        F.when(F.col("given") == 0, "all_missing")
        .when(F.col("lo") != F.col("hi"), "different")
        .when(F.col("given") < F.col("n"), "some_missing")
        .otherwise("equal")
    )
    return per_key.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("keys"))


def fact_conflicts(facts: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, value, statements): every value stated for a key that has more than one.

    One row per value rather than one list per key, so no key has to fit in a row.
    Values are counted before the keys are compared.
    """
    stated = facts.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count(F.lit(1)).alias("statements"))
    # Reading the counts here too lets both sides of the join share one shuffle of the facts.
    torn = stated.groupBy(*key).agg(
        F.count(F.lit(1)).alias("values"), F.sum("statements").alias("all")
    ).where("values > 1 AND all > 1").select(*[F.col(c).alias(f"__{c}") for c in key])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key])
    return stated.join(torn, same, "left_semi")


def profile(df: DataFrame, by: str, measure: str, multi: Column | None = None) -> DataFrame:
    """Per category: rows, mean, median and maximum of a measure, and the share of
    rows whose list of uses (``multi``) has more than one entry."""
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg(measure).alias("mean"), F.max(measure).alias("maximum"),
    ]
    if multi is not None:
        aggs.append(F.avg((F.size(multi) > 1).cast("int")).alias("multi_share"))
    groups = df.groupBy(by).agg(*aggs)
    medians = exact_median(df, [by], measure).withColumnRenamed(by, "__by")
    return groups.join(medians, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def fingerprint(df: DataFrame, column: str) -> str:
    """Identifies the set of source hashes in ``df``, in one form at every size.

    A SHA-256 of the sorted hashes of each bucket, by their first three characters, and
    one over the digests of the buckets in order.
    """
    hashes = df.select(F.col(column).alias("h")).where(F.col(column).isNotNull()).distinct()
    listed = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",")
    buckets = hashes.groupBy(F.substring("h", 1, 3).alias("b")).agg(F.sha2(listed("h"), 256).alias("d"))
    return buckets.agg(F.sha2(listed(F.concat_ws(":", "b", "d")), 256).alias("mark")).first()["mark"]


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Counts taken while ``df`` is written, so a second pass is not needed."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen


def run_metrics(entities: DataFrame, projections: DataFrame, entity: str) -> DataFrame:
    """Entities evaluated, entities covered, and projection rows."""
    evaluated = entities.agg(F.count(F.lit(1)).alias("n"))
    written = projections.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")
    )
    return written.select(
        evaluated.scalar().alias("entities_evaluated"),
        F.col("covered").alias("entities_covered"),
        F.col("rows").alias("rows_written"),
    )

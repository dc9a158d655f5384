"""Rates that hold for a period of years, and the quantities they apply to.

A rate row has a start and an end year, both inclusive. For a target period the
rate used is, in this order: one whose years contain the target (the latest
start, then the narrowest); one without a start year, which holds always; the
one that ended last before the target began. A rate that only starts later, or
that has a start but no end, never applies.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capledger.functions.columns import AMOUNT, QUANTITY, RATE, quantity, sum_amounts, times
from capledger.operators import bounded
from capledger.operators.bounded import cross_lines, cross_rows, localized, lookup_join, many_salts, salted_join
from capledger.operators.stabbing import countable, effective_rate_many

PERIOD = ["period_start", "period_end"]
CONTAINS, ALWAYS, ENDED = 3, 2, 1
MANY_PERIODS = 64


def compliance_periods(caps: DataFrame, start: str = "period_start", end: str = "period_end") -> DataFrame:
    """The distinct periods for which caps are stated."""
    stated = caps.select(F.col(start).alias("period_start"), F.col(end).alias("period_end"))
    return stated.where("period_start IS NOT NULL AND period_end IS NOT NULL").distinct()


def cross_periods(df: DataFrame, periods: DataFrame) -> DataFrame:
    """One row per entity and period."""
    return cross_rows(df, periods.select(*PERIOD))


def effective_rate(
    rates: DataFrame, periods: DataFrame, key: str, value: str,
    start: str = "period_start", end: str = "period_end",
) -> DataFrame:
    """(key, period_start, period_end, value): the rate that applies to each key in each period.

    A key without an applicable rate has no row. Candidates are reduced per task
    before anything is shuffled, so a key with very many rates is no hot spot. More
    than ``MANY_PERIODS`` periods of whole numbers do not meet every rate: they are
    searched for in a tree of the rates.
    """
    spans = periods.select(*PERIOD)
    few = bounded.few_rows(spans, MANY_PERIODS)
    if few is None and countable(periods, *PERIOD) and countable(rates, start, end):
        return effective_rate_many(rates, periods, key, value, start, end)
    offered = rates.select(
        F.col(key), F.col(value), F.col(start).alias("__from"), F.col(end).alias("__to"),
    )
    pairs = cross_periods(offered, periods) if few is None else cross_lines(offered, [tuple(r) for r in few], spans.schema)
    how = (
        F.when((F.col("__from") <= F.col("period_start")) & (F.col("__to") >= F.col("period_end")), CONTAINS)
        .when(F.col("__from").isNull(), ALWAYS)
        .when(F.col("__to") < F.col("period_start"), ENDED)
    )
    standing = F.struct(
        F.col("__how"),
        F.when(F.col("__how") == ENDED, F.col("__to")),
        F.col("__from"),
        -F.col("__to"),
        F.col(value),
    )
    return (
        pairs.withColumn("__how", how)
        .where(F.col("__how").isNotNull())
        .groupBy(key, *PERIOD)
        .agg(F.max_by(value, standing).alias(value))
    )


def weighted_sum(
    df: DataFrame, measures: Mapping[str, str], rates: DataFrame, periods: DataFrame,
    key: str = "fuel_type", value: str = "value", total: str = "actual", parts: Mapping[str, str] | None = None,
) -> DataFrame:
    """Σ measure × effective rate, per entity and period; 0 when nothing applies.

    ``measures`` maps a usage column to the key of its rate. The rates of the few
    named keys become one line per period, so entities meet them in place and
    nothing is shuffled. ``parts`` names output columns for single products.
    """
    wanted = sorted(set(measures.values()))
    amounts = df.withColumns({f"__qty_{i}": quantity(F.col(c)) for i, c in enumerate(measures)})
    lines = _priced_lines(amounts, rates.where(F.col(key).isin(wanted)), periods, wanted, key, value)
    product = {
        column: times(F.col(f"__qty_{i}"), F.col(f"__rate_{wanted.index(rate_key)}"))
        for i, (column, rate_key) in enumerate(measures.items())
    }
    kept = [*df.columns, *PERIOD]
    shown = [product[column].alias(name) for column, name in (parts or {}).items()]
    return lines.select(*kept, sum_amounts(list(product.values())).alias(total), *shown)


def _priced_lines(df: DataFrame, rates: DataFrame, periods: DataFrame, wanted: list[str], key: str, value: str) -> DataFrame:
    """``df`` with one line per period that holds the effective rate of each wanted key."""
    spans = localized(periods.select(*PERIOD).distinct())
    if spans is None:
        return salted_join(df, rate_card(rates, periods, wanted, key, value), [], "inner", many_salts(df))
    chosen = effective_rate(rates, spans, key, value).select(*PERIOD, key, value).collect()  # one per wanted key and span
    rate_of = {tuple(r)[:3]: r[3] for r in chosen}
    lines = [(s, e, *[rate_of.get((s, e, k)) for k in wanted]) for s, e in spans.collect()]
    schema = T.StructType([
        *spans.schema.fields, *[T.StructField(f"__rate_{i}", T.DecimalType(24, 18)) for i in range(len(wanted))]
    ])
    return cross_lines(df, lines, schema)


def rate_card(rates: DataFrame, periods: DataFrame, keys: list[str], key: str, value: str) -> DataFrame:
    """One row per period with the effective rate of each of ``keys`` as a column."""
    chosen = effective_rate(rates, periods, key, value)
    wide = chosen.groupBy(*PERIOD).agg(*[
        F.max(F.when(F.col(key) == k, F.col(value))).cast(RATE).alias(f"__rate_{i}") for i, k in enumerate(keys)
    ])
    return periods.select(*PERIOD).distinct().join(wide, PERIOD, "left")


def weighted_sum_long(
    usage: DataFrame, entity: str, measure: str, amount: str, rates: DataFrame, periods: DataFrame,
    value: str = "value", total: str = "actual",
) -> DataFrame:
    """The same sum for usage in rows (entity, measure, amount), with any number of measures.

    Usage is added up per entity and measure before it meets the rates. Entities
    without an applicable rate keep a total of 0.
    """
    summed = usage.groupBy(entity, measure).agg(F.sum(quantity(F.col(amount))).alias("__qty"))
    chosen = effective_rate(rates, periods, measure, value).withColumn(value, F.col(value).cast(RATE))
    by_period = cross_periods(summed, periods)
    priced = lookup_join(by_period, chosen, [measure, *PERIOD], "left", tiny=True)
    amount_of = F.when(
        F.col("__qty") != 0, times(F.col("__qty").cast(QUANTITY), F.col(value))
    )
    return priced.groupBy(entity, *PERIOD).agg(
        F.coalesce(F.sum(amount_of).cast(AMOUNT), F.lit(0).cast(AMOUNT)).alias(total)
    )


def cap_of(
    df: DataFrame, caps: DataFrame, periods: DataFrame, kind: str, area: str,
    cap_kind: str = "property_type", value: str = "value", out: str = "cap",
) -> DataFrame:
    """Adds area × cap rate of the entity's kind and period; NULL when any of them is missing."""
    chosen = effective_rate(caps, periods, cap_kind, value).select(
        F.col(cap_kind).alias(kind), *PERIOD, F.col(value).cast(RATE).alias("__cap_rate")
    )
    joined = lookup_join(df, chosen, [kind, *PERIOD], "left", tiny=True)
    return joined.select(*[f"`{c}`" for c in df.columns], times(quantity(F.col(area)), F.col("__cap_rate")).alias(out))


def scalar_of(facts: DataFrame, value: str, order: list[str], scope=None):
    """One value picked from ``facts`` in a fixed order, or None.

    Stated facts may contradict each other; the order makes the pick repeatable.
    """
    rows = facts if scope is None else facts.where(scope)
    row = rows.where(F.col(value).isNotNull()).orderBy(*order, value).select(value).first()
    return row[0] if row else None


def attach_scalar(df: DataFrame, facts: DataFrame, value: str, order: list[str], scope=None, out: str | None = None) -> DataFrame:
    dtype = facts.schema[value].dataType
    return df.withColumn(out or value, F.lit(scalar_of(facts, value, order, scope)).cast(dtype))

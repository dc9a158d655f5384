"""Clean filings and stated facts to one projection per covered entity and period."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.functions import filings as names
from capledger.operators.bounded import localized
from capledger.operators.compliance import is_covered, project_compliance
from capledger.operators.effective import cap_of, compliance_periods, scalar_of, weighted_sum
from capledger.operators.membership import flag_membership
from capledger.operators.rollup import observed
from capledger.plans.serving import write_serving
from capledger.sources.scratch import stored
from capledger.sources.tables import read_facts

# Which rule sets the penalty, and which threshold covers one building.
PENALTY_FOR = "excess_emissions"
THRESHOLD_FOR = "single_building"


@dataclass
class Facts:
    """The stated facts, as read from their tables."""

    caps: DataFrame           # jurisdiction, property_type, period_start, period_end, value
    coefficients: DataFrame   # jurisdiction, fuel_type, period_start, period_end, value
    penalties: DataFrame      # jurisdiction, rule_type, rate
    coverage: DataFrame       # jurisdiction, threshold_type, threshold_sf
    covered: DataFrame        # bbl
    registry: DataFrame | None = None  # rag_id, active_flag: restricts facts to active versions

    def of(self, name: str, jurisdiction: str) -> DataFrame:
        return read_facts(getattr(self, name), jurisdiction, self.registry)


def project_filings(clean: DataFrame, facts: Facts, jurisdiction: str = "New York City") -> DataFrame:
    """One row per covered property and period.

    The filings are never shuffled when the facts measure small: rates and periods
    are expanded in place, the covered list and the caps are looked up.
    """
    caps = facts.of("caps", jurisdiction)
    stated = compliance_periods(caps)
    periods = localized(stated) or stated
    threshold = scalar_of(
        facts.of("coverage", jurisdiction), "threshold_sf", ["threshold_sf"], F.col("threshold_type") == THRESHOLD_FOR
    )
    rate = scalar_of(facts.of("penalties", jurisdiction), "rate", ["rate"], F.col("rule_type") == PENALTY_FOR)
    kept = ["property_id", "bbl", "property_name", "borough", "primary_property_type", "gross_floor_area_ft",
            "year_ending", "total_ghg_emissions_tons", *names.USAGE_LABELS]
    flagged = flag_membership(clean.select(*kept), facts.covered, "bbl", "__listed")
    covered = flagged.where(
        is_covered(F.col("__listed"), F.col("gross_floor_area_ft"), F.lit(threshold).cast("decimal(26,8)"))
    ).select(*kept)
    burned = weighted_sum(covered, names.FUEL_OF_USAGE, facts.of("coefficients", jurisdiction), periods)
    capped = cap_of(burned, caps, periods, "primary_property_type", "gross_floor_area_ft")
    projected = project_compliance(capped, penalty_rate=F.lit(rate))
    return projected.select(
        "property_id", "bbl", "property_name", "borough", "primary_property_type", "gross_floor_area_ft",
        "year_ending", *names.USAGE_LABELS,
        "period_start", "period_end", "status",
        F.col("cap").cast("double").alias("cap_tco2e"),
        F.col("actual").cast("double").alias("actual_emissions_tco2e"),
        F.col("total_ghg_emissions_tons").alias("reported_emissions_tco2e"),
        F.col("excess").cast("double").alias("excess_emissions_tco2e"),
        F.col("penalty_rate").cast("double").alias("penalty_rate_usd_per_ton"),
        F.col("penalty").cast("double").alias("potential_penalty_usd"),
    )


def load_gold(clean: DataFrame, facts: Facts, path: str, jurisdiction: str = "New York City") -> dict:
    """Replaces the projection table; returns entities evaluated, entities covered and rows written.

    Rows and evaluated entities are counted while the projection is stored, covered entities on
    one column of it; from there it is written clustered by property, as lookups want it (see ``serving.write_serving``).
    """
    evaluated, seen_in = observed(clean, "gold_input", n=F.count(F.lit(1)))
    projected, seen_out = observed(project_filings(evaluated, facts, jurisdiction), "gold_output", n=F.count(F.lit(1)))
    projected = stored(projected, "projected")  # cutting ranges samples its input, which must not be computed or counted twice
    write_serving(projected, path)
    covered = projected.select("property_id").distinct().count()
    return {"entities_evaluated": seen_in.get["n"], "entities_covered": covered, "rows_written": seen_out.get["n"]}

"""The facts a rule document can state: their fields, keys and allowed values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FactKind:
    name: str
    label: str                      # the column that names what the fact is about
    number: str                     # the column that must hold one number
    required: tuple[str, ...]       # columns that must not be NULL
    key: tuple[str, ...]            # natural key within one document version
    from_tables: bool               # usually printed as a table, not as prose
    hint: str                       # what to search the document for
    about: str                      # what the fact says, for a question
    optional: tuple[str, ...] = ()
    allowed: tuple[str, ...] = field(default=())  # allowed values of `label`

    @property
    def fields(self) -> tuple[str, ...]:
        names = [*self.required, self.number, *self.optional]
        return tuple(dict.fromkeys(names))


# Names, keys and allowed values a stored fact must use.
FUEL_TYPES = (
    "Grid Electricity",
    "Natural Gas",
    "District Steam",
    "Fuel Oil #2",
    "Fuel Oil #4",
    "Distillate Fuel Oil No. 1",
    "Diesel",
    "Propane",
    "Kerosene",
    "Butane",
    "Butylene",
    "Coke Oven Gas",
    "Ethane",
    "Ethylene",
    "Fuel Gas",
    "Gasoline",
    "Isobutane",
    "Isobutylene",
    "Naphtha (< 401 deg F)",
    "Other Oil (> 401 deg F)",
    "Pentanes Plus",
    "Propylene",
    "Special Naphtha",
    "Biofuel",
)
RULE_TYPES = ("excess_emissions", "late_filing", "false_reporting")
THRESHOLD_TYPES = ("single_building", "multi_building_lot")

EMISSIONS_FACTOR = FactKind(
    name="EmissionsFactor",
    label="property_type",
    number="value",
    required=("jurisdiction", "property_type", "period_start", "period_end", "unit"),
    key=("rag_id", "jurisdiction", "property_type", "period_start", "period_end"),
    from_tables=True,
    hint="emissions caps by property type and compliance period",
    about="the most a building of one type may emit per unit of floor area and year, in one span of years",
    optional=("extracted_quote",),
)
FUEL_COEFFICIENT = FactKind(
    name="FuelCoefficient",
    label="fuel_type",
    number="value",
    required=("jurisdiction", "fuel_type", "unit"),
    key=("rag_id", "jurisdiction", "fuel_type", "period_start", "period_end"),
    from_tables=True,
    hint="emissions coefficients by fuel or energy source and compliance period",
    about="how much one unit of a fuel or of bought energy counts as emitted, in one span of years or in all",
    optional=("period_start", "period_end", "extracted_quote"),
    allowed=FUEL_TYPES,
)
PENALTY_RULE = FactKind(
    name="PenaltyRule",
    label="rule_type",
    number="rate",
    required=("jurisdiction", "rule_type", "rate_unit"),
    key=("rag_id", "chunk_id", "jurisdiction", "rule_type"),
    from_tables=False,
    hint="civil penalty for exceeding the limit, failing to file, false statements",
    about="what an owner pays for one kind of breach, and per what",
    optional=("period_start", "period_end", "formula_description", "extracted_quote"),
    allowed=RULE_TYPES,
)
COVERED_BUILDING_RULE = FactKind(
    name="CoveredBuildingRule",
    label="threshold_type",
    number="threshold_sf",
    required=("jurisdiction", "threshold_type"),
    key=("rag_id", "chunk_id", "jurisdiction", "threshold_type"),
    from_tables=False,
    hint="which buildings are covered: floor area thresholds and exemptions",
    about="from what floor area on the rules bind a building, or several on one lot, and who is exempt",
    optional=("aggregation_rule", "exceptions", "extracted_quote"),
    allowed=THRESHOLD_TYPES,
)
FACT_KINDS = {k.name: k for k in (EMISSIONS_FACTOR, FUEL_COEFFICIENT, PENALTY_RULE, COVERED_BUILDING_RULE)}

#: What a field is meant to hold, for a question.
FIELD_NOTES = {
    "jurisdiction": "The city, county or state whose rule it is",
    "property_type": "The use of the building, as the rule names it",
    "fuel_type": "The fuel or energy source",
    "rule_type": "The breach that is fined",
    "threshold_type": "Whether the area is that of one building or of all on a lot",
    "value": "One number, digits and a point only",
    "rate": "One number, without its currency",
    "threshold_sf": "One number of square feet",
    "unit": "The unit of the number, as printed",
    "rate_unit": "Currency, and per what",
    "period_start": "First year, four digits",
    "period_end": "Last year, four digits",
    "formula_description": "How the amount is worked out, in a sentence",
    "aggregation_rule": "How areas on one lot are added up",
    "exceptions": "Each exemption as one text",
    "extracted_quote": "The words of the document that state it",
}

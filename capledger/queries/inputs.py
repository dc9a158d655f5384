"""How the test tables stand in for filings, lists and facts.

A customer is an entity: its market segment is the property type, its account
balance the floor area, its order lines the usages, its order totals the reported
amount. The stated facts are a few lines, as they are in a rule document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.functions.filings import USAGE_LABELS
from capledger.plans.projection import Facts
from capledger.queries.registry import table

MEASURES = {"quantity": "Grid Electricity", "price": "Natural Gas", "discount": "District Steam", "tax": "Diesel"}
USAGES = {"quantity": "electricity_use_kwh", "price": "natural_gas_use_kbtu", "discount": "district_steam_use_kbtu", "tax": "diesel_2_use_kbtu"}
THRESHOLD, PENALTY, MONTHLY = 5000, 268, 0.5

_PERIODS = "(2024, 2029), (2030, 2034), (2035, 2039), (2040, 2049)"
_RATES = """('North', 'Grid Electricity', 2024, 2029, 0.000288962), ('North', 'Grid Electricity', 2030, 2034, 0.000145),
('North', 'Natural Gas', 2024, 2029, 0.00005311), ('North', 'Natural Gas', 2030, 2034, 0.00004911), ('North', 'Natural Gas', 2030, 2049, 0.00004711),
('North', 'District Steam', NULL, NULL, 0.04493), ('North', 'District Steam', 2060, 2069, 0.5), ('South', 'Diesel', 2024, 2049, 0.7)"""
_CAPS = """('North', 'BUILDING', 2024, 2029, 0.031), ('North', 'BUILDING', 2030, 2034, 0.021),
('North', 'BUILDING', 2035, 2039, 0.011), ('North', 'BUILDING', 2040, 2049, 0.006),
('North', 'MACHINERY', 2024, 2029, 0.042), ('North', 'MACHINERY', 2030, 2034, 0.017),
('North', 'FURNITURE', 2024, 2029, 0.025), ('North', 'FURNITURE', 2030, 2034, 0.015),
('North', 'HOUSEHOLD', 2024, 2029, 0.02), ('South', 'AUTOMOBILE', 2024, 2049, 0.02)"""

PERIODS_SQL = f"SELECT * FROM (VALUES {_PERIODS}) AS p(period_start, period_end)"
RATES_SQL = f"""SELECT jurisdiction, fuel_type, CAST(period_start AS INT) AS period_start, CAST(period_end AS INT) AS period_end,
CAST(value AS DECIMAL(16,12)) AS value FROM (VALUES {_RATES}) AS r(jurisdiction, fuel_type, period_start, period_end, value)"""
CAPS_SQL = f"""SELECT jurisdiction, property_type, CAST(period_start AS INT) AS period_start, CAST(period_end AS INT) AS period_end,
CAST(value AS DECIMAL(16,12)) AS value FROM (VALUES {_CAPS}) AS c(jurisdiction, property_type, period_start, period_end, value)"""


def periods(spark: SparkSession) -> DataFrame:
    return spark.sql(PERIODS_SQL)


def rates(spark: SparkSession) -> DataFrame:
    return spark.sql(RATES_SQL).where("jurisdiction = 'North'")


def caps(spark: SparkSession) -> DataFrame:
    return spark.sql(CAPS_SQL).where("jurisdiction = 'North'")


def _cents(column: str):
    """Exact sums of amounts with two decimals, as whole hundredths."""
    return F.sum(F.round(F.col(column) * 100).cast("long"))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """entity, property_type, area, reported and one column per measure."""
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        _cents("l_quantity").alias("quantity"), _cents("l_extendedprice").alias("price"),
        _cents("l_discount").alias("discount"), _cents("l_tax").alias("tax"),
    )
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("entity"), "o_totalprice")
    sums = orders.join(lines, "o_orderkey", "left").groupBy("entity").agg(
        *[(F.sum(m) / 100).alias(m) for m in MEASURES],
        (_cents("o_totalprice") / 5_000_000).alias("reported"),
    )
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("property_type"), F.col("c_acctbal").alias("area")
    )
    return customers.join(sums, "entity", "left")


ENTITIES_SQL = """SELECT c_custkey AS entity, c_mktsegment AS property_type, c_acctbal AS area,
quantity, price, discount, tax, reported
FROM customer LEFT JOIN (
  SELECT o_custkey, sum(q) / 100 AS quantity, sum(p) / 100 AS price, sum(d) / 100 AS discount,
    sum(t) / 100 AS tax,
    sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 5000000 AS reported
  FROM orders LEFT JOIN (
    SELECT l_orderkey, sum(CAST(round(l_quantity * 100) AS BIGINT)) AS q, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS p,
      sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, sum(CAST(round(l_tax * 100) AS BIGINT)) AS t
    FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
  GROUP BY o_custkey) ON o_custkey = c_custkey"""


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The covered list: customers with a finished order."""
    done = table(spark, folder, "orders").where("o_orderstatus = 'F' AND o_totalprice > 400000")
    return done.select(F.col("o_custkey").alias("entity"))


LISTED_SQL = "SELECT DISTINCT o_custkey AS entity FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000"


def facts(spark: SparkSession, folder: str) -> Facts:
    return Facts(
        caps=spark.sql(CAPS_SQL),
        coefficients=spark.sql(RATES_SQL),
        penalties=spark.sql(f"SELECT 'North' AS jurisdiction, 'excess_emissions' AS rule_type, CAST({PENALTY} AS DECIMAL(12,4)) AS rate"),
        coverage=spark.sql(f"SELECT 'North' AS jurisdiction, 'single_building' AS threshold_type, CAST({THRESHOLD} AS DECIMAL(12,2)) AS threshold_sf"),
        covered=listed(spark, folder).select(F.col("entity").cast("string").alias("bbl")),
    )


def clean(spark: SparkSession, folder: str) -> DataFrame:
    """The entities under the names of clean filings."""
    unused = [u for u in USAGE_LABELS if u not in USAGES.values()]
    return entities(spark, folder).select(
        F.col("entity").cast("string").alias("property_id"), F.col("entity").cast("string").alias("bbl"),
        F.concat(F.lit("Customer "), "entity").alias("property_name"), F.lit("Queens").alias("borough"),
        F.col("property_type").alias("primary_property_type"), F.col("area").alias("gross_floor_area_ft"),
        F.lit("12/31/2021").alias("year_ending"), F.col("reported").alias("total_ghg_emissions_tons"),
        *[F.col(m).alias(u) for m, u in USAGES.items()], *[F.lit(None).cast("double").alias(u) for u in unused],
    )


def effective_sql(rates_sql: str, key: str, periods_sql: str = PERIODS_SQL) -> str:
    return f"""SELECT {key}, period_start, period_end, value FROM (
  SELECT r.{key}, p.period_start, p.period_end, r.value, row_number() OVER (
    PARTITION BY r.{key}, p.period_start, p.period_end
    ORDER BY CASE WHEN r.period_start <= p.period_start AND r.period_end >= p.period_end THEN 3
                  WHEN r.period_start IS NULL THEN 2 ELSE 1 END DESC,
      CASE WHEN r.period_start IS NOT NULL AND NOT (r.period_start <= p.period_start AND r.period_end >= p.period_end)
           THEN r.period_end END DESC NULLS LAST,
      r.period_start DESC NULLS LAST, r.period_end ASC NULLS LAST, r.value DESC) AS rn
  FROM ({rates_sql}) r, ({periods_sql}) p
  WHERE (r.period_start <= p.period_start AND r.period_end >= p.period_end)
     OR r.period_start IS NULL OR r.period_end < p.period_start) WHERE rn = 1"""


_NORTH = f"SELECT * FROM ({RATES_SQL}) WHERE jurisdiction = 'North'"
_NORTH_CAPS = f"SELECT * FROM ({CAPS_SQL}) WHERE jurisdiction = 'North'"


_CARD_SQL = f"""SELECT s.period_start, s.period_end,
{', '.join(f"max(CASE WHEN fuel_type = '{fuel}' THEN value END) AS rate_{m}" for m, fuel in MEASURES.items())}
FROM ({PERIODS_SQL}) s LEFT JOIN ({effective_sql(_NORTH, 'fuel_type')}) e
  ON e.period_start = s.period_start AND e.period_end = s.period_end GROUP BY s.period_start, s.period_end"""

WEIGHTED_SQL = f"""SELECT entity, property_type, area, reported, quantity, price, discount, tax, period_start, period_end,
{', '.join(f"coalesce(CAST(CAST({m} AS DECIMAL(26,8)) * rate_{m} AS DECIMAL(36,12)), 0) AS part_{m}" for m in MEASURES)}
FROM ({ENTITIES_SQL}) CROSS JOIN ({_CARD_SQL})"""

PROJECTION_SQL = f"""WITH w AS ({WEIGHTED_SQL}),
caps AS ({effective_sql(_NORTH_CAPS, 'property_type')}),
j AS (SELECT w.*, part_quantity + part_price + part_discount + part_tax AS actual,
  CAST(CAST(area AS DECIMAL(26,8)) * caps.value AS DECIMAL(36,12)) AS cap
  FROM w LEFT JOIN caps USING (property_type, period_start, period_end)
  WHERE area > {THRESHOLD} OR entity IN ({LISTED_SQL}))
SELECT *, CASE WHEN cap IS NULL THEN NULL WHEN actual > cap THEN actual - cap ELSE 0 END AS excess,
  CASE WHEN cap IS NULL THEN 'cap_unavailable' WHEN actual > cap THEN 'exceeds' ELSE 'compliant' END AS status FROM j"""

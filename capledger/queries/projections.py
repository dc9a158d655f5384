"""Effective rates, caps and the compliance projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.operators import compliance, effective, membership, rollup
from capledger.plans import serving
from capledger.plans.projection import Facts, load_gold, project_filings
from capledger.queries import inputs as I
from capledger.queries.registry import query, table
from capledger.sources.scratch import scratch_path, stored
from capledger.sources.tables import read_table

PERIOD = effective.PERIOD


def _double(*names: str, digits: int = 6):
    return [F.round(n, digits).cast("double").alias(n) for n in names]


def projection(spark: SparkSession, folder: str) -> DataFrame:
    """The projection of all covered entities."""
    marked = membership.flag_membership(I.entities(spark, folder), I.listed(spark, folder), "entity", "listed")
    covered = marked.where(compliance.is_covered(F.col("listed"), F.col("area"), F.lit(I.THRESHOLD)))
    caps, rates = I.caps(spark), I.rates(spark)
    periods = effective.compliance_periods(caps)
    weighted = effective.weighted_sum(covered, I.MEASURES, rates, periods, parts={m: f"part_{m}" for m in I.MEASURES})
    capped = effective.cap_of(weighted, caps, periods, "property_type", "area")
    return compliance.project_compliance(capped, penalty_rate=F.lit(I.PENALTY))


@query("compliance_projection", f"""SELECT entity, property_type, period_start, period_end, status,
CAST(round(cap, 6) AS DOUBLE) AS cap, CAST(round(actual, 6) AS DOUBLE) AS actual, CAST(round(excess, 6) AS DOUBLE) AS excess,
CAST(round(excess * {I.PENALTY}, 4) AS DOUBLE) AS penalty FROM ({I.PROJECTION_SQL})""")
def compliance_projection(spark, folder):
    return projection(spark, folder).select(
        "entity", "property_type", *PERIOD, "status", *_double("cap", "actual", "excess"), *_double("penalty", digits=4)
    )


_GOLD_SQL = f"""SELECT *, CAST(entity AS VARCHAR) AS property_id, excess * {I.PENALTY} AS penalty FROM ({I.PROJECTION_SQL})"""


@query("gold_projection", f"""SELECT property_id, property_type AS primary_property_type, area AS gross_floor_area_ft, quantity AS electricity_use_kwh,
tax AS diesel_2_use_kbtu, CAST(NULL AS DOUBLE) AS propane_use_kbtu, reported AS reported_emissions_tco2e, period_start, period_end, status,
CAST(round(cap, 6) AS DOUBLE) AS cap_tco2e, CAST(round(actual, 6) AS DOUBLE) AS actual_emissions_tco2e,
CAST(round(excess, 6) AS DOUBLE) AS excess_emissions_tco2e, {I.PENALTY}.0::DOUBLE AS penalty_rate_usd_per_ton, CAST(round(penalty, 4) AS DOUBLE) AS potential_penalty_usd
FROM ({_GOLD_SQL})""")
def gold_projection(spark, folder):
    """Clean filings to projections, with all facts read from their tables."""
    out = project_filings(I.clean(spark, folder), I.facts(spark, folder), "North")
    return out.select(
        "property_id", "primary_property_type", "gross_floor_area_ft", "electricity_use_kwh", "diesel_2_use_kbtu",
        "propane_use_kbtu", "reported_emissions_tco2e", *PERIOD, "status",
        *_double("cap_tco2e", "actual_emissions_tco2e", "excess_emissions_tco2e"), "penalty_rate_usd_per_ton",
        *_double("potential_penalty_usd", digits=4))


@query("gold_job", f"""SELECT property_id, period_start, period_end, status, CAST(round(cap, 6) AS DOUBLE) AS cap_tco2e, CAST(round(actual, 6) AS DOUBLE) AS actual_emissions_tco2e,
CAST(round(penalty, 4) AS DOUBLE) AS potential_penalty_usd, (SELECT count(*) FROM ({I.ENTITIES_SQL})) AS entities_evaluated,
(SELECT count(DISTINCT entity) FROM ({I.PROJECTION_SQL})) AS entities_covered, (SELECT count(*) FROM ({I.PROJECTION_SQL})) AS rows_written FROM ({_GOLD_SQL})""")
def gold_job(spark, folder):
    """The whole job: facts and filings from stored tables, the projection written twice over one path, counted and read back."""
    facts = I.facts(spark, folder)
    held = Facts(**{n: stored(getattr(facts, n), n) for n in ("caps", "coefficients", "penalties", "coverage", "covered")})
    clean, path = stored(I.clean(spark, folder), "clean"), scratch_path(spark, "gold")
    load_gold(clean.where("property_id < '3'"), held, path, "North")
    done = load_gold(clean, held, path, "North")
    return read_table(spark, path).select(
        "property_id", *PERIOD, "status", *_double("cap_tco2e", "actual_emissions_tco2e"), *_double("potential_penalty_usd", digits=4),
        *[F.lit(n).cast("long").alias(name) for name, n in done.items()])


_EVENT_RATES_SQL = """SELECT user_id, CASE WHEN event_type <> 'error' THEN CAST(2000 + k AS INT) END AS period_start,
CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(2000 + k + minute(ts) AS INT) END AS period_end, value
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"""


@query("effective_rate", f"SELECT user_id, period_start, period_end, value AS rate FROM ({I.effective_sql(_EVENT_RATES_SQL, 'user_id')})")
def effective_rate(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    offered = table(spark, folder, "events").select(
        "user_id", "value",
        F.when(F.col("event_type") != "error", 2000 + k).alias("period_start"),
        F.when(~F.col("event_type").isin("error", "view"), 2000 + k + F.minute("ts")).alias("period_end"),
    )
    return effective.effective_rate(offered, I.periods(spark), "user_id", "value").withColumnRenamed("value", "rate")


_ORDER_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT)"
_LINE_DAY = "CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS INT)"
_ORDER_RATES_SQL = f"""SELECT o_orderpriority, CASE WHEN o_orderpriority < '3' AND o_custkey % 50 = 0 THEN NULL ELSE {_ORDER_DAY} END AS period_start,
CASE WHEN o_custkey % 10 <> 1 THEN CAST({_ORDER_DAY} + o_custkey % 400 AS INT) END AS period_end, o_totalprice AS value FROM orders"""
_LINE_PERIODS_SQL = f"SELECT DISTINCT d AS period_start, CAST(d + 10 * (d % 31) AS INT) AS period_end FROM (SELECT {_LINE_DAY} AS d FROM lineitem)"


@query("effective_rate_many", f"""SELECT o_orderpriority, p.period_start, p.period_end, max_by(value, CASE
  WHEN r.period_start <= p.period_start AND r.period_end >= p.period_end THEN (3, 0, r.period_start, -r.period_end, value)
  WHEN r.period_start IS NULL THEN (2, 0, 0, -coalesce(r.period_end, 1000000), value)
  ELSE (1, r.period_end, r.period_start, 0, value) END) AS rate
FROM ({_ORDER_RATES_SQL}) r JOIN ({_LINE_PERIODS_SQL}) p ON (r.period_start <= p.period_start AND r.period_end >= p.period_end)
  OR r.period_start IS NULL OR r.period_end < p.period_start GROUP BY ALL""")
def effective_rate_many(spark, folder):
    """A rate for each order, by its priority, in as many periods as there are shipping days."""
    day = F.unix_date(F.to_date("o_orderdate"))
    rates = table(spark, folder, "orders").select(
        "o_orderpriority", F.when(~((F.col("o_orderpriority") < "3") & (F.col("o_custkey") % 50 == 0)), day).alias("period_start"),
        F.when(F.col("o_custkey") % 10 != 1, day + (F.col("o_custkey") % 400).cast("int")).alias("period_end"), F.col("o_totalprice").alias("value"))
    shipped = table(spark, folder, "lineitem").select(F.unix_date(F.to_date("l_shipdate")).alias("d")).distinct()
    periods = shipped.select(F.col("d").alias("period_start"), (F.col("d") + 10 * (F.col("d") % 31)).alias("period_end"))
    return effective.effective_rate(rates, periods, "o_orderpriority", "value").withColumnRenamed("value", "rate")


@query("distinct_periods", """SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS period_start, CAST(year(l_shipdate) + l_linenumber AS INT) AS period_end
FROM lineitem""")
def distinct_periods(spark, folder):
    stated = table(spark, folder, "lineitem").select(
        F.year("l_shipdate").alias("a"), (F.year("l_shipdate") + F.col("l_linenumber")).alias("b")
    )
    return effective.compliance_periods(stated, "a", "b").orderBy(*PERIOD)


@query("entity_periods", f"SELECT o_orderkey, period_start, period_end FROM orders CROSS JOIN ({I.PERIODS_SQL})")
def entity_periods(spark, folder):
    return effective.cross_periods(table(spark, folder, "orders").select("o_orderkey"), I.periods(spark))


_LONG = {"l_quantity": "Grid Electricity", "l_extendedprice": "Natural Gas", "l_discount": "District Steam", "l_tax": "Diesel"}
_LONG_SQL = " UNION ALL ".join(
    f"SELECT l_suppkey, '{fuel}' AS fuel_type, CAST({c} AS DECIMAL(26,8)) AS amount FROM lineitem" for c, fuel in _LONG.items()
)


@query("weighted_sum", f"""WITH u AS (SELECT l_suppkey, fuel_type, sum(amount) AS qty FROM ({_LONG_SQL}) GROUP BY ALL),
e AS ({I.effective_sql(I._NORTH, 'fuel_type')})
SELECT l_suppkey, p.period_start, p.period_end,
  CAST(round(coalesce(sum(CAST(CAST(qty AS DECIMAL(26,8)) * value AS DECIMAL(36,12))), 0), 6) AS DOUBLE) AS actual
FROM u CROSS JOIN ({I.PERIODS_SQL}) p LEFT JOIN e ON e.fuel_type = u.fuel_type AND e.period_start = p.period_start AND e.period_end = p.period_end
GROUP BY ALL""")
def weighted_sum(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_suppkey", *[F.col(c).alias(fuel) for c, fuel in _LONG.items()])
    usage = lines.unpivot(["l_suppkey"], list(_LONG.values()), "fuel_type", "amount")
    summed = effective.weighted_sum_long(usage, "l_suppkey", "fuel_type", "amount", I.rates(spark), I.periods(spark))
    return summed.select("l_suppkey", *PERIOD, *_double("actual"))


@query("cap_join", f"""SELECT entity, property_type, p.period_start, p.period_end,
CAST(round(CAST(area AS DECIMAL(26,8)) * value, 6) AS DOUBLE) AS cap
FROM ({I.ENTITIES_SQL}) CROSS JOIN ({I.PERIODS_SQL}) p
LEFT JOIN ({I.effective_sql(I._NORTH_CAPS, 'property_type')}) USING (property_type, period_start, period_end)""")
def cap_join(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("property_type"), F.col("c_acctbal").alias("area"))
    each = effective.cross_periods(customers, I.periods(spark))
    out = effective.cap_of(each, I.caps(spark), I.periods(spark), "property_type", "area")
    return out.select("entity", "property_type", *PERIOD, *_double("cap"))


@query("attach_scalar", """SELECT o_orderkey, o_totalprice * (SELECT min(l_tax) FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0) AS charge
FROM orders""")
def attach_scalar(spark, folder):
    lines = table(spark, folder, "lineitem")
    scope = (F.col("l_returnflag") == "R") & (F.col("l_tax") > 0)
    out = effective.attach_scalar(table(spark, folder, "orders"), lines, "l_tax", ["l_tax", "l_shipdate"], scope, "rate")
    return out.select("o_orderkey", (F.col("o_totalprice") * F.col("rate")).alias("charge"))


@query("membership_flag", f"SELECT c_custkey AS entity, c_custkey IN ({I.LISTED_SQL}) AS is_listed FROM customer")
def membership_flag(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("entity"))
    return membership.flag_membership(customers, I.listed(spark, folder), "entity")


@query("membership_any", """SELECT o_orderkey, o_custkey IN (SELECT p_partkey FROM part WHERE p_size > 40)
OR o_custkey + 1 IN (SELECT p_partkey FROM part WHERE p_size > 40) AS is_listed FROM orders""")
def membership_any(spark, folder):
    parts = table(spark, folder, "part").where("p_size > 40").select(F.col("p_partkey").alias("key"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.array("o_custkey", F.col("o_custkey") + 1).alias("keys"))
    return membership.flag_any_member(orders, parts, "keys", "key").select("o_orderkey", "is_listed")


@query("coverage_filter", f"""SELECT c_custkey AS entity, c_acctbal AS area FROM customer
WHERE c_acctbal > {I.THRESHOLD} OR c_custkey IN ({I.LISTED_SQL})""")
def coverage_filter(spark, folder):
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("area"))
    flagged = membership.flag_membership(customers, I.listed(spark, folder), "entity", "listed")
    return flagged.where(compliance.is_covered(F.col("listed"), F.col("area"), F.lit(I.THRESHOLD))).select("entity", "area")


@query("reconcile_counts", """SELECT side, count(*) AS n FROM (
SELECT CASE WHEN a.k IS NULL THEN 'right_only' WHEN b.k IS NULL THEN 'left_only' ELSE 'both' END AS side
FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a
FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') b ON a.k = b.k) GROUP BY side""")
def reconcile_counts(spark, folder):
    orders = table(spark, folder, "orders")
    return membership.reconcile(orders.where("o_orderstatus = 'F'"), orders.where("o_orderpriority = '1-URGENT'"), "o_custkey")


@query("non_filers", f"""SELECT c_custkey, c_acctbal * {I.MONTHLY} AS monthly_penalty FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def non_filers(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    filings = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return membership.non_filers(customers, filings, "c_custkey", "c_acctbal", F.lit(I.MONTHLY)).select("c_custkey", "monthly_penalty")


@query("entity_verdict", f"""WITH g AS ({I.PROJECTION_SQL}), v AS (SELECT entity,
  min(CASE WHEN status = 'exceeds' THEN period_start END) AS exceeds_from,
  min(CASE WHEN status = 'exceeds' THEN period_end END) AS exceeds_to,
  max(CASE WHEN status = 'exceeds' THEN CAST(round(excess * {I.PENALTY}, 4) AS DOUBLE) END) AS max_penalty,
  bool_and(status = 'cap_unavailable') AS unknown, max(period_end) AS last_end FROM g GROUP BY entity)
SELECT entity, CASE WHEN exceeds_from IS NOT NULL THEN 'exceeds' WHEN unknown THEN 'cap_unavailable' ELSE 'compliant' END AS verdict,
  exceeds_from, exceeds_to, max_penalty,
  CASE WHEN exceeds_from IS NULL AND NOT unknown THEN last_end END AS compliant_through FROM v""")
def entity_verdict(spark, folder):
    return rollup.entity_verdict(projection(spark, folder), "entity").withColumn(
        "max_penalty", F.round("max_penalty", 4).cast("double"))


@query("entity_lookup", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_suppkey = (SELECT max(s_suppkey) FROM supplier)""")
def entity_lookup(spark, folder):
    top = table(spark, folder, "supplier").agg(F.max("s_suppkey")).first()[0]
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return serving.entity_lookup(lines, "l_suppkey", top, "l_orderkey").drop("l_suppkey")


@query("serving_lookup", """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_suppkey IN (SELECT min(s_suppkey) FROM supplier UNION ALL SELECT max(s_suppkey) FROM supplier)""")
def serving_lookup(spark, folder):
    """Two suppliers' lines from a table written for lookups: clustered, with an index of its files."""
    path = scratch_path(spark, "serving")
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    serving.write_serving(lines, path, "l_suppkey", "l_orderkey")
    ends = table(spark, folder, "supplier").agg(F.min("s_suppkey"), F.max("s_suppkey")).first()
    found = [serving.serving_lookup(spark, path, key, "l_suppkey", "l_orderkey") for key in ends]
    return found[0].unionByName(found[1]).drop("l_suppkey")


@query("run_metrics", f"""SELECT (SELECT count(*) FROM customer) AS entities_evaluated, count(DISTINCT entity) AS entities_covered,
count(*) AS rows_written FROM ({I.PROJECTION_SQL})""")
def run_metrics(spark, folder):
    return rollup.run_metrics(table(spark, folder, "customer"), projection(spark, folder), "entity")


@query("mix_shares", f"""WITH u AS (SELECT entity, unnest(['Grid Electricity', 'Natural Gas', 'District Steam', 'Diesel']) AS measure,
  unnest([quantity, price, discount, tax]) AS usage FROM ({I.ENTITIES_SQL}))
SELECT entity, measure, usage, round(usage / sum(usage) OVER (PARTITION BY entity), 9) AS share FROM u WHERE usage <> 0""")
def mix_shares(spark, folder):
    out = rollup.mix_shares(I.entities(spark, folder), ["entity"], I.MEASURES)
    return out.withColumn("share", F.round("share", 9))


@query("contribution_shares", f"""WITH u AS (SELECT entity, period_start, period_end,
  unnest(['Grid Electricity', 'Natural Gas', 'District Steam', 'Diesel']) AS measure,
  unnest([part_quantity, part_price, part_discount, part_tax]) AS amount, actual AS whole FROM ({I.PROJECTION_SQL}))
SELECT entity, period_start, period_end, measure, CAST(round(amount, 6) AS DOUBLE) AS amount, round(CAST(amount AS DOUBLE) / CAST(whole AS DOUBLE), 9) AS share FROM u WHERE amount <> 0""")
def contribution_shares(spark, folder):
    parts = {f"part_{m}": fuel for m, fuel in I.MEASURES.items()}
    out = rollup.contribution_shares(projection(spark, folder), ["entity", *PERIOD], "actual", parts)
    return out.select("entity", *PERIOD, "measure", *_double("amount"), F.round("share", 9).alias("share"))


@query("deviation_stats", f"""WITH g AS (SELECT abs(CAST(actual AS DOUBLE) - reported) / reported AS gap,
  (CAST(reported AS DECIMAL(26,8)) > cap) <> (actual > cap) AS flips FROM ({I.PROJECTION_SQL}) WHERE reported <> 0)
SELECT count(*) AS compared, count(*) FILTER (gap > 0.3) AS over_limit, count(*) FILTER (flips) AS verdict_flips,
  round(median(gap), 9) AS median_gap FROM g""")
def deviation_stats(spark, folder):
    out = rollup.deviation(projection(spark, folder), "reported", "actual", "cap")
    return out.withColumn("median_gap", F.round("median_gap", 9))

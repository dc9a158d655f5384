from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from capledger.functions import filings as names
from capledger.operators.effective import weighted_sum, weighted_sum_long
from capledger.plans.projection import Facts, load_gold, project_filings
from capledger.plans.serving import entity_lookup, files_of, serving_lookup, usage_mix, verdicts, write_serving

CITY = "New York City"
PERIODS = [(2024, 2029), (2030, 2034), (2035, 2039), (2040, 2049)]
RATES = [
    ("Grid Electricity", 2024, 2029, "0.000288962"),
    ("Grid Electricity", 2030, 2034, "0.000145"),
    ("Natural Gas", 2024, 2029, "0.00005311"),
    ("Natural Gas", 2030, 2034, "0.00005311"),
    ("Diesel", None, None, "0.00007421"),
]
CAPS = {
    "Social/Meeting Hall": ["0.00987", "0.003833108", "0.002874831", "0.001916554"],
    "Multifamily Housing": ["0.00675", "0.003346640", "0.002692183", "0.002052731"],
}
USES = list(names.USAGE_LABELS)


def facts(spark, penalty=True):
    d = Decimal
    caps = [(CITY, t, s, e, d(v)) for t, vs in CAPS.items() for (s, e), v in zip(PERIODS, vs)]
    caps.append(("Elsewhere", "Mixed Use Property", 2024, 2029, d("1")))
    return Facts(
        caps=spark.createDataFrame(caps, "jurisdiction string, property_type string, period_start int, period_end int, value decimal(16,12)"),
        coefficients=spark.createDataFrame(
            [(CITY, f, s, e, d(v)) for f, s, e, v in RATES],
            "jurisdiction string, fuel_type string, period_start int, period_end int, value decimal(16,12)"),
        penalties=spark.createDataFrame(
            [(CITY, "excess_emissions", d("268"))] if penalty else [], "jurisdiction string, rule_type string, rate decimal(12,4)"),
        coverage=spark.createDataFrame(
            [(CITY, "single_building", d("25000"))], "jurisdiction string, threshold_type string, threshold_sf decimal(12,2)"),
        covered=spark.createDataFrame([("1022350029",)], "bbl string"),
    )


def filing(id_, kind, area, bbl=None, **use):
    return (id_, bbl, f"name {id_}", "Queens", kind, area, "12/31/2021", 5.0, *[use.get(u) for u in USES])


def clean(spark, *rows):
    text = "property_id string, bbl string, property_name string, borough string, primary_property_type string"
    nums = ", ".join(f"{u} double" for u in USES)
    return spark.createDataFrame(
        list(rows), f"{text}, gross_floor_area_ft double, year_ending string, total_ghg_emissions_tons double, {nums}")


HALL = filing("12915497", "Social/Meeting Hall", 33972.0, electricity_use_kwh=81265.7, natural_gas_use_kbtu=978775.8)
HOMES = filing("20583499", "Multifamily Housing", 75366.0, electricity_use_kwh=774647.5, natural_gas_use_kbtu=2756397.4)


def run(spark, *rows, **kw):
    out = project_filings(clean(spark, *rows), facts(spark, **kw)).orderBy("property_id", "period_start").collect()
    return [r.asDict() for r in out]


def test_small_emitter_is_compliant_throughout(spark):
    rows = run(spark, HALL)
    assert [(r["period_start"], r["status"]) for r in rows] == [(s, "compliant") for s, _ in PERIODS]
    assert rows[0]["actual_emissions_tco2e"] == pytest.approx(75.4655, abs=0.01)
    assert rows[0]["cap_tco2e"] == pytest.approx(335.3, abs=0.5)
    assert rows[0]["potential_penalty_usd"] == 0 and rows[0]["excess_emissions_tco2e"] == 0


def test_large_emitter_exceeds_from_the_second_period(spark):
    rows = run(spark, HOMES)
    assert [r["status"] for r in rows] == ["compliant", "exceeds", "exceeds", "exceeds"]
    assert [r["potential_penalty_usd"] for r in rows] == [0, pytest.approx(1740, abs=5), pytest.approx(14959, abs=5), pytest.approx(27875, abs=5)]
    assert rows[0]["actual_emissions_tco2e"] == pytest.approx(370.24, abs=0.01)


def test_unknown_type_has_no_cap_but_keeps_its_emissions(spark):
    rows = run(spark, filing("7", "Mixed Use Property", 50000.0, electricity_use_kwh=100000.0))
    assert {r["status"] for r in rows} == {"cap_unavailable"} and len(rows) == 4
    assert all(r["cap_tco2e"] is None and r["potential_penalty_usd"] is None and r["excess_emissions_tco2e"] is None for r in rows)
    assert rows[0]["actual_emissions_tco2e"] > 0


def test_coverage_by_list_or_strictly_larger_area(spark):
    rows = run(
        spark,
        filing("small", "Social/Meeting Hall", 13770.0, electricity_use_kwh=1000.0),
        filing("equal", "Social/Meeting Hall", 25000.0),
        filing("above", "Social/Meeting Hall", 25000.5),
        filing("listed", "Social/Meeting Hall", 1000.0, bbl="1022350029"),
        filing("unknown", "Social/Meeting Hall", None),
    )
    assert {r["property_id"] for r in rows} == {"above", "listed"}


def test_without_a_penalty_rate_there_is_an_excess_and_no_penalty(spark):
    rows = run(spark, HOMES, penalty=False)
    assert rows[1]["excess_emissions_tco2e"] > 0 and rows[1]["potential_penalty_usd"] is None
    assert rows[1]["status"] == "exceeds"


def test_no_usage_is_zero_and_compliant(spark):
    rows = run(spark, filing("z", "Multifamily Housing", 30000.0, electricity_use_kwh=0.0))
    assert {(r["actual_emissions_tco2e"], r["status"]) for r in rows} == {(0.0, "compliant")}
    assert rows[0]["natural_gas_use_kbtu"] is None and rows[0]["electricity_use_kwh"] == 0.0


def test_carry_forward_unscoped_and_unrated_fuels(spark):
    rows = run(
        spark,
        filing("d", "Multifamily Housing", 30000.0, diesel_2_use_kbtu=1000.0),
        filing("e", "Multifamily Housing", 30000.0, electricity_use_kwh=1000.0),
        filing("p", "Multifamily Housing", 30000.0, propane_use_kbtu=500.0, fuel_oil_5_6_use_kbtu=9.0),
    )
    at = {(r["property_id"], r["period_start"]): r["actual_emissions_tco2e"] for r in rows}
    assert at["d", 2035] == pytest.approx(0.07421) and at["e", 2035] == pytest.approx(0.145)
    assert at["e", 2024] == pytest.approx(0.288962) and at["p", 2024] == 0


def test_one_row_per_key_and_no_shuffle_of_filings(spark):
    out = project_filings(clean(spark, HALL, HOMES), facts(spark))
    assert out.count() == out.select("property_id", "period_start", "period_end").distinct().count() == 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_row_form_and_column_form_of_the_sum_agree(spark):
    f = facts(spark)
    periods = spark.createDataFrame(PERIODS, "period_start int, period_end int")
    wide = clean(spark, HALL, HOMES, filing("z", "x", 1.0))
    a = weighted_sum(wide, names.FUEL_OF_USAGE, f.coefficients, periods)
    long = wide.unpivot(["property_id"], list(names.FUEL_OF_USAGE), "column", "use").withColumn(
        "fuel_type", F.create_map(*[F.lit(x) for kv in names.FUEL_OF_USAGE.items() for x in kv])[F.col("column")])
    b = weighted_sum_long(long, "property_id", "fuel_type", "use", f.coefficients, periods)
    key = ["property_id", "period_start", "actual"]
    assert sorted(map(tuple, a.select(key).collect())) == sorted(map(tuple, b.select(key).collect()))


def test_serving(spark):
    p = project_filings(clean(spark, HALL, HOMES, filing("7", "Mixed Use Property", 50000.0)), facts(spark))
    v = {r["property_id"]: r for r in verdicts(p).collect()}
    assert v["12915497"]["verdict"] == "compliant" and v["12915497"]["compliant_through"] == 2049
    assert v["20583499"]["exceeds_from"] == 2030 and v["20583499"]["max_penalty"] == pytest.approx(27875, abs=5)
    assert v["7"]["verdict"] == "cap_unavailable"
    assert [r["period_start"] for r in entity_lookup(p, "property_id", "7").collect()] == [s for s, _ in PERIODS]
    mix = {r["measure"]: r["share"] for r in usage_mix(p).where("property_id = '12915497'").collect()}
    assert set(mix) == {"Grid Electricity", "Natural Gas"} and sum(mix.values()) == pytest.approx(1)


def test_gold_job_writes_and_counts(spark, tmp_path):
    path = str(tmp_path / "gold")
    small = filing("9", "Social/Meeting Hall", 100.0)
    assert load_gold(clean(spark, HALL, HOMES, small), facts(spark), path) == {
        "entities_evaluated": 3, "entities_covered": 2, "rows_written": 8}
    assert spark.read.parquet(path).count() == 8
    assert load_gold(clean(spark, HALL), facts(spark), path)["rows_written"] == 4
    assert spark.read.parquet(path).count() == 4


def test_a_lookup_opens_the_files_of_its_entity_only(spark, tmp_path):
    path = str(tmp_path / "served")
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, F.lit(None)).otherwise((F.col("id") % 500).cast("string")).alias("property_id"),
        F.col("id").alias("period_start"), F.hash("id").alias("x"))
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        write_serving(rows, path, row_group_bytes=4096)
        write_serving(rows, path, row_group_bytes=4096)  # the index changes place with its table
    finally:
        spark.conf.unset(coalesce)
    files = sorted((tmp_path / "served").glob("*.parquet"))
    assert len(files) == 4 and spark.read.parquet(path).count() == 40_000
    assert len(files_of(spark, path, "77")) == 1 and files_of(spark, path, "zzz") == []
    assert len(files_of(spark, path, "hot")) > 1  # a hot entity is in several files
    for value in ("77", "hot", "zzz", "0"):
        got = [tuple(r) for r in serving_lookup(spark, path, value).collect()]
        assert got == [tuple(r) for r in rows.where(F.col("property_id") == value).orderBy("period_start").collect()]
    pages = [pq.ParquetFile(f) for f in files]
    held = [p.metadata.row_group(g).column(0) for p in pages for g in range(p.num_row_groups)]
    with_77 = [c for c in held if c.statistics.has_min_max and c.statistics.min <= "77" <= c.statistics.max]
    assert len(held) > 8 and 1 <= len(with_77) <= 2  # row groups whose statistics let 77 through


def test_lookups_in_tables_without_rows_or_entities(spark, tmp_path):
    schema = "property_id string, period_start int"
    for name, rows in (("none", []), ("nulls", [(None, 1), (None, 2)])):
        path = str(tmp_path / name)
        write_serving(spark.createDataFrame(rows, schema), path)
        assert serving_lookup(spark, path, "a").collect() == []
    with pytest.raises(ValueError):
        serving_lookup(spark, str(tmp_path / "missing"), "a")

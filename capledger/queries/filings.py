"""Raw files, lineage, lake tables and the covered list."""

from __future__ import annotations

from pyspark.sql import functions as F

from capledger.functions import filings as names
from capledger.operators.cleanse import sanitize_columns
from capledger.plans import filings as plans
from capledger.queries.registry import query, table
from capledger.sources import covered_list, tables
from capledger.sources.scratch import scratch_path, stored
from capledger.streaming.incremental import load_new_files


def _raw_orders(spark, folder):
    """Orders as a raw extract: odd headers, quotes and newlines inside a field."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("Order Id"),
        F.col("o_orderstatus").alias("Order Status (F/O/P)"),
        F.concat(F.col("o_orderpriority"), F.lit(', said "so"\nline two')).alias("Notes"),
        F.year("o_orderdate").cast("string").alias("Year Ending"),
    )


def _write_csv(df, path):
    df.write.mode("overwrite").csv(path, header=True, escape='"', quote='"')
    return path


_NOTES_SQL = "o_orderpriority || ', said \"so\"' || chr(10) || 'line two'"


@query("raw_csv_scan", f"""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderstatus AS status, {_NOTES_SQL} AS notes FROM orders""")
def raw_csv_scan(spark, folder):
    path = _write_csv(_raw_orders(spark, folder), scratch_path(spark, "csv"))
    raw = tables.read_raw_csv(spark, path)
    return raw.select(F.col("Order Id").alias("order_id"), F.col("`Order Status (F/O/P)`").alias("status"), F.col("Notes").alias("notes"))


@query("sanitize_columns", f"""SELECT CAST(o_orderkey AS VARCHAR) AS Order_Id, o_orderstatus AS Order_Status_F_O_P, {_NOTES_SQL} AS Notes,
CAST(year(o_orderdate) AS VARCHAR) AS Year_Ending FROM orders""")
def sanitize(spark, folder):
    return sanitize_columns(_raw_orders(spark, folder))


@query("lineage_stamp", """SELECT l_returnflag, 'lineitem.parquet' AS source_file, 1 AS hashes, true AS hashed, count(*) AS n, count(*) AS numbered
FROM lineitem GROUP BY l_returnflag""")
def lineage_stamp(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_returnflag")
    files = stored(tables.file_hashes(spark, f"{folder}/lineitem.parquet"), "files")
    held = tables.file_hashes(spark, f"{folder}/lineitem.parquet").agg(F.collect_set("file_hash"))  # read once more
    return tables.with_lineage(lines, files).groupBy("l_returnflag").agg(
        F.max("_source_file").alias("source_file"),
        F.countDistinct("_source_file_hash").alias("hashes"),
        F.bool_and(F.array_contains(held.scalar(), F.col("_source_file_hash"))).alias("hashed"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("_source_row_number").alias("numbered"),
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query("incremental_skip", """SELECT doc_id, sha256(text) AS content_hash FROM documents
WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source < 'src15')""")
def incremental_skip(spark, folder):
    files = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content_hash"))
    loaded = files.where("source < 'src15'")
    return tables.not_loaded(files, loaded, "content_hash", "content_hash").select("doc_id", "content_hash")


@query("partition_overwrite", """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS part,
CASE WHEN o_orderstatus <> 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS price FROM orders""")
def partition_overwrite(spark, folder):
    path = scratch_path(spark, "parts")
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("part"), F.col("o_totalprice").alias("price"))
    tables.overwrite_partitions(orders, path, ["part"])
    changed = orders.where("part IS NULL OR part <> 'O'").withColumn("price", F.col("price") * 2)
    tables.overwrite_partitions(changed, path, ["part"])
    return tables.read_table(spark, path).select("o_orderkey", "part", "price")


@query("silver_roundtrip", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def silver_roundtrip(spark, folder):
    path = scratch_path(spark, "whole")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    tables.write_table(customers.withColumn("c_name", F.lit("old")), path, ["c_mktsegment"])
    tables.write_table(customers, path, ["c_mktsegment"])
    return tables.read_table(spark, path).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


@query("facts_by_scope", """SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'
AND user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING max(value) > 200)""")
def facts_by_scope(spark, folder):
    events = table(spark, folder, "events")
    facts = events.select("event_id", F.col("user_id").alias("rag_id"), F.col("event_type").alias("jurisdiction"), "value")
    registry = events.groupBy(F.col("user_id").alias("rag_id")).agg((F.max("value") > 200).alias("active_flag"))
    return tables.read_facts(facts, "purchase", registry).select("event_id", F.col("rag_id").alias("user_id"), "value")


def _list_lines(spark, folder):
    """Order lines printed like the covered list, with headers and broken lines among them."""
    flag, n = F.col("l_returnflag"), F.col("l_linenumber")
    gap = F.lit("   ")
    line = F.concat(
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), gap,
        F.when(flag == "A", "Yes").otherwise("No"), gap, n.cast("string"), gap,
        F.col("l_partkey").cast("string"), gap, F.col("l_suppkey").cast("string"), gap,
        F.when(n > 4, F.lit("E   ")).otherwise(""), F.lit("A1"), gap,
        F.when(flag == "N", "2B").otherwise("4"), gap, F.col("l_quantity").cast("int").cast("string"), gap,
        F.format_number(F.floor("l_extendedprice"), 0), F.lit("   "),
        F.when(n < 3, F.lit("12 MAIN ST")).when(n < 5, F.lit("BROADWAY")).otherwise("OLD POST ROAD"), F.lit("  "),
        F.when(F.col("l_linestatus") == "O", "10001-1234").otherwise("10027"),
        F.when(F.col("l_tax") > 0.04, "   Y").otherwise(""),
    )
    text = (
        F.when(F.col("l_discount") == 0, F.concat(F.lit("BBL  Water  "), F.col("l_partkey").cast("string")))
        .when(F.col("l_discount") == 0.1, F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit("  no such layout")))
        .otherwise(line)
    )
    return table(spark, folder, "lineitem").select(text.alias("text"))


_LINES_SQL = """SELECT CASE WHEN l_discount = 0 THEN 'BBL  Water  ' || l_partkey
WHEN l_discount = 0.1 THEN lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '  no such layout'
ELSE lpad(CAST(l_orderkey AS VARCHAR), 10, '0') || '   ' || CASE WHEN l_returnflag = 'A' THEN 'Yes' ELSE 'No' END || '   ' || l_linenumber || '   '
 || l_partkey || '   ' || l_suppkey || '   ' || CASE WHEN l_linenumber > 4 THEN 'E   ' ELSE '' END || 'A1   '
 || CASE WHEN l_returnflag = 'N' THEN '2B' ELSE '4' END || '   ' || CAST(l_quantity AS INT) || '   '
 || format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) || '   '
 || CASE WHEN l_linenumber < 3 THEN '12 MAIN ST' WHEN l_linenumber < 5 THEN 'BROADWAY' ELSE 'OLD POST ROAD' END || '  '
 || CASE WHEN l_linestatus = 'O' THEN '10001-1234' ELSE '10027' END || CASE WHEN l_tax > 0.04 THEN '   Y' ELSE '' END END AS text FROM lineitem"""
_CELLS_SQL = f"""SELECT *, c[7] IS NOT NULL AND regexp_full_match(c[7], '[A-Z0-9]{{2}}') AND regexp_full_match(c[8], '[0-9][A-Z]?') AND regexp_full_match(c[9], '[0-9]+')
  AND regexp_full_match(string_split(c[10], ' ')[1], '[0-9,]+') AS e
FROM (SELECT text, string_split_regex(text, ' {{2,}}') AS c FROM ({_LINES_SQL}) WHERE regexp_matches(text, '^[0-9]{{10}} '))"""
_WORDS_SQL = f"""SELECT *, string_split_regex(array_to_string(c[pos + 3:], ' '), ' +') AS w, CAST(c[-1] NOT LIKE '% %' AND regexp_matches(c[-2], '(^| )[0-9]{{1,5}}(-[0-9]{{4}})?$') AND len(c) > pos + 4 AS INT) AS flagged
FROM (SELECT *, CASE WHEN e THEN 7 ELSE 6 END AS pos FROM ({_CELLS_SQL}))"""
_FIELDS_SQL = f"""SELECT text, c[1] AS bbl, c[2] AS requires_water_data, c[3] AS borough, c[4] AS block, c[5] AS lot, CASE WHEN e THEN c[6] END AS easement,
  c[pos] AS building_class, c[pos + 1] AS tax_class, c[pos + 2] AS building_count, w[1] AS dof_square_footage,
  CASE WHEN len(w) - flagged > 3 THEN w[2] END AS street_number, array_to_string(CASE WHEN len(w) - flagged > 3 THEN w[3:len(w) - flagged - 1] ELSE w[2:len(w) - flagged - 1] END, ' ') AS street_name,
  w[len(w) - flagged] AS zip_code, CASE WHEN flagged = 1 THEN c[-1] END AS multi_building_lot_flag,
  len(c) > pos + 3 AND c[2] IN ('Yes', 'No') AND regexp_full_match(w[1], '[0-9,]+') AND len(w) - flagged > 2 AND regexp_full_match(w[len(w) - flagged], '[0-9]{{1,5}}(-[0-9]{{4}})?') AS fits
FROM ({_WORDS_SQL})"""
_PARSED_SQL = f"SELECT * FROM ({_FIELDS_SQL}) WHERE fits"


def _printed(spark, folder):
    """The lines as text files, read back in their order."""
    path = scratch_path(spark, "list")
    _list_lines(spark, folder).write.text(path)
    return covered_list.scan_lines(spark, path)


@query("layout_lines", f"SELECT {', '.join(covered_list.LINE_FIELDS)} FROM ({_PARSED_SQL})")
def layout_lines(spark, folder):
    return covered_list.parse_layout_lines(_printed(spark, folder), "text")[0]


@query("layout_unmatched", f"SELECT text AS line FROM ({_FIELDS_SQL}) WHERE fits IS NOT TRUE")
def layout_unmatched(spark, folder):
    return covered_list.parse_layout_lines(_printed(spark, folder), "text")[1]


@query("reload_dimension", f"""SELECT bbl, block, lot, building_count, dof_square_footage, requires_water_data FROM (
SELECT bbl, block, lot, CAST(building_count AS INT) AS building_count, CAST(replace(dof_square_footage, ',', '') AS DOUBLE) AS dof_square_footage,
  requires_water_data = 'Yes' AS requires_water_data, row_number() OVER (PARTITION BY bbl ORDER BY block, lot, dof_square_footage, building_count) AS rn
FROM ({_PARSED_SQL})) WHERE rn = 1""")
def reload_dimension(spark, folder):
    rows, _ = covered_list.parse_layout_lines(_printed(spark, folder), "text")
    loaded = covered_list.covered_buildings(rows, ["block", "lot", "dof_square_footage", "building_count"], "list.txt")
    path = scratch_path(spark, "covered")
    tables.write_table(loaded, path)
    return tables.read_table(spark, path).select(
        "bbl", "block", "lot", "building_count", F.col("dof_square_footage").cast("double").alias("dof_square_footage"),
        "requires_water_data")


@query("bronze_load", f"""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, {_NOTES_SQL} AS notes,
CAST(year(o_orderdate) AS VARCHAR) AS year_ending, true AS hashed, true AS skipped_again FROM orders""")
def bronze_load(spark, folder):
    extract = _write_csv(_raw_orders(spark, folder), scratch_path(spark, "extract"))
    path = scratch_path(spark, "bronze")
    plans.load_raw(spark, extract, path)
    again = plans.load_raw(spark, extract, path)
    return plans.read_raw(spark, path).select(
        F.col("Order_Id").alias("order_id"), F.col("Notes").alias("notes"), "year_ending",
        (F.length("_source_file_hash") == 64).alias("hashed"), F.lit(again["skipped"]).alias("skipped_again"))


_EARLY_SQL = "year(o_orderdate) < 1996"


@query("bronze_mixed_headers", f"""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderpriority AS notes, CAST(year(o_orderdate) AS VARCHAR) AS year_ending,
CASE WHEN {_EARLY_SQL} AND o_orderkey % 2 = 1 THEN o_orderstatus END AS extra, CASE WHEN NOT {_EARLY_SQL} THEN CAST(o_custkey AS VARCHAR) END AS more,
(SELECT count(*) FROM orders WHERE {_EARLY_SQL}) AS early_ids FROM orders""")
def bronze_mixed_headers(spark, folder):
    """Two extracts with other columns in another order in one load, and one more column in a second."""
    orders = table(spark, folder, "orders")
    key, notes, year = F.col("o_orderkey").cast("string").alias("Order Id"), F.col("o_orderpriority").alias("Notes"), F.year("o_orderdate").cast("string").alias("Year Ending")
    early = F.year("o_orderdate") < 1996
    a = orders.where(early & (F.col("o_orderkey") % 2 == 0)).select(key, year, notes)
    b = orders.where(early & (F.col("o_orderkey") % 2 == 1)).select(notes, F.col("o_orderstatus").alias("Extra"), key, year)
    c = orders.where(~early).select(year, F.col("o_custkey").cast("string").alias("More"), notes, key)
    path = scratch_path(spark, "mixed")
    first, second, third = (_write_csv(x, scratch_path(spark, "extract")) for x in (a, b, c))
    plans.load_raw(spark, [first, second], path)
    ids = plans.read_raw(spark, path).agg(F.countDistinct("_source_row_number")).first()[0]
    plans.load_raw(spark, third, path)
    return plans.read_raw(spark, path).select(
        F.col("Order_Id").alias("order_id"), F.col("Notes").alias("notes"), "year_ending", F.col("Extra").alias("extra"), F.col("More").alias("more"),
        F.lit(ids).alias("early_ids"))


def _raw_filings(spark, folder):
    """Order lines as raw filings: one order is a property, its lines amended submissions."""
    given = {
        "Property_Id": F.col("l_orderkey").cast("string"),
        "Property_Name": F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")),
        "Primary_Property_Type_Self_Selected": F.when(F.col("l_returnflag") == "R", names.UNREPORTED).otherwise(F.col("l_returnflag")),
        "year_ending": F.lit("12/31/2021"),
        "Property_GFA_Self_Reported_ft": F.when(F.col("l_linenumber") == 1, "Insufficient access").otherwise(F.col("l_extendedprice").cast("string")),
        "Electricity_Use_Grid_Purchase_kWh": F.when(F.col("l_tax") == 0, names.UNREPORTED).when(F.col("l_tax") == 0.08, "NaN").otherwise(F.col("l_quantity").cast("string")),
        names.LOT_COLUMN: F.concat(F.lit("1-"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0"), F.lit("-0001;1-00002-0003")),
        names.SUBMITTED_COLUMN: F.when(F.col("l_linenumber") == 7, "13/45/2021 99:00:00 AM").otherwise(F.date_format("l_shipdate", names.SUBMITTED_FORMAT)),
        "_source_file_hash": F.concat_ws("/", F.lpad(F.col("l_partkey").cast("string"), 9, "0"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")),
        "_source_row_number": F.floor(F.col("l_extendedprice") * 100),
    }
    rest = [c for c in [*names.TEXT_COLUMNS, *names.NUMBER_COLUMNS] if c not in given]
    return table(spark, folder, "lineitem").select(
        *[c.alias(n) for n, c in given.items()], *[F.lit(names.UNREPORTED).alias(c) for c in rest])


@query("silver_clean", """SELECT property_id, property_name, primary_property_type, gross_floor_area_ft, electricity_use_kwh, natural_gas_use_kbtu, bbl, lots FROM (
SELECT CAST(l_orderkey AS VARCHAR) AS property_id, 'Order ' || l_orderkey AS property_name,
  CASE WHEN l_returnflag <> 'R' THEN l_returnflag END AS primary_property_type,
  CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS gross_floor_area_ft,
  CASE WHEN l_tax NOT IN (0, 0.08) THEN l_quantity END AS electricity_use_kwh, CAST(NULL AS DOUBLE) AS natural_gas_use_kbtu,
  '1' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') || '0001' AS bbl, '1' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') || '0001,1000020003' AS lots,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber <> 7 THEN l_shipdate END DESC NULLS LAST,
    l_partkey DESC, l_suppkey DESC, floor(l_extendedprice * 100) DESC) AS rn FROM lineitem) WHERE rn = 1""")
def silver_clean(spark, folder):
    return plans.clean_filings(_raw_filings(spark, folder)).select(
        "property_id", "property_name", "primary_property_type", "gross_floor_area_ft", "electricity_use_kwh",
        "natural_gas_use_kbtu", "bbl", F.array_join("bbl_list", ",").alias("lots"))


def _yearly_filings(spark, folder, lines=None):
    """Order lines as raw filings with a year each, none submitted at the same time as another of its property.

    They are dealt by year while they are narrow.
    """
    lines = table(spark, folder, "lineitem") if lines is None else lines
    lines = lines.repartition(F.year("l_shipdate"))
    given = {
        "Property_Id": F.col("l_orderkey").cast("string"),
        "Year_Ending": F.year("l_shipdate").cast("string"),
        "Electricity_Use_Grid_Purchase_kWh": F.col("l_quantity").cast("string"),
        names.LOT_COLUMN: F.concat(F.lit("1-"), F.lpad(F.col("l_suppkey").cast("string"), 5, "0"), F.lit("-0001")),
        names.SUBMITTED_COLUMN: F.date_format(F.col("l_shipdate").cast("timestamp") + F.make_interval(hours="l_linenumber"), names.SUBMITTED_FORMAT),
    }
    rest = [c for c in [*names.TEXT_COLUMNS, *names.NUMBER_COLUMNS] if c not in given and c != "year_ending"]
    return lines.select(*[c.alias(n) for n, c in given.items()], *[F.lit(names.UNREPORTED).alias(c) for c in rest])


def _write_years(filings, folder):
    """One file a year, with the year in its name; packed, as most fields are the same text. ``filings`` are dealt by year."""
    writer = filings.withColumn("year", F.col("Year_Ending")).write.mode("append").partitionBy("year")
    with tables.unsorted_writes(filings.sparkSession):
        writer.csv(folder, header=True, escape='"', quote='"', compression="gzip")
    return folder


def _latest_sql(rows):
    return f"""SELECT property_id, year_ending, electricity_use_kwh, bbl FROM (SELECT CAST(l_orderkey AS VARCHAR) AS property_id,
CAST(year(l_shipdate) AS VARCHAR) AS year_ending, l_quantity AS electricity_use_kwh, '1' || lpad(CAST(l_suppkey AS VARCHAR), 5, '0') || '0001' AS bbl,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC) AS rn FROM lineitem WHERE {rows}) WHERE rn = 1"""


def _merged(spark, path):
    return plans.read_merged(spark, path).select("property_id", "year_ending", "electricity_use_kwh", "bbl")


@query("silver_incremental", _latest_sql("NOT (year(l_shipdate) = 1992 AND l_linenumber = 1)"))
def silver_incremental(spark, folder):
    """A clean table that follows changed, added and removed rows of its raw files."""
    lines = table(spark, folder, "lineitem")
    year = F.year("l_shipdate")
    raw, clean = scratch_path(spark, "raw"), scratch_path(spark, "clean")
    early = lines.where(year < 1996).withColumn("l_quantity", F.when(year == 1994, F.lit(0.0)).otherwise(F.col("l_quantity")))
    later = lines.where((year >= 1996) | (year == 1994) | ((year == 1992) & (F.col("l_linenumber") != 1)))
    for part in (early, later):
        plans.load_raw(spark, _write_years(_yearly_filings(spark, folder, part), scratch_path(spark, "extracts")) + "/*", raw)
        plans.merge_clean(spark, raw, clean)
    return _merged(spark, clean)


@query("stream_latest", _latest_sql("true"))
def stream_latest(spark, folder):
    """The latest filing of each property, kept up by a stream of files in batches of three."""
    arriving = _write_years(_yearly_filings(spark, folder), scratch_path(spark, "arriving"))
    raw, clean, progress = (scratch_path(spark, n) for n in ("raw", "clean", "progress"))
    for _ in range(2):  # the second run finds nothing new
        load_new_files(spark, arriving + "/*", raw, progress, 3, clean)
    return _merged(spark, clean)

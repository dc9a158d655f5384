"""Cleaning and picking rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from capledger.functions import columns as C
from capledger.operators import cleanse
from capledger.queries.registry import query, table


@query("null_sentinels", """SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority,
nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders""")
def null_sentinels(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return cleanse.null_sentinels(orders, ["4-NOT SPECIFIED", "P"])


@query("try_numeric", """SELECT p_partkey, try_cast(string_split(p_brand, '#')[2] AS DOUBLE) AS brand, CAST(NULL AS DOUBLE) AS kind,
CASE WHEN p_size > 10 THEN CAST(p_size AS DOUBLE) END AS size FROM part""")
def try_numeric(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey", F.split("p_brand", "#")[1].alias("brand"), F.concat(F.col("p_type"), F.lit(" 1,234")).alias("kind"),
        F.when(F.col("p_size") > 10, F.concat(F.lit(" "), F.col("p_size"), F.lit(".0 "))).otherwise("Infinity").alias("size"))
    return cleanse.try_numeric(parts, ["brand", "kind", "size"])


@query("parse_ts", """SELECT e, f, strftime(t, '%Y-%m-%d %H:%M:%S') AS t, count(*) AS n FROM (SELECT event_type AS e, event_id % 7 AS f,
CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) + INTERVAL 1 HOUR * (event_id % 24) END AS t FROM events) GROUP BY ALL""")
def parse_ts(spark, folder):
    """Times of all hours, before and after noon, and texts that are none."""
    at = F.date_trunc("second", "ts") + F.make_dt_interval(hours=(F.col("event_id") % 24).cast("int"))
    text = F.when(F.col("event_type") == "error", "13/45/2021 12:00:00 AM").otherwise(F.date_format(at, "MM/dd/yyyy hh:mm:ss a"))
    t = C.parse_time(text, "MM/dd/yyyy hh:mm:ss a")
    return table(spark, folder, "events").groupBy(
        F.col("event_type").alias("e"), (F.col("event_id") % 7).alias("f"), F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("t")).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_keys", """SELECT c_custkey, '1' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '0001' AS first_key,
'1' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '0001' || CASE WHEN c_mktsegment = 'BUILDING' THEN ',200017' ELSE '' END AS all_keys
FROM customer""")
def normalize_keys(spark, folder):
    lots = F.concat(F.lit("1-"), F.lpad(F.col("c_custkey").cast("string"), 5, "0"), F.lit("-0001"),
                    F.when(F.col("c_mktsegment") == "BUILDING", ";2-0001-7").otherwise(""))
    customers = table(spark, folder, "customer").select("c_custkey", lots.alias("lots"))
    out = cleanse.normalize_keys(customers, "lots", "all_keys", "first_key")
    return out.select("c_custkey", "first_key", F.array_join("all_keys", ",").alias("all_keys"))


@query("project_rename", "SELECT l_orderkey AS order_id, l_linenumber AS line, l_quantity AS quantity FROM lineitem")
def project_rename(spark, folder):
    return cleanse.project(table(spark, folder, "lineitem"), {"l_orderkey": "order_id", "l_linenumber": "line", "l_quantity": "quantity"})


@query("finite_guard", """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view', 'signup') THEN value END AS value FROM events""")
def finite_guard(spark, folder):
    odd = F.when(F.col("event_type") == "error", F.lit(float("nan"))).when(F.col("event_type") == "view", F.lit(float("inf"))).when(
        F.col("event_type") == "signup", F.lit(float("-inf"))).otherwise(F.col("value"))
    return table(spark, folder, "events").select("event_id", C.finite(odd).alias("value"))


@query("header_check", """SELECT event_id, event_type IN ('signup', 'view') AS is_header FROM events""")
def header_check(spark, folder):
    cells = (
        F.when(F.col("event_type") == "signup", F.array(F.lit("Type"), F.lit(""), F.lit("2D")))
        .when(F.col("event_type") == "view", F.array(F.concat(F.lit("k "), "props")))
        .when(F.col("event_type") == "click", F.array(F.lit("Type"), F.col("value").cast("string")))
        .when(F.col("event_type") == "error", F.array(F.lit(""), F.lit("")))
        .otherwise(F.array(F.lit("Type"), F.lit(" 1_000.5e3 ")))
    )
    return table(spark, folder, "events").select("event_id", C.looks_like_header(cells).alias("is_header"))


@query("latest_per_key", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn
FROM lineitem) WHERE rn = 1""")
def latest_per_key(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    ties = ["l_partkey", "l_suppkey", "l_extendedprice"]
    return cleanse.latest_per_key(lines, ["l_orderkey", "l_linenumber"], F.col("l_shipdate"), ties).drop("l_shipdate")


@query("drop_revisions", r"""WITH c AS (SELECT CASE WHEN conv_id % 5 <> 0 THEN conv_id END AS conv, conv_id, turn, role, text, conv_id * 1000 + turn AS place FROM conversations)
SELECT conv, conv_id, turn, sha256(regexp_replace(coalesce(text, ''), '\[[^\]]*\]', '', 'g')) AS kept FROM c
LEFT JOIN (SELECT conv AS id, max(place) AS s FROM c WHERE role = 'system' GROUP BY conv) ON id IS NOT DISTINCT FROM conv WHERE s IS NULL OR place >= s""")
def drop_revisions(spark, folder):
    """The turns of some conversations have no document id: they are one document."""
    turns = table(spark, folder, "conversations").select(
        F.when(F.col("conv_id") % 5 != 0, F.col("conv_id")).alias("conv"), "conv_id", "turn", "role", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("place"))
    kept = cleanse.drop_revisions(turns, "conv", "place", F.col("role") == "system")
    text = F.coalesce(cleanse.drop_struck_text(F.col("text")), F.lit(""))
    return kept.select("conv", "conv_id", "turn", F.sha2(text, 256).alias("kept"))

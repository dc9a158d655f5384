"""Audits and profiles of filings and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from capledger.operators import rollup
from capledger.operators.quantile import exact_median
from capledger.queries.registry import query, table
from capledger.sources import tables


@query("fill_rates", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END), 9) AS fill_rate FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def fill_rates(spark, folder):
    out = rollup.fill_rates(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return out.withColumn("fill_rate", F.round("fill_rate", 9))


@query("missing_share", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL OR {c} IN ('4-NOT SPECIFIED', 'P') THEN 1.0 ELSE 0.0 END), 9) AS missing_share FROM orders"
    for c in ("o_orderstatus", "o_orderpriority")))
def missing_share(spark, folder):
    out = rollup.missing_share(table(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"], ["4-NOT SPECIFIED", "P"])
    return out.withColumn("missing_share", F.round("missing_share", 9))


@query("duplicate_audit", """SELECT outcome, count(*) AS keys FROM (
SELECT CASE WHEN count(v) = 0 THEN 'all_missing' WHEN min(v) <> max(v) THEN 'different' WHEN count(v) < count(*) THEN 'some_missing' ELSE 'equal' END AS outcome
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN l_tax END AS v FROM lineitem)
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) GROUP BY outcome""")
def duplicate_audit(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_tax")).alias("v"))
    return rollup.duplicate_audit(lines, ["l_orderkey", "l_linenumber"], "v")


@query("fact_conflicts", """SELECT l_partkey, l_linenumber, l_tax, count(*) AS statements FROM lineitem
WHERE (l_partkey, l_linenumber) IN (SELECT (l_partkey, l_linenumber) FROM lineitem GROUP BY l_partkey, l_linenumber HAVING count(DISTINCT l_tax) > 1)
GROUP BY ALL""")
def fact_conflicts(spark, folder):
    return rollup.fact_conflicts(table(spark, folder, "lineitem"), ["l_partkey", "l_linenumber"], "l_tax")


@query("profile", """SELECT p_type AS category, count(*) AS n, round(avg(CAST(l_quantity AS DECIMAL(18,4))), 6) AS mean, max(l_quantity) AS maximum,
  round(avg(CASE WHEN len(string_split(p_name, ' ')) > 1 THEN 1.0 ELSE 0.0 END), 9) AS multi_share, median(l_quantity) AS median
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_type""")
def profile(spark, folder):
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"), "p_name")
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_quantity").join(parts, "l_partkey")
    out = rollup.profile(lines, "category", "l_quantity", F.split("p_name", " "))
    return out.withColumns({"mean": F.round("mean", 6), "multi_share": F.round("multi_share", 9)})


@query("median_by_group", """SELECT l_suppkey, median(l_extendedprice) AS median FROM lineitem GROUP BY l_suppkey""")
def median_by_group(spark, folder):
    return exact_median(table(spark, folder, "lineitem"), ["l_suppkey"], "l_extendedprice")


def _mark_sql(hashes: str) -> str:
    """A digest of each bucket of hashes, and one of the buckets in order."""
    return f"""SELECT sha256(string_agg(b || ':' || d, ',' ORDER BY b || ':' || d)) FROM (
SELECT left(h, 3) AS b, sha256(string_agg(h, ',' ORDER BY h)) AS d FROM (SELECT DISTINCT h FROM ({hashes})) GROUP BY b)"""


_MARK_SQL = _mark_sql("SELECT sha256(source) AS h FROM documents")


@query("fingerprint", f"SELECT lang, count(*) AS n, ({_MARK_SQL}) AS fingerprint FROM documents GROUP BY lang")
def fingerprint(spark, folder):
    docs = table(spark, folder, "documents").select("lang", F.sha2("source", 256).alias("h"))
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("fingerprint", F.lit(rollup.fingerprint(docs, "h")))


@query("fingerprint_skip", f"""SELECT s.source, count(*) AS n,
  ({_mark_sql("SELECT sha256(lang) AS h FROM documents")}) =
  ({_mark_sql("SELECT sha256(lang) AS h FROM documents WHERE n_chars > 1000")}) AS unchanged
FROM documents s GROUP BY s.source""")
def fingerprint_skip(spark, folder):
    docs = table(spark, folder, "documents").withColumn("h", F.sha2("lang", 256))
    built = docs.withColumn("fp", F.lit(rollup.fingerprint(docs, "h")))
    same = tables.already_loaded(built, "fp", rollup.fingerprint(docs.where("n_chars > 1000"), "h"))
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("unchanged", F.lit(same))


@query("batch_partitions", """SELECT DISTINCT coalesce(CASE WHEN o_orderstatus <> 'P' THEN CAST(year(o_orderdate) AS VARCHAR) END, '<null>') AS year_ending
FROM orders""")
def batch_partitions(spark, folder):
    batch = table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.year("o_orderdate").cast("string")).alias("year_ending"))
    return tables.batch_partitions(batch, "year_ending")



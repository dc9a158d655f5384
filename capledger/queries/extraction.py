"""Questions, answers and records, from the events as if they were answers."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.functions.vocabulary import COVERED_BUILDING_RULE, EMISSIONS_FACTOR, FACT_KINDS
from capledger.operators import answers as A
from capledger.operators import records as R
from capledger.plans import facts as plans
from capledger.queries.documents import CENTRES_SQL, label_centres
from capledger.queries.registry import query, table
from capledger.sources.scratch import scratch_path, stored

_K = "CAST(json_extract_string(props, '$.k') AS INT)"


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _by_type(**texts):
    out = None
    for kind, text in texts.items():
        cond = F.col("event_type") == kind
        out = F.when(cond, text) if out is None else out.when(cond, text)
    return out


def _answers(spark, folder):
    props = F.col("props")
    n = _k().cast("string")
    text = _by_type(
        signup=F.concat(F.lit(" "), props, F.lit(" \n")),
        click=F.concat(F.lit("Here it is:\n```json\n"), props, F.lit("\n```\nIs that {all}?")),
        view=F.concat(F.lit("The answer is "), props, F.lit(" as stated.")),
        purchase=F.concat(F.lit("Values ["), n, F.lit(", 0] follow.")),
        error=F.concat(F.lit("No {json, "), n),
    )
    return table(spark, folder, "events").select("event_id", "event_type", text.alias("answer"))


@query("parse_answers", f"SELECT event_id, {_K} AS k FROM events WHERE event_type <> 'error'")
def parse_answers(spark, folder):
    parsed, _ = A.parse_answers(_answers(spark, folder), "answer")
    k = F.coalesce(F.try_variant_get("parsed", "$.k", "int"), F.try_variant_get("parsed", "$[0]", "int"))
    return parsed.select("event_id", k.alias("k"))


@query("unparsable_answers", f"SELECT event_id, 'No {{json, ' || {_K} AS answer FROM events WHERE event_type = 'error'")
def unparsable_answers(spark, folder):
    _, broken = A.parse_answers(_answers(spark, folder), "answer")
    return broken.select("event_id", "answer")


@query("explode_records", f"""SELECT event_id, CASE WHEN n = 0 THEN event_type END AS rule_type, CASE WHEN n = 0 THEN value END AS rate,
CASE WHEN n = 0 THEN {_K} END AS chunk_id FROM events, range(2) r(n) WHERE event_type NOT IN ('view', 'error')""")
def explode_records(spark, folder):
    good = F.concat(
        F.lit('{"records": [{"rule_type": "'), "event_type", F.lit('", "rate": '), F.col("value").cast("string"),
        F.lit(', "chunk_id": '), _k().cast("string"), F.lit('}, {"rule_type": null, "rate": null, "chunk_id": "none"}]}'))
    text = F.when(F.col("event_type") == "view", '{"other": 1}').when(F.col("event_type") == "error", "[1, 2]").otherwise(good)
    parsed, _ = A.parse_answers(table(spark, folder, "events").select("event_id", text.alias("answer")), "answer")
    out = A.explode_records(parsed, "parsed", {"rule_type": "string", "rate": "string", "chunk_id": "int"}, ["event_id"])
    return out.withColumn("rate", R.one_number(F.col("rate")).cast("double"))


@query("single_value", f"SELECT event_id, CASE WHEN event_type = 'signup' THEN 'City ' || {_K} END AS jurisdiction FROM events")
def single_value(spark, folder):
    text = _by_type(
        signup=F.concat(F.lit('{"jurisdiction": "  City '), _k().cast("string"), F.lit(' "}')),
        click=F.lit('{"jurisdiction": "   "}'), view=F.lit('{"jurisdiction": 5}'),
        purchase=F.lit('{"jurisdiction": null}'), error=F.lit("{}"),
    )
    parsed, _ = A.parse_answers(table(spark, folder, "events").select("event_id", text.alias("answer")), "answer")
    return parsed.select("event_id", A.single_value("parsed", "jurisdiction").alias("jurisdiction"))


@query("keep_matches", "SELECT event_id, event_type FROM events WHERE event_type = 'click'")
def keep_matches(spark, folder):
    text = _by_type(signup=F.lit('{"is_match": false}'), click=F.lit('{"is_match": true}'), view=F.lit("{}"),
                    purchase=F.lit('{"is_match": null}'), error=F.lit("none"))
    parsed, _ = A.parse_answers(table(spark, folder, "events").select("event_id", "event_type", text.alias("answer")), "answer")
    return A.keep_matches(parsed, "parsed").select("event_id", "event_type")


@query("render_questions", f"""SELECT event_id, 'Is ' || event_type || ' a {{fact}}?' || chr(10) || '<chunk id=' || event_id ||
CASE WHEN event_type = 'view' THEN '' ELSE ' page=' || {_K} END || '>' || chr(10) || props || chr(10) || '</chunk>' || chr(10) || 'Columns: ' ||
CASE WHEN event_type = 'error' THEN '(without names)' ELSE event_type || '; Rate' END AS question FROM events""")
def render_questions(spark, folder):
    headers = F.when(F.col("event_type") != "error", F.array(F.col("event_type"), F.lit(""), F.lit("Rate")))
    page = F.when(F.col("event_type") != "view", _k())
    out = A.render_questions(table(spark, folder, "events"), "Is {concept} a {fact}?\n{candidate}\nColumns: {columns}", {
        "concept": F.col("event_type"),
        "candidate": A.candidate_block(F.col("event_id"), page, F.col("props")),
        "columns": A.headers_line(headers),
    })
    return out.select("event_id", "question")


@query("route_by_kind", """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'table' ELSE 'prose' END AS route FROM events""")
def route_by_kind(spark, folder):
    kind = F.when(F.col("event_type") == "purchase", "table").when(F.col("event_type") != "error", "text")
    tables, prose = A.route_by_kind(table(spark, folder, "events").select("event_id", kind.alias("block_type")))
    return tables.select("event_id", F.lit("table").alias("route")).unionByName(prose.select("event_id", F.lit("prose").alias("route")))


def _records(spark, folder):
    value = F.when(F.col("o_orderpriority") == "2-HIGH", "0.004329281 0.003459842").otherwise(
        F.concat(F.lit(" "), F.col("o_totalprice").cast("decimal(18,2)").cast("string")))
    return table(spark, folder, "orders").select(
        "o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("jurisdiction"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("property_type"),
        F.year("o_orderdate").alias("period_start"), (F.year("o_orderdate") + 5).alias("period_end"),
        F.lit("t/sf").alias("unit"), value.alias("value"))


_BAD_SQL = """SELECT *, list_filter([CASE WHEN o_orderstatus = 'P' THEN 'jurisdiction' END, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'property_type' END,
CASE WHEN o_orderpriority = '2-HIGH' THEN 'value' END], lambda x: x IS NOT NULL) AS bad FROM orders"""


@query("validate_ok", f"""SELECT o_orderkey, o_orderstatus AS jurisdiction, o_orderpriority AS property_type, round(o_totalprice, 2) AS value
FROM ({_BAD_SQL}) WHERE len(bad) = 0""")
def validate_ok(spark, folder):
    ok, _ = R.validate(_records(spark, folder), R.Rules.of(EMISSIONS_FACTOR))
    return ok.select("o_orderkey", "jurisdiction", "property_type", F.col("value").cast("double").alias("value"))


@query("validate_rejects", f"""SELECT o_orderkey, array_to_string(bad, ',') AS failing, 'not usable: ' || array_to_string(bad, ', ') AS reason
FROM ({_BAD_SQL}) WHERE len(bad) > 0""")
def validate_rejects(spark, folder):
    return R.validate(_records(spark, folder), R.Rules.of(EMISSIONS_FACTOR))[1].select("o_orderkey", F.array_join("failing", ",").alias("failing"), "reason")


@query("rows_by_column", """SELECT event_id, event_type AS label, CAST(value AS VARCHAR) AS value FROM events
WHERE (event_type = 'view') = (hour(ts) >= 12)""")
def rows_by_column(spark, folder):
    events = table(spark, folder, "events")
    place = [F.col("user_id").alias("rag_id"), F.hour("ts").alias("chunk_id")]
    column = F.when(F.col("event_type") == "view", "Amount").otherwise("Value")
    rows = events.select(*place, "event_id", F.create_map(
        F.lit("Type"), "event_type", column, F.col("value").cast("string")).alias("cells"))
    matches = events.select(*place).distinct().select(
        "rag_id", "chunk_id", F.lit("Type").alias("label_column"), F.when(F.col("chunk_id") >= 12, "Amount").otherwise("Value").alias("value_column"))
    return R.rows_by_column(matches, rows, ["rag_id", "chunk_id"], "label", "value").select("event_id", "label", "value")


@query("stamp_parent", """SELECT event_id, coalesce(CASE WHEN top > 200 THEN 'User ' || user_id END, event_type) AS jurisdiction
FROM events JOIN (SELECT user_id, max(value) AS top FROM events GROUP BY user_id) USING (user_id)""")
def stamp_parent(spark, folder):
    events = table(spark, folder, "events")
    parents = events.groupBy("user_id").agg(
        F.when(F.max("value") > 200, F.concat(F.lit("User "), F.col("user_id").cast("string"))).alias("jurisdiction"))
    own = events.select("event_id", "user_id", F.col("event_type").alias("jurisdiction"))
    return R.stamp_from_parent(own, parents, "user_id", "jurisdiction").select("event_id", "jurisdiction")


_KEYED_SQL = "SELECT user_id, event_type, CASE WHEN event_type <> 'error' THEN CAST(hour(ts) AS INT) END AS period_start, value, event_id FROM events"


@query("insert_new", f"""WITH e AS ({_KEYED_SQL}) SELECT user_id, event_type, period_start, value, event_id FROM (
SELECT *, row_number() OVER (PARTITION BY user_id, event_type, period_start ORDER BY value, event_id) AS rn FROM e) b
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM e t WHERE t.value > 90 AND t.user_id = b.user_id AND t.event_type = b.event_type
  AND t.period_start IS NOT DISTINCT FROM b.period_start)""")
def insert_new(spark, folder):
    keyed = table(spark, folder, "events").select(
        "user_id", "event_type", F.when(F.col("event_type") != "error", F.hour("ts")).alias("period_start"), "value", "event_id")
    return R.insert_new(keyed.where("value > 90"), keyed, ["user_id", "event_type", "period_start"], ["value", "event_id"])


@query("facts_by_bucket", f"""WITH e AS ({_KEYED_SQL}), a AS (SELECT *, CASE WHEN value > 90 THEN 1 WHEN event_type <> 'view' THEN 2 END AS batch FROM e)
SELECT user_id, event_type, period_start, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, period_start ORDER BY batch, value, event_id) AS rn
FROM a WHERE batch IS NOT NULL) WHERE rn = 1""")
def facts_by_bucket(spark, folder):
    """Three batches into one table kept in buckets of the key: new keys, old and new ones, and the second again."""
    path, key = scratch_path(spark, "fact-buckets"), ["user_id", "event_type", "period_start"]
    keyed = table(spark, folder, "events").select(
        "user_id", "event_type", F.when(F.col("event_type") != "error", F.hour("ts")).alias("period_start"), "value", "event_id")
    later = keyed.where("event_type <> 'view' AND value <= 90")
    for batch in (keyed.where("value > 90"), later, later):
        R.add_new(spark, path, batch, key, ["value", "event_id"], buckets=16)
    return R.read_added(spark, path)


@query("union_records", """SELECT event_id, value, CASE WHEN event_type IN ('purchase', 'click') THEN 't/sf' END AS unit FROM events""")
def union_records(spark, folder):
    events = table(spark, folder, "events")
    from_tables = F.col("event_type").isin("purchase", "click")
    a = events.where(from_tables).select("event_id", "value", F.lit("t/sf").alias("unit"))
    return R.union_records(a, events.where(~from_tables).select("event_id", "value"))


@query("extraction_counts", f"""SELECT event_type AS concept, count(*) AS extracted, count(*) FILTER ({_K} < 10) AS skipped FROM events GROUP BY event_type""")
def extraction_counts(spark, folder):
    records = table(spark, folder, "events").select(F.col("event_type").alias("concept"), F.when(_k() >= 10, _k()).alias("value"))
    _, rejected = R.validate(records, R.Rules(("concept",), ("value",)))
    return R.extraction_counts(records, rejected)


def _reply(row: dict) -> str:
    """A deterministic stand-in for the caller's annotation function."""
    if row["k"] is not None and row["k"] > 80:
        raise ValueError(f"k {row['k']}")
    return f"{row['event_type']}:{row['k']}:{row['big']}"


@query("annotate_candidates", f"""WITH e AS (SELECT event_id, event_type, CASE WHEN event_type <> 'view' THEN {_K} END AS k, 9007199254740992 + event_id AS big FROM events)
SELECT big, k, CASE WHEN k > 80 THEN NULL ELSE event_type || ':' || coalesce(CAST(k AS VARCHAR), 'None') || ':' || big END AS answer,
CASE WHEN k > 80 THEN 'ValueError: k ' || k END AS error FROM e""")
def annotate_candidates(spark, folder):
    events = table(spark, folder, "events").select(
        "event_type", F.when(F.col("event_type") != "view", _k()).alias("k"), (F.lit(9007199254740992) + F.col("event_id")).alias("big"))
    return A.annotate(events, _reply, ["event_type", "k", "big"], ["big", "k"])


def _partly(row: dict) -> str:
    """Answers for clicks, speaks for others, and fails for a fifth of all."""
    if row["k"] > 80:
        raise ValueError(f"k {row['k']}")
    return '{"records": []}' if row["event_type"] == "click" else "none"


@query("facts_failures", f"""SELECT 'EmissionsFactor' AS concept, user_id AS rag_id, event_id AS chunk_id, CASE WHEN {_K} <= 80 THEN 'none' END AS answer,
CASE WHEN {_K} > 80 THEN 'ValueError: k ' || {_K} END AS error FROM events WHERE {_K} > 80 OR event_type <> 'click'""")
def facts_failures(spark, folder):
    """Calls that raise and answers without JSON stay with their reasons."""
    events = table(spark, folder, "events").select(F.col("user_id").alias("rag_id"), F.col("event_id").alias("chunk_id"), "event_type", _k().alias("k"))
    answered = stored(A.annotate(events, _partly, ["event_type", "k"], ["rag_id", "chunk_id"]), "partly")
    return plans.failures(answered, EMISSIONS_FACTOR)


def _expert(row: dict) -> str:
    """Answers the two kinds of questions of a fact extraction from the question's own text."""
    ids = re.findall(r"<chunk id=(\d+)", row["question"])
    if row["question"].startswith("Does this table"):
        return "```json\n" + json.dumps({
            "is_match": True, "jurisdiction": "Town", "label_column": "Type", "value_column": "Rate",
            "period_start": 2024, "period_end": 2029, "unit": "t/sf"}) + "\n```"
    return "Found: " + json.dumps({"records": [
        {"chunk_id": int(i), "property_type": f"Prose {i}", "value": "1 2" if int(i) % 3 == 0 else f"{i}.5",
         "jurisdiction": "Town", "period_start": 2024, "period_end": 2029, "unit": "t/sf"} for i in ids]})


@query("facts_load", f"""WITH near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS rn FROM (
  SELECT label, vec_id, embedding[1] > 0 AS is_table, list_cosine_similarity(CAST(embedding AS DOUBLE[]), query_vector) AS similarity
  FROM embeddings JOIN ({CENTRES_SQL}) ON query_id = label)) WHERE rn <= 15)
SELECT label AS rag_id, vec_id AS chunk_id, CASE WHEN is_table THEN 'Row ' || vec_id ELSE 'Prose ' || vec_id END AS property_type,
  CAST(CASE WHEN is_table THEN vec_id + 0.25 ELSE vec_id + 0.5 END AS DOUBLE) AS value, CASE WHEN label > 4 THEN 'City ' || label ELSE 'Town' END AS jurisdiction
FROM near WHERE is_table OR vec_id % 3 <> 0""")
def facts_load(spark, folder):
    """Search, ask, parse, route, stamp, check and add, over all vectors."""
    vectors = table(spark, folder, "embeddings").select(F.col("label").alias("rag_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    cid = F.col("chunk_id").cast("string")
    chunks = vectors.select(
        "rag_id", "chunk_id", F.lit(1).alias("page_number"), F.when(F.col("embedding")[0] > 0, "table").otherwise("text").alias("block_type"),
        F.concat(F.lit("Chunk "), cid).alias("raw_text"), F.concat(F.lit("Chunk "), cid).alias("full_text"),
        F.array(F.lit("Type"), F.lit("Rate")).alias("column_headers"))
    rows = vectors.select("rag_id", "chunk_id", F.lit(1).alias("row"), F.create_map(
        F.lit("Type"), F.concat(F.lit("Row "), cid), F.lit("Rate"), F.concat(cid, F.lit(".25"))).alias("cells"))
    known = vectors.select("rag_id").distinct().withColumn(
        "jurisdiction", F.when(F.col("rag_id") > 4, F.concat(F.lit("City "), F.col("rag_id").cast("string"))))
    found = plans.candidates(chunks, vectors, label_centres(spark, folder)).where("query_id = rag_id")
    result = plans.extract(found, rows, EMISSIONS_FACTOR, _expert, known)
    fresh = plans.new_facts(result.accepted.where("false"), result.accepted, EMISSIONS_FACTOR)
    return fresh.select("rag_id", F.col("chunk_id").cast("long").alias("chunk_id"), "property_type",
                        F.col("value").cast("double").alias("value"), "jurisdiction")


def _all_kinds_expert(row: dict) -> str:
    """Answers the questions for jurisdictions, matches of tables, and records of every kind."""
    question = row["question"]
    if question.startswith("Which jurisdiction"):
        first = int(re.search(r"Chunk (\d+)", question)[1])
        return json.dumps({"jurisdiction": f"City {first}"}) if first % 2 == 0 else "It does not say."
    if question.startswith("Does this table"):
        return _expert(row)
    kind = next(k for k in FACT_KINDS.values() if question.startswith(f"List every {k.name} "))
    records = []
    for i in map(int, re.findall(r"<chunk id=(\d+)", question)):
        record = {"chunk_id": i, kind.number: f"{i}.5", kind.label: f"Prose {i}", "jurisdiction": "Town"}
        record |= {"period_start": 2024, "period_end": 2029, "unit": "t/sf", "rate_unit": "USD"}
        if kind is COVERED_BUILDING_RULE:
            record["jurisdiction"] = None if i % 5 == 0 else "Town"
        elif i % 3 == 0:
            record[kind.number] = "1 2"
        records.append({f: v for f, v in record.items() if f in ("chunk_id", *kind.fields)})
    return json.dumps({"records": records})


_KIND_LABELS_SQL = ", ".join(f"({i}, '{name}')" for i, name in enumerate(FACT_KINDS))


@query("facts_all_kinds", f"""WITH near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rag_id, concept ORDER BY similarity DESC, v) AS rn FROM (
  SELECT label AS rag_id, concept, vec_id AS v, embedding[1] > 0 AND concept IN ('EmissionsFactor', 'FuelCoefficient') AS is_table, embedding[2] > 0 AS held,
    list_cosine_similarity(CAST(embedding AS DOUBLE[]), query_vector) AS similarity
  FROM embeddings, ({CENTRES_SQL}) JOIN (VALUES {_KIND_LABELS_SQL}) AS k(n, concept) ON n = query_id)) WHERE rn <= 15),
known AS (SELECT label AS rag_id, CASE WHEN min(vec_id) % 2 = 0 THEN 'City ' || min(vec_id) END AS city FROM embeddings GROUP BY label),
records AS (SELECT near.*, coalesce(city, CASE WHEN concept <> 'CoveredBuildingRule' OR v % 5 <> 0 THEN 'Town' END) AS jurisdiction,
  CASE WHEN is_table THEN v + 0.25 WHEN concept = 'CoveredBuildingRule' OR v % 3 <> 0 THEN v + 0.5 END AS number FROM near JOIN known USING (rag_id)),
counted AS (SELECT concept, count(*) AS extracted, count(*) FILTER (WHERE jurisdiction IS NULL OR number IS NULL) AS skipped FROM records GROUP BY concept)
SELECT concept, rag_id, v AS chunk_id, CASE WHEN is_table THEN 'Row ' ELSE 'Prose ' END || v AS label, CAST(number AS DOUBLE) AS number, jurisdiction, extracted, skipped
FROM records JOIN counted USING (concept) WHERE jurisdiction IS NOT NULL AND number IS NOT NULL AND NOT held""")
def facts_all_kinds(spark, folder):
    """Four kinds of facts of all documents: jurisdictions asked, one search, fact tables that hold a part already, counts."""
    vectors = table(spark, folder, "embeddings").select(F.col("label").alias("rag_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    cid, is_table = F.col("chunk_id").cast("string"), F.col("embedding")[0] > 0
    text = F.concat(F.lit("Chunk "), cid)
    chunks = vectors.select(
        "rag_id", "chunk_id", F.lit(1).alias("page_number"), F.when(is_table, "table").otherwise("text").alias("block_type"),
        text.alias("raw_text"), text.alias("full_text"), F.array(F.lit("Type"), F.lit("Rate")).alias("column_headers"))
    rows = vectors.select("rag_id", "chunk_id", F.lit(1).alias("row"), F.create_map(
        F.lit("Type"), F.concat(F.lit("Row "), cid), F.lit("Rate"), F.concat(cid, F.lit(".25"))).alias("cells"))
    names = F.array(*map(F.lit, FACT_KINDS))
    queries = label_centres(spark, folder).where(F.col("query_id").between(0, len(FACT_KINDS) - 1)).select(
        F.get(names, F.col("query_id").cast("int")).alias("query_id"), "query_vector")

    first = vectors.groupBy("rag_id").agg(F.min("chunk_id").alias("first"))
    city = F.when(F.col("first") % 2 == 0, F.concat(F.lit("City "), "first")).otherwise("Town")
    held = vectors.where(F.col("embedding")[1] > 0).join(first, "rag_id")

    def target(kind):
        wording = F.when(is_table & F.lit(kind.from_tables), "Row ").otherwise("Prose ")
        return stored(held.select(
            "rag_id", "chunk_id", city.alias("jurisdiction"), F.concat(wording, cid).alias(kind.label), F.lit(0).cast(R.NUMBER).alias(kind.number),
            F.lit(2024).alias("period_start"), F.lit(2029).alias("period_end")), f"held-{kind.name}")

    fresh, counts, _, _ = plans.load_facts(
        chunks, vectors, rows, queries, {n: target(k) for n, k in FACT_KINDS.items()}, _all_kinds_expert)
    parts = [fresh[n].select(
        F.lit(n).alias("concept"), "rag_id", F.col("chunk_id").cast("long").alias("chunk_id"), F.col(k.label).alias("label"),
        F.col(k.number).cast("double").alias("number"), "jurisdiction") for n, k in FACT_KINDS.items()]
    return reduce(DataFrame.unionByName, parts).join(F.broadcast(counts), "concept")

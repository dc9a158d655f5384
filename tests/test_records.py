import json
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from capledger.functions import vocabulary as V
from capledger.operators import answers as A
from capledger.operators import records as R
from capledger.plans import facts as plans

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ANSWERS = {
    '{"a": 1}': {"a": 1},
    ' \n{"a": 1}\n ': {"a": 1},
    'Sure:\n```json\n{"a": 1}\n```\nmore {x}': {"a": 1},
    '```\n[1, 2]\n```': [1, 2],
    'The answer is {"a": {"b": 2}} ok': {"a": {"b": 2}},
    'Values [1, {"a": 2}] x': {"a": 2},
    'Values [1, 2] x': [1, 2],
    '```json\n{broken\n``` but {"a": 3}': None,
    "] nothing [": None,
    "no json": None,
    "5": 5,
    "": None,
}


def test_json_in_answers(spark):
    df = spark.createDataFrame([(t,) for t in ANSWERS], "answer string")
    parsed, broken = A.parse_answers(df, "answer")
    got = {r["answer"]: json.loads(r["j"]) for r in parsed.select("answer", F.to_json("parsed").alias("j")).collect()}
    assert got == {t: v for t, v in ANSWERS.items() if v is not None}
    assert {r["answer"] for r in broken.collect()} == {t for t, v in ANSWERS.items() if v is None}


def test_exploded_records_keep_what_can_be_read(spark):
    text = '{"records": [{"rate": 268, "unit": "t", "n": "x"}, 7, {"rate": "1 2"}]}'
    parsed, _ = A.parse_answers(spark.createDataFrame([(1, text), (2, "{}"), (3, "[]")], "id int, answer string"), "answer")
    got = A.explode_records(parsed, "parsed", {"rate": "string", "unit": "string", "n": "int"}, ["id"]).collect()
    assert [tuple(r) for r in got] == [(1, "268", "t", None), (1, None, None, None), (1, "1 2", None, None)]


@pytest.mark.parametrize("value, ok", [
    ("0.000288962", True), (" 268 ", True), ("500000", True), ("0.004329281 0.003459842", False),
    (None, False), ("", False), ("NaN", False), ("1,000", False)])
def test_one_number_per_cell(spark, value, ok):
    got = spark.createDataFrame([(value,)], "v string").select(R.one_number(F.col("v"))).first()[0]
    assert (got is not None) is ok


RECORD = "chunk_id int, jurisdiction string, property_type string, period_start int, period_end int, value string, unit string"


def test_validation_names_the_failing_fields(spark):
    df = spark.createDataFrame([
        (1, "NYC", "Office", 2024, 2029, "0.00758", "t"), (2, None, "Office", 2024, None, "0.1 0.2", "t")], RECORD)
    ok, bad = R.validate(df, R.Rules.of(V.EMISSIONS_FACTOR))
    assert [(r["chunk_id"], float(r["value"])) for r in ok.collect()] == [(1, 0.00758)]
    assert [r["reason"] for r in bad.collect()] == ["not usable: jurisdiction, period_end, value"]


def test_allowed_values_are_checked_when_asked(spark):
    df = spark.createDataFrame([("NYC", "late_filing", "$", "1"), ("NYC", "other", "$", "1")],
                               "jurisdiction string, rule_type string, rate_unit string, rate string")
    assert R.validate(df, R.Rules.of(V.PENALTY_RULE))[1].count() == 0
    assert [r["rule_type"] for r in R.validate(df, R.Rules.of(V.PENALTY_RULE, strict=True))[1].collect()] == ["other"]


@pytest.mark.parametrize("kind", V.FACT_KINDS.values(), ids=str)
def test_vocabulary(kind):
    assert kind.label in kind.fields and kind.number in kind.fields and set(kind.required) <= set(kind.fields)
    assert len(V.FUEL_TYPES) == 24 and len(V.RULE_TYPES) == 3 and len(V.THRESHOLD_TYPES) == 2


def test_insert_new_is_null_safe_and_repeatable(spark):
    schema = "rag_id int, chunk_id int, fuel_type string, period_start int, value int"
    batch = spark.createDataFrame([(1, 5, "Gas", None, 2), (1, 4, "Gas", None, 1), (1, 4, "Oil", 2024, 3), (1, 6, "Gas", 2024, 9)], schema)
    key = ["rag_id", "fuel_type", "period_start"]
    target = spark.createDataFrame([(1, 0, "Oil", 2024, 7)], schema)
    first = R.insert_new(target, batch, key, ["chunk_id", "value"])
    assert sorted(r["value"] for r in first.collect()) == [1, 9]
    assert R.insert_new(target.unionByName(first), batch, key, ["chunk_id", "value"]).count() == 0


def test_a_batch_reads_the_buckets_of_its_keys_only(spark, tmp_path):
    schema = "rag_id int, chunk_id int, fuel_type string, period_start int, value int"
    key, order, path = ["rag_id", "fuel_type", "period_start"], ["chunk_id", "value"], str(tmp_path / "facts")
    first = [(i, j, "Gas", None if i % 3 else 2024, i * 10 + j) for i in range(200) for j in (2, 1)]
    added = R.add_new(spark, path, spark.createDataFrame(first, schema), key, order, buckets=32)
    assert added.count() == 200 and {r["chunk_id"] for r in added.collect()} == {1}

    def files():
        return {p: p.stat().st_mtime_ns for p in (tmp_path / "facts").rglob("*.parquet")}

    before = files()
    second = spark.createDataFrame([(7, 1, "Gas", None, 0), (7, 1, "Oil", None, 1), (9, 1, "Gas", 2024, 2), (None, 1, None, None, 3), (None, 1, None, None, 4)], schema)
    # Buckets without a key of the batch are not opened: spoil all of them.
    bucket = F.pmod(F.xxhash64(*key), F.lit(32)).cast("int")
    needed = {f"{R.BUCKET}={r[0]}" for r in second.select(bucket).distinct().collect()}
    kept = {}
    for p in before:
        if p.parent.name not in needed:
            kept[p] = p.read_bytes()
            p.write_bytes(b"PAR1 spoilt")
            (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    sample = next(p for p in before if p.parent.name in needed)
    assert kept and sample.exists()
    held = spark.read.schema(f"{schema}, {R.BUCKET} int").parquet(path)
    fresh = R.insert_new(held.where(F.col(R.BUCKET).isin([int(n.split("=")[1]) for n in needed])), second, key, order)
    assert sorted((r["rag_id"] or 0, r["value"]) for r in fresh.collect()) == [(0, 3), (7, 1)]
    for p, content in kept.items():
        p.write_bytes(content)

    assert sorted((r["rag_id"] or 0, r["value"]) for r in R.add_new(spark, path, second, key, order, buckets=32).collect()) == [(0, 3), (7, 1)]
    after = files()
    assert all(after[p] == t for p, t in before.items() if p not in kept)  # nothing is rewritten
    assert {p.parent.name for p in after.keys() - before.keys()} <= needed
    assert R.add_new(spark, path, second, key, order, buckets=32).count() == 0
    assert R.add_new(spark, path, second.where("false"), key, order, buckets=32).count() == 0
    assert R.read_added(spark, path).count() == 202
    with pytest.raises(ValueError):
        R.add_new(spark, path, second.withColumn("rag_id", F.col("rag_id").cast("long")), key, order, buckets=32)


def test_an_empty_first_batch(spark, tmp_path):
    none = spark.createDataFrame([], "k string, v int")
    path = str(tmp_path / "facts")
    assert R.add_new(spark, path, none, ["k"], ["v"]).count() == 0 and R.read_added(spark, path) is None
    assert R.add_new(spark, path, spark.createDataFrame([("a", 1), (None, 2)], none.schema), ["k"], ["v"]).count() == 2


def test_rows_by_column_skips_tables_without_it(spark):
    rows = spark.createDataFrame([(1, 5, 1, {"Type": "Office", "V": "1"}), (1, 5, 2, {"Type": "Bank"}), (1, 6, 1, {"Type": "x", "V": "2"})],
                                 "rag_id int, chunk_id int, row int, cells map<string,string>")
    matches = spark.createDataFrame([(1, 5, "Type", "V", "NYC"), (1, 6, "Type", "W", "NYC"), (1, 7, "Type", "V", "NYC")],
                                    "rag_id int, chunk_id int, label_column string, value_column string, jurisdiction string")
    got = R.rows_by_column(matches, rows, ["rag_id", "chunk_id"], "property_type", "value").collect()
    assert [(r["chunk_id"], r["property_type"], r["value"], r["jurisdiction"]) for r in got] == [(5, "Office", "1", "NYC")]


def test_known_jurisdiction_overrides(spark):
    own = spark.createDataFrame([(1, "guess"), (2, "guess"), (3, None)], "rag_id int, jurisdiction string")
    known = spark.createDataFrame([(1, "New York City"), (2, None)], "rag_id int, jurisdiction string")
    got = {r["rag_id"]: r["jurisdiction"] for r in R.stamp_from_parent(own, known, "rag_id", "jurisdiction").collect()}
    assert got == {1: "New York City", 2: "guess", 3: None}


def test_failing_calls_do_not_stop_the_others(spark):
    def fn(row):
        return 10 // row["n"]

    df = spark.createDataFrame([(0, 1), (1, 0), (2, 5)], "id int, n int")
    got = {r["id"]: (r["answer"], r["error"]) for r in A.annotate(df, lambda r: str(fn(r)), ["n"], ["id"]).collect()}
    assert got[0] == ("10", None) and got[2] == ("2", None)
    assert got[1][0] is None and got[1][1].startswith("ZeroDivisionError")


def test_questions(spark):
    df = spark.createDataFrame([(7, None, ["Type", ""], "body {text}")], "chunk_id int, page int, heads array<string>, text string")
    out = A.render_questions(df, "{a} and {b}\n{c}{d}", {
        "a": A.candidate_block(F.col("chunk_id"), F.col("page"), F.col("text")), "b": A.headers_line(F.col("heads")),
        "c": A.headers_line(F.lit(None).cast("array<string>"))}).first()["question"]
    assert out == "<chunk id=7>\nbody {text}\n</chunk> and Type\n(without names){d}"


def expert(row):
    """Plays the part of the caller's model."""
    q = row["question"]
    ids = [int(i) for i in re.findall(r"<chunk id=(\d+)", q)]
    if q.startswith("Which jurisdiction"):
        return '```json\n{"jurisdiction": " New York City "}\n```'
    if "is_match" in q:
        if "Fuel" in q:
            return '{"is_match": false}'
        return json.dumps({"is_match": True, "jurisdiction": None, "label_column": "Type", "value_column": "Cap",
                           "period_start": 2024, "period_end": 2029, "unit": "t/sf"})
    if "broken" in q:
        return '{"records": [{"chunk_'
    if "PenaltyRule" in q:
        return json.dumps({"records": [{"chunk_id": ids[0], "rule_type": "excess_emissions", "rate": 268, "rate_unit": "$/t", "candidates": len(ids)}]})
    return json.dumps({"records": [{"chunk_id": ids[0], "property_type": "Hotel", "value": "0.1 0.2", "unit": "t/sf", "period_start": 2024, "period_end": 2029}]})


def test_facts_from_tables_and_prose(spark):
    chunks = spark.createDataFrame([
        (1, 0, 1, "text", "intro", "intro", None), (1, 1, None, None, "prose cap", "prose cap", None),
        (1, 2, 2, "table", "Caps", "Caps", ["Type", "Cap"]), (1, 3, 2, "table", "Fuel", "Fuel", ["Fuel", "Rate"]), (1, 4, 3, "text", "broken", "broken", None),
    ], "rag_id int, chunk_id int, page_number int, block_type string, raw_text string, full_text string, column_headers array<string>")
    vectors = spark.createDataFrame([(1, i, [1.0, i / 10]) for i in range(5)], "rag_id int, chunk_id int, embedding array<float>")
    rows = spark.createDataFrame([(1, 2, 1, {"Type": "Office", "Cap": "0.00758"}), (1, 2, 2, {"Type": "Bank", "Cap": "0.00987"}), (1, 3, 1, {"Fuel": "Gas", "Rate": "1"})],
                                 "rag_id int, chunk_id int, row int, cells map<string,string>")
    queries = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<double>")
    found = plans.candidates(chunks, vectors, queries, 15)
    assert found.count() == 5
    first = spark.createDataFrame([(1, "intro\n---\nprose")], "rag_id int, full_text string")
    known = plans.jurisdictions(first, expert)
    caps = plans.extract(found, rows, V.EMISSIONS_FACTOR, expert, known)
    assert {(r["property_type"], float(r["value"]), r["jurisdiction"], r["chunk_id"]) for r in caps.accepted.collect()} == {
        ("Office", 0.00758, "New York City", 2), ("Bank", 0.00987, "New York City", 2)}
    assert [(r["property_type"], r["reason"]) for r in caps.rejected.collect()] == [
        ("Hotel", "not usable: value")] * 2
    counts = R.extraction_counts(caps.records, caps.rejected).collect()
    assert [tuple(r) for r in counts] == [("EmissionsFactor", 4, 2)]
    penalties = plans.extract(found.where("chunk_id <> 4"), rows, V.PENALTY_RULE, expert, known)
    got = penalties.accepted.collect()
    assert [(r["rule_type"], float(r["rate"]), r["chunk_id"], r["jurisdiction"]) for r in got] == [("excess_emissions", 268.0, 0, "New York City")]
    assert plans.new_facts(penalties.accepted, penalties.accepted, V.PENALTY_RULE).count() == 0
    assert [(r["concept"], r["answer"]) for r in caps.failed.collect()] == [("EmissionsFactor", '{"records": [{"chunk_')]


def test_facts_of_all_kinds(spark):
    chunks = spark.createDataFrame([
        (1, 0, 1, "text", "intro", "intro", None), (1, 1, 2, "table", "Caps", "Caps", ["Type", "Cap"]), (1, 2, 3, "text", "broken", "broken", None),
    ], "rag_id int, chunk_id int, page_number int, block_type string, raw_text string, full_text string, column_headers array<string>")
    vectors = spark.createDataFrame([(1, i, [1.0, i / 10]) for i in range(3)], "rag_id int, chunk_id int, embedding array<float>")
    rows = spark.createDataFrame([(1, 1, 1, {"Type": "Office", "Cap": "0.5"})], "rag_id int, chunk_id int, row int, cells map<string,string>")
    queries = spark.createDataFrame([(name, [1.0, 0.0]) for name in V.FACT_KINDS], "query_id string, query_vector array<double>")

    def ask(row):
        if "FuelCoefficient" in row["question"]:
            raise TimeoutError("no answer")
        return expert(row)

    target = {n: spark.createDataFrame([], ", ".join(["rag_id int, chunk_id int", *[f"{f} string" for f in k.fields if f not in ("period_start", "period_end")], "period_start int, period_end int"])) for n, k in V.FACT_KINDS.items()}
    held = spark.createDataFrame([(1, 1, "New York City", "Office", 2024, 2029)], "rag_id int, chunk_id int, jurisdiction string, property_type string, period_start int, period_end int")
    fresh, counts, rejected, failed = plans.load_facts(chunks, vectors, rows, queries, {**target, "EmissionsFactor": held}, ask)
    assert {n: f.count() for n, f in fresh.items()} == {"EmissionsFactor": 0, "FuelCoefficient": 0, "PenaltyRule": 0, "CoveredBuildingRule": 0}
    assert {tuple(r) for r in counts.collect()} >= {("EmissionsFactor", 2, 1)}
    assert ("EmissionsFactor", ("value",)) in {(r["concept"], tuple(r["failing"])) for r in rejected.collect()}
    broken = {(r["concept"], r["error"] is not None) for r in failed.collect()}
    assert ("FuelCoefficient", True) in broken and ("EmissionsFactor", False) in broken


def test_annotations_see_values_as_they_are(spark):
    seen = spark.createDataFrame([(2**53 + 1, None, "a"), (7, 5, None)], "id long, n long, t string")
    got = {r["id"]: r["answer"] for r in A.annotate(seen, lambda r: repr((r["n"], r["t"])), ["n", "t"], ["id", "n"]).collect()}
    assert got == {2**53 + 1: "(None, 'a')", 7: "(5, None)"}

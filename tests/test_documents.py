import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from capledger.functions import columns as C
from capledger.operators import layout, registry, vectors
from capledger.operators.bounded import lookup_join
from capledger.plans import documents as plans

ITEMS = "doc string, ord int, kind string, text string, page int, table_ref string, caption string"
CELLS = "doc string, table_ref string, row int, col int, text string, column_header boolean, row_section boolean"


def grid(ref, rows, header_rows=(), section_rows=(), doc="d"):
    return [(doc, ref, i, j, t, i in header_rows, i in section_rows) for i, r in enumerate(rows) for j, t in enumerate(r)]


def describe(spark, items, cells, span=2):
    i = spark.createDataFrame([("d", n, *x) for n, x in enumerate(items)], ITEMS)
    c = spark.createDataFrame(cells, CELLS)
    t = layout.describe_tables(i, c, layout.block_of(F.col("ord"), span))
    rows = {}
    for r in layout.table_rows(c, t).orderBy("row").collect():
        rows.setdefault(r["table_ref"], []).append(r["cells"])
    return {r["table_ref"]: r for r in t.collect()}, rows


def head(text):
    return ("section_header", text, 1, None, None)


def para(text):
    return ("text", text, 1, None, None)


def tab(ref, page=42, caption=""):
    return ("table", None, page, ref, caption)


FIRST = [["Property type", "Factor"], ["Office", "0.00758"]]


def test_flagged_header_and_descriptor(spark):
    tables, rows = describe(
        spark, [head(" Emissions factors "), para("For 2024-2029:"), tab("t1")], grid("t1", FIRST, [0]))
    t = tables["t1"]
    assert t["headers"] == ["Property type", "Factor"] and not t["is_continuation"]
    assert t["descriptor_text"] == "Emissions factors\nFor 2024-2029:\nProperty type | Factor"
    assert rows["t1"] == [{"Property type": "Office", "Factor": "0.00758"}]


def test_continuation_inherits_and_keeps_wrongly_flagged_rows(spark):
    second = [["Retail", "0.00675"], ["Museum", "0.01181"], ["Warehouse", "0.00426"]]
    tables, rows = describe(
        spark, [head("h"), para("intro"), tab("t1"), tab("t2"), tab("t3")],
        grid("t1", FIRST, [0]) + grid("t2", second, [1]) + grid("t3", [["Bank", "0.1"]]))
    assert tables["t2"]["is_continuation"] and tables["t3"]["headers"] == ["Property type", "Factor"]
    assert [r["Property type"] for r in rows["t2"]] == ["Retail", "Museum", "Warehouse"]
    assert rows["t3"] == [{"Property type": "Bank", "Factor": "0.1"}]
    assert tables["t3"]["intro"] == "intro"


def test_a_header_of_its_own_is_kept(spark):
    tables, rows = describe(
        spark, [head("h"), tab("t1"), tab("t2")], grid("t1", FIRST, [0]) + grid("t2", [["Fuel", "Rate"], ["Gas", "0.1"]], [0]))
    assert tables["t2"]["headers"] == ["Fuel", "Rate"] and rows["t2"] == [{"Fuel": "Gas", "Rate": "0.1"}]


def test_unflagged_first_row_serves_as_header(spark):
    tables, rows = describe(spark, [tab("t1")], grid("t1", [["Fuel", ""], ["Gas", "0.1"]]))
    assert tables["t1"]["skip_first_row"] and rows["t1"] == [{"Fuel": "Gas", "col_1": "0.1"}]
    assert tables["t1"]["section"] is None and tables["t1"]["descriptor_text"] == "Fuel"


def test_width_and_section_end_a_chain(spark):
    plain = [["Bank", "0.1"]]
    tables, rows = describe(
        spark, [tab("t1"), head("next"), tab("t2"), tab("t3"), tab("t4")],
        grid("t1", FIRST, [0]) + grid("t2", plain) + grid("t3", plain) + grid("t4", [["Bank", "0.1", "x"]]))
    assert tables["t2"]["headers"] == ["", ""] and not tables["t2"]["is_continuation"]
    assert tables["t3"]["is_continuation"] and tables["t3"]["headers"] == ["", ""]  # blank headers are inherited too
    assert not tables["t4"]["is_continuation"]
    assert rows["t2"] == [{"col_0": "Bank", "col_1": "0.1"}] and rows["t4"][0]["col_2"] == "x"


def test_section_rows_blank_rows_and_equal_headers(spark):
    cells = grid("t1", [["Type", "Type"], ["Group A", "Group A"], [" ", ""], ["Office", "5"]], [0], [1])
    _, rows = describe(spark, [tab("t1")], cells)
    assert rows["t1"] == [{"Type": "5"}]


def test_implausible_flagged_header_without_predecessor_is_used_as_is(spark):
    tables, rows = describe(spark, [tab("t1")], grid("t1", [["1", "2"], ["Museum", "0.1"], ["Bank", "0.2"]], [1]))
    assert tables["t1"]["headers"] == ["Museum", "0.1"]
    assert rows["t1"] == [{"Museum": "1", "0.1": "2"}, {"Museum": "Bank", "0.1": "0.2"}]


def test_section_row_on_top_is_no_header(spark):
    tables, _ = describe(spark, [tab("t1")], grid("t1", [["Group", ""], ["Bank", "0.2"]], [], [0]))
    assert not tables["t1"]["skip_first_row"] and tables["t1"]["headers"] == ["", ""]


def test_no_tables(spark):
    tables, rows = describe(spark, [head("h"), para("p")], [])
    assert tables == {} and rows == {}


def test_a_header_clears_the_intro_and_a_table_does_not(spark):
    tables, _ = describe(
        spark, [para("p"), tab("t1"), tab("t2"), para(" "), head("h"), tab("t3")],
        grid("t1", FIRST, [0]) + grid("t2", FIRST, [0]) + grid("t3", FIRST, [0]))
    assert [tables[t]["intro"] for t in ("t1", "t2", "t3")] == ["p", "p", None]


@pytest.mark.parametrize("span", [1, 3, 100])
def test_sections_of_random_documents(spark, span):
    rng = random.Random(span)
    items = [(f"d{rng.randrange(3)}", i, rng.choice(["section_header", "text", "text", "table"]), rng.choice(["a", "b", " c "])) for i in range(200)]
    got = {(r["doc"], r["ord"]): (r["section"], r["intro"], r["section_no"]) for r in layout.fill_section(
        spark.createDataFrame(items, "doc string, ord int, kind string, text string"), block=layout.block_of(F.col("ord"), span)).collect()}
    state = {}
    for doc, i, kind, text in items:
        s = state.setdefault(doc, [None, None, 0])
        if kind == "section_header":
            s[:] = [text.strip(), None, s[2] + 1]
        elif kind == "text":
            s[1] = text.strip()
        assert got[doc, i] == tuple(s)


@pytest.mark.parametrize("text, number", [
    ("1", True), (" 1_000.5e-3 ", True), ("-.5", True), ("1.", True), ("nan", True), ("-Infinity", True),
    ("5d", False), ("1,234", False), ("", False), ("1__0", False), ("e5", False), ("0x1", False), ("1 2", False)])
def test_number_texts(spark, text, number):
    got = spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(C.NUMBER_TEXT)).first()[0]
    assert got is number
    try:
        float(text)
        assert number
    except ValueError:
        assert not number


def test_chunk_metadata(spark):
    rows = [("d", 0, 0, "text", 1, ["A"], "x"), ("d", 1, 1, "table", 6, ["Article A", "Section A.1"], "y"),
            ("d", 1, 2, "text", 5, ["Article A", "Section A.1"], "z"), ("d", 2, 3, None, None, None, "w")]
    df = spark.createDataFrame(rows, "doc string, chunk_id int, ord int, label string, page int, headings array<string>, text string")
    got = {r["ord"]: r for r in plans.layout_chunks(df).collect()}
    assert (got[0]["page_number"], got[0]["block_type"], got[0]["section"], got[0]["section_path"]) == (1, "text", "A", "A")
    assert (got[1]["page_number"], got[1]["block_type"], got[1]["section_path"]) == (5, "mixed", "Article A > Section A.1")
    assert got[1]["raw_text"] == "y\nz" and got[1]["section"] == "Section A.1"
    assert (got[2]["page_number"], got[2]["block_type"], got[2]["section"], got[2]["section_path"]) == (None, "mixed", None, None)


def test_chunk_packing(spark):
    def words(n):
        return " ".join(["w"] * n)

    text = "\n".join([words(3), words(4), "", words(2), words(9), "HEAD", words(1)])
    df = spark.createDataFrame([("a", text), ("empty", " \n "), ("null", None)], "doc string, text string")
    got = layout.chunk_documents(df, "doc", "text", 8, lambda p: C.strip(p) == "HEAD").orderBy("chunk_no").collect()
    assert [(r["chunk_no"], r["n_tokens"], r["section"]) for r in got] == [(0, 7, None), (1, 2, None), (2, 9, None), (3, 2, "HEAD")]
    assert got[0]["raw_text"] == words(3) + "\n" + words(4) and got[3]["full_text"] == "HEAD\nw"


def test_numbering_puts_tables_after_prose(spark):
    prose = spark.createDataFrame([("d", 0, "p0"), ("d", 9, "p9"), ("e", 5, "p")], "doc string, ord int, raw_text string")
    tables = spark.createDataFrame([("d", 3, "t3", "r"), ("d", 12, "t", "r")], "doc string, ord int, raw_text string, table_ref string")
    got = layout.number_chunks(prose, tables, span=2).collect()
    assert sorted((r["doc"], r["chunk_id"], r["raw_text"]) for r in got) == [
        ("d", 0, "p0"), ("d", 1, "p9"), ("d", 2, "t3"), ("d", 3, "t"), ("e", 0, "p")]


def test_first_chunks_as_one_text(spark):
    df = spark.createDataFrame(
        [("d", None, 0, "last"), ("d", 1, 2, "b"), ("d", 1, 1, "a"), ("d", 2, 3, ""), ("e", 1, 0, ""), ("e", 1, 1, None)],
        "doc string, page_number int, chunk_id int, full_text string")
    got = {r["doc"]: r["full_text"] for r in layout.first_k_text(df, "doc", 3).collect()}
    assert got == {"d": "a\n---\nb", "e": None}


REGISTRY = "rag_id string, document_key string, document_hash string, embed_model string, version_id int, active_flag boolean"


def test_registry_versions(spark):
    held = spark.createDataFrame([("r1", "same", "h", "m", 1, True), ("r0", "changed", "h0", "m", 1, False), ("r2", "changed", "h", "m", 2, True)], REGISTRY)
    new = spark.createDataFrame([("same", "h", "m"), ("changed", "h2", "m"), ("new", "h", "m")], "document_key string, document_hash string, embed_model string")

    def rows(force):
        out = registry.upsert_versions(held, new, force)
        assert out.select("rag_id").distinct().count() == out.count()
        return sorted((r["document_key"], r["version_id"], r["active_flag"], r["outcome"]) for r in out.collect())

    assert rows(False) == [
        ("changed", 1, False, "kept"), ("changed", 2, False, "replaced"), ("changed", 3, True, "added"),
        ("new", 1, True, "added"), ("same", 1, True, "skipped")]
    forced = rows(True)
    assert ("same", 1, False, "replaced") in forced and ("same", 2, True, "added") in forced
    active = registry.active_versions(held).collect()
    assert {(r["document_key"], r["version_id"]) for r in active} == {("same", 1), ("changed", 2)}


@pytest.mark.parametrize("at_once", [2, 1000])
def test_nearest_vectors_against_numpy(spark, monkeypatch, at_once):
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", at_once)
    monkeypatch.setattr(vectors, "BYTES_AT_ONCE", 64 * at_once)
    rng = np.random.default_rng(0)
    data = rng.normal(size=(300, 8))
    data[10:20] = data[5]
    scopes = ["hot" if i % 3 else f"s{i % 4}" for i in range(300)]
    queries = rng.normal(size=(5, 8))
    df = spark.createDataFrame([(scopes[i], i, data[i].tolist()) for i in range(300)], "scope string, id int, v array<float>").repartition(5)
    q = spark.createDataFrame([(f"q{j}", queries[j].tolist()) for j in range(5)], "query_id string, query_vector array<double>")
    got = vectors.cosine_topk(df, q, 4, "id", "v", scope=["scope"]).collect()
    data32 = data.astype(np.float32).astype(np.float64)
    sims = np.round((data32 / np.linalg.norm(data32, axis=1, keepdims=True)) @ (queries / np.linalg.norm(queries, axis=1, keepdims=True)).T, 9)
    want = {}
    for j in range(5):
        for s in set(scopes):
            ids = sorted((i for i in range(300) if scopes[i] == s), key=lambda i: (-sims[i, j], i))[:4]
            for r, i in enumerate(ids, 1):
                want[s, f"q{j}", r] = i
    assert {(r["scope"], r["query_id"], r["rank"]): r["id"] for r in got} == want


def test_zero_vectors_come_last_and_stay_zero(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [-3.0, -4.0])], "id int, v array<float>")
    q = spark.createDataFrame([(7, [3.0, 4.0])], "query_id int, query_vector array<double>")
    got = vectors.cosine_topk(df, q, 2, "id", "v").orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in got] == [(2, -1.0), (1, None)]
    unit = {r["id"]: r["v"] for r in vectors.normalize_vectors(df, "v").collect()}
    assert unit[1] == [0.0, 0.0] and math.isclose(unit[2][1], -0.8)


def test_registration_marks_what_to_parse_again(spark):
    empty = spark.createDataFrame([], REGISTRY)
    docs = spark.createDataFrame([("a", "text a"), ("b", "text b")], "document_key string, text string")
    held, changed = plans.register(empty, docs, "m")
    assert changed.count() == 2
    later = spark.createDataFrame([("a", "text a"), ("b", "new text")], "document_key string, text string")
    _, again = plans.register(held.drop("outcome"), later, "m")
    assert [r["document_key"] for r in again.collect()] == ["b"]


def test_store_keeps_earlier_versions(spark, tmp_path):
    root = str(tmp_path / "docs")
    empty = spark.createDataFrame([], "rag_id string, document_key string, document_hash string, embed_model string, version_id int, active_flag boolean")
    embed = lambda c: c.select("doc", "chunk_id", F.array(F.length("embed_text").cast("float")).alias("embedding"))
    first = spark.createDataFrame([("a", "one two\nthree", 1), ("b", "four", 1), ("b", "four", 1), ("c", "old", 1), ("c", "new", 2)], "document_key string, text string, sent int")
    held, counts = plans.ingest(empty, first, "m", 2, root, embed=embed, order=["sent"])
    assert counts == {"added": 3, "skipped": 0}
    later = spark.createDataFrame([("a", "one two\nthree", 3), ("c", "newer", 3)], first.schema)
    held, counts = plans.ingest(held, later, "m", 2, root, embed=embed, order=["sent"])
    assert counts == {"added": 1, "skipped": 1}
    chunks = spark.read.parquet(f"{root}/document_chunks")
    assert sorted(r["raw_text"] for r in chunks.collect()) == ["four", "new", "newer", "one two", "three"]
    assert spark.read.parquet(f"{root}/document_vectors").count() == 5
    inactive = held.withColumn("active_flag", F.lit(False))
    again, _ = plans.ingest(inactive, later.where("sent = 3 AND document_key = 'c'"), "m", 2, root)
    assert {(r["version_id"]) for r in again.where("document_key = 'c'").collect()} == {1, 2, 3}
    assert again.select("rag_id").distinct().count() == again.count()


def test_parsed_documents_are_stored_by_version(spark, tmp_path):
    root = str(tmp_path / "docs")
    empty = spark.createDataFrame([], REGISTRY)
    item = "doc string, ord int, kind string, text string, page int, table_ref string, caption string, chunk_id int, label string, headings array<string>"
    items = spark.createDataFrame([
        ("a", 1, "section_header", "Caps", 1, None, None, None, None, None),
        ("a", 2, "text", "first", 1, None, None, 0, "text", ["Caps"]), ("a", 3, "text", "second", 2, None, None, 0, "list", ["Caps"]),
        ("a", 4, "table", None, 3, "t1", "Table 1", None, None, None), ("a", 5, "text", None, 3, None, None, 1, "text", None),
        ("b", 1, "table", None, 7, "t1", None, None, None, None), (None, 1, "text", "lost", 1, None, None, 0, "text", None),
    ], item)
    cell = "doc string, table_ref string, row int, col int, text string, column_header boolean, row_section boolean"
    cells = spark.createDataFrame([
        ("a", "t1", 0, 0, "Type", True, False), ("a", "t1", 0, 1, "Rate", True, False), ("a", "t1", 1, 0, "Office", False, False), ("a", "t1", 1, 1, "0.5", False, False),
    ], cell)
    delivery = spark.createDataFrame([("a", "v1"), ("a", "v1"), ("b", "v1"), ("no items", None), (None, "v1")], "document_key string, text string")
    embed = lambda c: c.select("doc", "chunk_id", F.length("embed_text").alias("embedding"))

    held, done = plans.ingest_parsed(empty, delivery, items, cells, "m", root, embed)
    assert done == {"added": 2, "skipped": 0, "chunks": 4, "rows": 1}
    key_of = {r["rag_id"]: r["document_key"] for r in held.collect()}
    chunks = {(key_of[r["doc"]], r["chunk_id"]): r for r in spark.read.parquet(f"{root}/document_chunks").collect()}
    assert sorted(chunks) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    assert chunks["a", 0]["raw_text"] == "first\nsecond" and chunks["a", 0]["block_type"] == "mixed" and chunks["a", 0]["page_number"] == 1
    assert chunks["a", 2]["raw_text"] == "Caps\nsecond\nTable 1\nType | Rate" and chunks["a", 2]["column_headers"] == ["Type", "Rate"]
    rows = spark.read.parquet(f"{root}/document_tables").collect()
    assert [(key_of[r["doc"]], r["chunk_id"], r["cells"]) for r in rows] == [("a", 2, {"Type": "Office", "Rate": "0.5"})]
    assert spark.read.parquet(f"{root}/document_vectors").count() == 4

    again, done = plans.ingest_parsed(held, delivery.where("document_key = 'b'"), items, cells, "m", root, embed)
    assert done == {"added": 0, "skipped": 1, "chunks": 0, "rows": 0}
    changed = spark.createDataFrame([("a", "v2"), ("b", "v1")], delivery.schema)
    again, done = plans.ingest_parsed(again, changed, items, cells, "m", root, embed)
    assert done == {"added": 1, "skipped": 1, "chunks": 3, "rows": 1}
    assert [r["version_id"] for r in again.where("document_key = 'a' AND active_flag").collect()] == [2]
    assert spark.read.parquet(f"{root}/document_chunks").count() == 7  # the earlier version stays


def test_parsed_items_and_cells_meet_only_the_keys_of_what_changed(spark, tmp_path, monkeypatch):
    met = []
    monkeypatch.setattr(plans, "lookup_join", lambda big, small, *a, **b: met.append(small.columns) or lookup_join(big, small, *a, **b))
    items = spark.createDataFrame([("a", 1, "table", None, 1, "t1", None, None, None, None), ("b", 1, "table", None, 1, "t1", None, None, None, None)],
                                  "doc string, ord int, kind string, text string, page int, table_ref string, caption string, chunk_id int, label string, headings array<string>")
    cells = spark.createDataFrame([(d, "t1", i, 0, t, i == 0, False) for d in "ab" for i, t in enumerate(("Rate", "0.5"))],
                                  "doc string, table_ref string, row int, col int, text string, column_header boolean, row_section boolean")
    documents = spark.createDataFrame([("a", "v1"), ("b", "v1")], "document_key string, text string")
    held, done = plans.ingest_parsed(spark.createDataFrame([], REGISTRY), documents, items, cells, "m", str(tmp_path / "docs"))
    assert met == [["doc"], ["doc"], ["doc", "rag_id"]] and done["chunks"] == done["rows"] == 2
    rows = spark.read.parquet(str(tmp_path / "docs" / "document_tables")).collect()
    assert sorted((r["doc"], r["chunk_id"], r["cells"]["Rate"]) for r in rows) == sorted((r["rag_id"], 0, "0.5") for r in held.collect())


def test_null_documents_and_flags(spark):
    from capledger.operators.cleanse import drop_revisions
    from capledger.operators.layout import table_rows

    items = spark.createDataFrame([(None, 1, "x"), (None, 2, "H"), (None, 3, "y"), ("d", 1, "z")], "doc string, ord int, t string")
    kept = drop_revisions(items, "doc", "ord", F.col("t") == "H").collect()
    assert sorted(r["t"] for r in kept) == ["H", "y", "z"]
    cells = spark.createDataFrame([("d", "t1", 0, 0, "v", None, None)], "doc string, table_ref string, row int, col int, text string, column_header boolean, row_section boolean")
    tables = spark.createDataFrame([("d", "t1", ["A"], False, False)], "doc string, table_ref string, headers array<string>, skip_first_row boolean, is_continuation boolean")
    assert [r["cells"] for r in table_rows(cells, tables).collect()] == [{"A": "v"}]


def test_vectors_of_other_lengths_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id int, v array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, query_vector array<double>")
    with pytest.raises(Exception, match="vector 2 has 1 components"):
        vectors.cosine_topk(df, q, 1, "id", "v").collect()


@pytest.mark.parametrize("query_block,vector_block", [(7, 20), (2048, 16384)])
def test_every_vector_as_a_query(spark, query_block, vector_block):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(120, 5)), 1)
    v[7] = v[3]
    v[11] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    queries = frame.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = vectors.cosine_topk_all(frame, queries, 9, "id", "vector", query_block=query_block, vector_block=vector_block).collect()
    with np.errstate(invalid="ignore"):
        unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    for q in range(120):
        mine = sorted((r["rank"], r["id"]) for r in got if r["query_id"] == q)
        near = [float((unit[i] * unit[q]).sum()) for i in range(120)]
        want = sorted(range(120), key=lambda i: (near[i] != near[i], -near[i] if near[i] == near[i] else 0, i))[:9]
        assert [m[1] for m in mine] == want and [m[0] for m in mine] == list(range(1, 10))
    assert len(got) == 120 * 9


def test_plain_texts_are_numbered_without_a_shuffle_of_their_own(spark):
    texts = spark.createDataFrame([("a", "one two\nthree\nfour"), ("b", "five")], "rag_id string, text string")
    prose = plans.text_chunks(texts.repartition(3, "rag_id"), 2)
    out = layout.number_chunks(prose, prose.limit(0), span=None)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Union" not in plan
    assert sorted((r["doc"], r["chunk_id"], r["raw_text"]) for r in out.collect()) == [("a", 0, "one two"), ("a", 1, "three\nfour"), ("b", 0, "five")]

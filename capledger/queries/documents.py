"""Versions, sections, tables, chunks and vectors of documents.

A conversation is read as a document: system turns are section headers, user
turns text, assistant turns tables. A user's events are read as a document with
tables of two or three columns, some with headers, some continuing the one before.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from capledger.operators import layout, registry
from capledger.operators.vectors import cosine_topk, cosine_topk_all, normalize_vectors
from capledger.plans import documents as plans
from capledger.queries.registry import query, table
from capledger.sources.scratch import scratch_path
from capledger.sources.tables import read_table

SPAN = 4_096


def _turns(spark, folder):
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("doc"), F.col("turn").alias("ord"),
        F.when(F.col("role") == "system", layout.HEADER).when(F.col("role") == "user", layout.TEXT).otherwise(layout.TABLE).alias("kind"),
        "text",
    )


@query("section_fill", """WITH s AS (SELECT conv_id, turn, role, trim(text) AS t,
  sum(CASE WHEN role = 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section_no FROM conversations)
SELECT conv_id, turn, CAST(section_no AS BIGINT) AS section_no,
  sha256(last_value(CASE WHEN role = 'system' THEN t END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn)) AS section,
  sha256(last_value(CASE WHEN role = 'user' AND t <> '' THEN t END IGNORE NULLS) OVER (PARTITION BY conv_id, section_no ORDER BY turn)) AS intro
FROM s""")
def section_fill(spark, folder):
    out = layout.fill_section(_turns(spark, folder), block=layout.block_of(F.col("ord"), SPAN))
    return out.select(F.col("doc").alias("conv_id"), F.col("ord").alias("turn"), F.col("section_no").cast("long").alias("section_no"),
                      F.sha2("section", 256).alias("section"), F.sha2("intro", 256).alias("intro"))


def _event_items(spark, folder):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (F.when(F.col("event_type") == "signup", layout.HEADER).when(F.col("event_type") == "view", layout.TEXT)
            .otherwise(layout.TABLE))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), kind.alias("kind"),
        F.concat_ws(" ", "event_type", k.cast("string")).alias("text"), F.hour("ts").alias("page"),
        F.col("event_id").cast("string").alias("table_ref"), F.when(k < 20, F.concat(F.lit("Table "), k.cast("string"))).otherwise("").alias("caption"),
        "event_type", "value", k.alias("k"),
    )


def _event_cells(spark, folder):
    t, row, col, k = F.col("event_type"), F.col("row"), F.col("col"), F.col("k")
    number = F.col("value").cast("string")
    top = (
        F.when(t == "purchase", F.element_at(F.array(F.lit("Type"), F.lit(" Rate "), F.lit("Type")), col + 1))
        .when(t == "error", F.element_at(F.array(F.lit("Kind"), F.lit(""), F.lit("Extra")), col + 1))
        .otherwise(F.element_at(F.array(F.lit("Office"), number, F.lit("")), col + 1))
    )
    body = F.element_at(F.array(F.concat(t, row.cast("string")), number, F.lit("x")), col + 1)
    blank = (t == "error") & (row == 2) & (k < 60)
    text = F.when(row == 0, top).when(blank, F.lit(" ")).otherwise(body)
    header = ((t == "purchase") & (row == 0)) | ((t == "click") & (row == 1))
    return (
        _event_items(spark, folder).where(F.col("kind") == layout.TABLE)
        .withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(2))))
        .withColumn("col", F.explode(F.sequence(F.lit(0), F.when(k < 50, 1).otherwise(2))))
        .select("doc", "table_ref", "row", "col", text.alias("text"), header.alias("column_header"),
                ((t == "purchase") & (row == 2) & (k < 30)).alias("row_section"))
    )


def _described(spark, folder):
    return layout.describe_tables(
        _event_items(spark, folder).drop("event_type", "value", "k"), _event_cells(spark, folder), layout.block_of(F.col("ord"), SPAN))


_ITEMS_SQL = """it AS (SELECT user_id AS doc, event_id AS ord, event_type AS t, value, hour(ts) AS page, CAST(event_id AS VARCHAR) AS table_ref,
  CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
sec AS (SELECT *, sum(CASE WHEN t = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY ord) AS section_no FROM it),
ctx AS (SELECT *, last_value(CASE WHEN t = 'signup' THEN t || ' ' || k END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY ord) AS section,
  last_value(CASE WHEN t = 'view' THEN t || ' ' || k END IGNORE NULLS) OVER (PARTITION BY doc, section_no ORDER BY ord) AS intro FROM sec),
cells AS (SELECT doc, table_ref, r AS row, c AS col,
  trim(CASE WHEN r = 0 THEN CASE t WHEN 'purchase' THEN ['Type', ' Rate ', 'Type'][c + 1] WHEN 'error' THEN ['Kind', '', 'Extra'][c + 1]
      ELSE ['Office', CAST(value AS VARCHAR), ''][c + 1] END
    WHEN t = 'error' AND r = 2 AND k < 60 THEN ' '
    ELSE [t || r, CAST(value AS VARCHAR), 'x'][c + 1] END) AS text,
  (t = 'purchase' AND r = 0) OR (t = 'click' AND r = 1) AS column_header, t = 'purchase' AND r = 2 AND k < 30 AS row_section
  FROM it, range(3) a(r), range(3) b(c) WHERE t NOT IN ('signup', 'view') AND c < CASE WHEN k < 50 THEN 2 ELSE 3 END),
shapes AS (SELECT doc, table_ref, count(*) AS n_cols, list(flag ORDER BY col) AS flagged, list(top ORDER BY col) AS first_row FROM (
  SELECT doc, table_ref, col, coalesce(max(text) FILTER (column_header), '') AS flag, max(text) FILTER (row = 0) AS top
  FROM cells GROUP BY ALL) GROUP BY ALL),
judged AS (SELECT *, len(list_filter(flagged, lambda x: x <> '')) > 0 AND len(list_filter(flagged, lambda x: regexp_matches(x, '^[0-9.]+$'))) = 0 AS own_flag,
  len(list_filter(first_row, lambda x: x <> '')) > 0 AND len(list_filter(first_row, lambda x: regexp_matches(x, '^[0-9.]+$'))) = 0 AS own_row FROM shapes),
ordered AS (SELECT *, lag(section_no) OVER w AS before_no, lag(n_cols) OVER w AS before_cols
  FROM ctx JOIN judged USING (doc, table_ref) WINDOW w AS (PARTITION BY doc ORDER BY ord)),
marked AS (SELECT *, coalesce(NOT own_flag AND NOT own_row AND before_no = section_no AND before_cols = n_cols, false) AS is_continuation FROM ordered),
grouped AS (SELECT *, sum(CASE WHEN is_continuation THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY ord) AS g FROM marked),
tables AS (SELECT *, NOT own_flag AND own_row AS skip_first_row,
  first_value(CASE WHEN NOT own_flag AND own_row THEN first_row ELSE flagged END) OVER (PARTITION BY doc, g ORDER BY ord) AS headers FROM grouped)"""


@query("header_inherit", f"""WITH {_ITEMS_SQL} SELECT doc, table_ref, CAST(n_cols AS INT) AS n_cols, is_continuation, skip_first_row,
array_to_string(headers, '|') AS headers FROM tables""")
def header_inherit(spark, folder):
    return _described(spark, folder).select(
        "doc", "table_ref", "n_cols", "is_continuation", "skip_first_row", F.array_join("headers", "|").alias("headers"))


@query("descriptor_text", f"""WITH {_ITEMS_SQL} SELECT doc, table_ref, concat_ws(chr(10), section, intro,
CASE WHEN k < 20 THEN 'Table ' || k END, nullif(array_to_string(list_filter(headers, lambda h: h <> ''), ' | '), '')) AS descriptor FROM tables""")
def descriptor_text(spark, folder):
    return _described(spark, folder).select("doc", "table_ref", F.col("descriptor_text").alias("descriptor"))


@query("table_rows", f"""WITH {_ITEMS_SQL},
kept AS (SELECT doc, table_ref, row FROM cells JOIN tables USING (doc, table_ref) GROUP BY doc, table_ref, row
  HAVING NOT bool_or(row_section) AND bool_or(text <> '') AND NOT (bool_or(skip_first_row) AND row = 0)
    AND (bool_or(is_continuation) OR NOT bool_or(column_header)))
SELECT doc, table_ref, CAST(row AS INT) AS row, label, last(text ORDER BY col) AS value FROM (
  SELECT doc, table_ref, row, col, text, CASE WHEN headers[col + 1] <> '' THEN headers[col + 1] ELSE 'col_' || col END AS label
  FROM cells JOIN kept USING (doc, table_ref, row) JOIN tables USING (doc, table_ref)) GROUP BY doc, table_ref, row, label""")
def table_rows(spark, folder):
    rows = layout.table_rows(_event_cells(spark, folder), _described(spark, folder))
    return rows.select("doc", "table_ref", "row", F.explode("cells").alias("label", "value"))


@query("number_chunks", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY role = 'assistant', turn) - 1 AS chunk_id
FROM conversations WHERE role <> 'system'""")
def number_chunks(spark, folder):
    turns = _turns(spark, folder).select("doc", "ord", "kind")
    out = layout.number_chunks(turns.where("kind = 'text'"), turns.where("kind = 'table'"), span=SPAN)
    return out.select(F.col("doc").alias("conv_id"), F.col("ord").alias("turn"), "chunk_id")


@query("chunk_metadata", """SELECT user_id, chunk_id, min(page) AS page_number, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages,
CASE WHEN count(DISTINCT event_type) = 1 THEN max(event_type) ELSE 'mixed' END AS block_type,
CASE WHEN chunk_id > 3 THEN 'Section ' || user_id END AS section, CASE WHEN chunk_id > 3 THEN 'Article ' || chunk_id || ' > Section ' || user_id END AS section_path
FROM (SELECT user_id, CAST(floor(event_id / 500) AS BIGINT) AS chunk_id, CAST(hour(ts) AS INT) AS page, event_type FROM events) GROUP BY user_id, chunk_id""")
def chunk_metadata(spark, folder):
    chunk = F.floor(F.col("event_id") / 500)
    heads = F.array(F.concat(F.lit("Article "), chunk.cast("string")), F.concat(F.lit("Section "), F.col("user_id").cast("string")))
    items = table(spark, folder, "events").select(
        "user_id", chunk.alias("chunk_id"), F.col("event_type").alias("label"), F.hour("ts").alias("page"),
        F.when(chunk > 3, heads).alias("headings"))
    out = layout.chunk_metadata(items, ["user_id", "chunk_id"])
    texts = F.array_sort(F.transform("page_numbers", lambda p: p.cast("string")))
    return out.select("user_id", "chunk_id", "page_number", F.array_join(texts, ",").alias("pages"), "block_type", "section", "section_path")


@query("first_k_text", """SELECT source, sha256(string_agg(text, chr(10) || '---' || chr(10) ORDER BY rn)) AS text FROM (
SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang <> 'en' THEN n_chars END ASC NULLS LAST, doc_id) AS rn FROM documents)
WHERE rn <= 3 AND text <> '' GROUP BY source""")
def first_k_text(spark, folder):
    docs = table(spark, folder, "documents").select(
        "source", F.when(F.col("lang") != "en", F.col("n_chars")).alias("page_number"), F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("full_text"))
    return layout.first_k_text(docs, "source", 3).select("source", F.sha2("full_text", 256).alias("text"))


@query("version_history", """SELECT user_id, event_id, event_type, row_number() OVER w AS version_id, lead(event_id) OVER w IS NULL AS active_flag FROM (
SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
WHERE before IS NULL OR before <> event_type WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def version_history(spark, folder):
    return registry.version_history(table(spark, folder, "events"), "user_id", ["event_id"], "event_type", layout.block_of(F.col("event_id"), SPAN))


@query("upsert_versions", """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS document_key, lang, sha256(text) AS h,
  CASE WHEN n_chars > 2000 THEN sha256(text || '!') ELSE sha256(text) END AS new_hash FROM documents)
SELECT document_key, h AS document_hash, 3 AS version_id, lang = 'en' OR h = new_hash AS active_flag,
  CASE WHEN lang = 'en' THEN 'kept' WHEN h = new_hash THEN 'skipped' ELSE 'replaced' END AS outcome FROM d WHERE lang IN ('en', 'fr')
UNION ALL SELECT document_key, new_hash, CASE WHEN lang = 'fr' THEN 4 ELSE 1 END, true, 'added' FROM d
WHERE lang NOT IN ('en', 'fr') OR (lang = 'fr' AND h <> new_hash)""")
def upsert_versions(spark, folder):
    docs = table(spark, folder, "documents")
    old, key = F.sha2("text", 256), F.col("doc_id").cast("string").alias("document_key")
    held = docs.where("lang IN ('en', 'fr')").select(
        F.sha2(key, 256).alias("rag_id"), key, old.alias("document_hash"), F.lit("m").alias("embed_model"),
        F.lit(3).alias("version_id"), F.lit(True).alias("active_flag"))
    new = F.when(F.col("n_chars") > 2000, F.sha2(F.concat("text", F.lit("!")), 256)).otherwise(old)
    arriving = docs.where("lang <> 'en'").select(key, new.alias("document_hash"), F.lit("m").alias("embed_model"))
    return registry.upsert_versions(held, arriving).select("document_key", "document_hash", "version_id", "active_flag", "outcome")


BUDGET = 60
_WALK_SQL = f"""WITH RECURSIVE parts AS MATERIALIZED (SELECT doc_id, i, p, w, w <= 3 AS h, trim(p, chr(32) || chr(9) || chr(10) || chr(13)) AS s FROM (
  SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS i, len(string_split_regex(trim(p, chr(32) || chr(9) || chr(10) || chr(13)), '\\s+')) AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
  WHERE trim(p, chr(32) || chr(9) || chr(10) || chr(13)) <> '')),
walk AS (SELECT doc_id, i, w AS used, 0 AS chunk_no, CASE WHEN h THEN s END AS head FROM parts WHERE i = 1
  UNION ALL SELECT p.doc_id, p.i, CASE WHEN p.h OR used + p.w > {BUDGET} THEN p.w ELSE used + p.w END,
    chunk_no + CASE WHEN p.h OR used + p.w > {BUDGET} THEN 1 ELSE 0 END, CASE WHEN p.h THEN p.s ELSE head END
  FROM walk JOIN parts p ON p.doc_id = walk.doc_id AND p.i = walk.i + 1),
chunks AS (SELECT doc_id, chunk_no, first(head ORDER BY i) AS section, sum(w) AS n_tokens, string_agg(p, chr(10) ORDER BY i) AS raw_text
  FROM walk JOIN parts USING (doc_id, i) GROUP BY doc_id, chunk_no)"""


def _short_line(line):
    from capledger.functions.columns import strip

    return F.size(F.split(strip(line), r"\s+")) <= 3


@query("chunk_documents", f"{_WALK_SQL} SELECT doc_id, chunk_no, section, CAST(n_tokens AS BIGINT) AS n_tokens, sha256(raw_text) AS raw_text FROM chunks")
def chunk_documents(spark, folder):
    out = layout.chunk_documents(table(spark, folder, "documents"), "doc_id", "text", BUDGET, _short_line)
    return out.select("doc_id", "chunk_no", "section", F.col("n_tokens").cast("long").alias("n_tokens"), F.sha2("raw_text", 256).alias("raw_text"))


@query("document_ingest", f"""{_WALK_SQL} SELECT sha256(doc_id || '|1') AS rag_id, CAST(chunk_no AS BIGINT) AS chunk_id, sha256(raw_text) AS raw_text,
CAST(length('{plans.DOCUMENT_PREFIX}' || CASE WHEN section IS NULL OR starts_with(trim(raw_text, ' ' || chr(9) || chr(10) || chr(13)), section) THEN raw_text
  ELSE section || chr(10) || raw_text END) AS DOUBLE) AS embedding, 0 AS added_again FROM chunks""")
def document_ingest(spark, folder):
    """Two deliveries of all documents, the first with every document twice, the second unchanged."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("document_key"), "text")
    held = spark.createDataFrame([], "rag_id string, document_key string, document_hash string, embed_model string, version_id int, active_flag boolean")
    root = scratch_path(spark, "ingest")

    def embed(chunks):
        return chunks.select("doc", "chunk_id", F.length("embed_text").cast("double").alias("embedding"))

    held, _ = plans.ingest(held, docs.unionByName(docs), "m", BUDGET, root, _short_line, embed)
    _, counts = plans.ingest(held, docs, "m", BUDGET, root, _short_line, embed)
    chunks, vectors = read_table(spark, f"{root}/document_chunks"), read_table(spark, f"{root}/document_vectors")
    return chunks.join(vectors, ["doc", "chunk_id"]).select(
        F.col("doc").alias("rag_id"), F.col("chunk_id").cast("long").alias("chunk_id"), F.sha2("raw_text", 256).alias("raw_text"), "embedding",
        F.lit(counts["added"]).alias("added_again"))


@query("doc_tables_roundtrip", f"""WITH {_ITEMS_SQL},
kept AS (SELECT doc, table_ref, row FROM cells JOIN tables USING (doc, table_ref) GROUP BY doc, table_ref, row
  HAVING NOT bool_or(row_section) AND bool_or(text <> '') AND NOT (bool_or(skip_first_row) AND row = 0)
    AND (bool_or(is_continuation) OR NOT bool_or(column_header))),
numbered AS (SELECT doc, table_ref, t, row_number() OVER (PARTITION BY doc ORDER BY t <> 'view', ord) - 1 AS chunk_id FROM ctx WHERE t <> 'signup')
SELECT doc, table_ref, chunk_id, count(row) AS n_rows FROM numbered LEFT JOIN kept USING (doc, table_ref) WHERE t <> 'view' GROUP BY ALL""")
def doc_tables_roundtrip(spark, folder):
    """Chunks and table rows of all documents, written and read back."""
    items = _event_items(spark, folder).drop("event_type", "value", "k")
    prose = items.where("kind = 'text'").select(
        "doc", "ord", F.col("page").alias("page_number"), F.lit("text").alias("block_type"), F.col("text").alias("raw_text"), F.col("text").alias("full_text"))
    chunks, rows = plans.ingest_layout(prose, items, _event_cells(spark, folder), layout.block_of(F.col("ord"), SPAN))
    root = scratch_path(spark, "docs")
    plans.store(chunks, rows, root)
    counted = read_table(spark, f"{root}/document_tables").groupBy("doc", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    stored = read_table(spark, f"{root}/document_chunks").where("block_type = 'table'")
    return stored.join(counted, ["doc", "chunk_id"], "left").select("doc", "table_ref", "chunk_id", F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("layout_ingest", f"""WITH {_ITEMS_SQL},
kept AS (SELECT doc, table_ref, row FROM cells JOIN tables USING (doc, table_ref) GROUP BY doc, table_ref, row
  HAVING NOT bool_or(row_section) AND bool_or(text <> '') AND NOT (bool_or(skip_first_row) AND row = 0)
    AND (bool_or(is_continuation) OR NOT bool_or(column_header))),
counted AS (SELECT doc, table_ref, count(*) AS n FROM kept GROUP BY doc, table_ref),
prose AS (SELECT doc, ord // 500 AS ord, min(page) AS page_number, string_agg(t || ' ' || k, chr(10) ORDER BY ord) AS raw_text FROM it WHERE t = 'view' GROUP BY ALL),
both_kinds AS (
  SELECT doc, 0 AS late, ord, 'text' AS block_type, page_number, 'Part ' || ord || ' > Page' AS section_path, raw_text, 0 AS n_rows FROM prose
  UNION ALL SELECT doc, 1, ord, 'table', page, section, concat_ws(chr(10), section, intro, CASE WHEN k < 20 THEN 'Table ' || k END,
    nullif(array_to_string(list_filter(headers, lambda h: h <> ''), ' | '), '')), coalesce(n, 0) FROM tables LEFT JOIN counted USING (doc, table_ref))
SELECT doc AS document_key, CASE WHEN doc % 3 = 0 THEN 2 ELSE 1 END AS version_id, row_number() OVER (PARTITION BY doc ORDER BY late, ord) - 1 AS chunk_id, block_type,
  CAST(page_number AS INT) AS page_number, section_path, sha256(raw_text) AS raw_text,
  CAST(length('{plans.DOCUMENT_PREFIX}' || CASE WHEN late = 0 THEN section_path || chr(10) ELSE '' END || raw_text) AS DOUBLE) AS embedding, n_rows FROM both_kinds""")
def layout_ingest(spark, folder):
    """Three deliveries of documents with prose and tables: all; a third of them changed; the same again."""
    key = F.col("user_id").cast("string")
    items = _event_items(spark, folder).drop("event_type", "value", "k")
    chunk = F.when(F.col("kind") == layout.TEXT, F.floor(F.col("ord") / 500))
    items = items.withColumns({
        "chunk_id": chunk, "label": F.lit("text"),
        "headings": F.when(chunk.isNotNull(), F.array(F.concat(F.lit("Part "), chunk.cast("string")), F.lit("Page"))), "doc": F.col("doc").cast("string")})
    cells = _event_cells(spark, folder).withColumn("doc", F.col("doc").cast("string"))
    users = table(spark, folder, "events").select(key.alias("document_key"), "user_id").distinct()
    first = users.select("document_key", F.concat(F.lit("as of spring "), "document_key").alias("text"))
    second = users.select("document_key", F.concat(F.when(F.col("user_id") % 3 == 0, "as of autumn ").otherwise("as of spring "), "document_key").alias("text"))
    held = spark.createDataFrame([], "rag_id string, document_key string, document_hash string, embed_model string, version_id int, active_flag boolean")
    root = scratch_path(spark, "layout-ingest")

    def embed(chunks):
        return chunks.select("doc", "chunk_id", F.length("embed_text").cast("double").alias("embedding"))

    for delivery in (first, second, second):
        held, _ = plans.ingest_parsed(held, delivery, items, cells, "m", root, embed, block=layout.block_of(F.col("ord"), SPAN))
    chunks, rows, vectors = (read_table(spark, f"{root}/document_{n}") for n in ("chunks", "tables", "vectors"))
    counted = rows.groupBy("doc", "chunk_id").agg(F.count(F.lit(1)).alias("n_rows"))
    active = held.where("active_flag").select(F.col("rag_id").alias("doc"), "document_key", "version_id")
    return chunks.join(vectors, ["doc", "chunk_id"]).join(counted, ["doc", "chunk_id"], "left").join(active, "doc").select(
        F.col("document_key").cast("long").alias("document_key"), "version_id", F.col("chunk_id").cast("long").alias("chunk_id"), "block_type", "page_number", "section_path",
        F.sha2("raw_text", 256).alias("raw_text"), "embedding", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def label_centres(spark, folder):
    """The mean vector of each label, as a query."""
    parts = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("query_vector"))


CENTRES_SQL = """SELECT label AS query_id, list(x ORDER BY i) AS query_vector FROM (SELECT label, i, avg(x) AS x FROM (
SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, i) GROUP BY label"""


@query("cosine_topk", f"""SELECT label, query_id, rank, vec_id, round(similarity, 6) AS similarity FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY label, query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM (
  SELECT label, query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), query_vector) AS similarity
  FROM embeddings, ({CENTRES_SQL}))) WHERE rank <= 15""")
def topk(spark, folder):
    near = cosine_topk(table(spark, folder, "embeddings"), label_centres(spark, folder), 15, "vec_id", "embedding", scope=["label"])
    return near.withColumn("similarity", F.round("similarity", 6))


@query("topk_all", """SELECT query_id, rank, vec_id, round(similarity, 6) AS similarity FROM (
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INT) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS similarity
  FROM embeddings v, embeddings q WHERE len(v.embedding) = len(q.embedding))) WHERE rank <= 10""")
def topk_all(spark, folder):
    """Every vector as a query."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    near = cosine_topk_all(vectors, vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 10, "vec_id", "embedding")
    return near.withColumn("similarity", F.round("similarity", 6))


@query("normalize_vectors", """SELECT vec_id, i, round(x * (label + 2) / sqrt(sum(x * x * (label + 2) * (label + 2)) OVER (PARTITION BY vec_id)), 6) AS x FROM (
SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""")
def unit_vectors(spark, folder):
    stretched = table(spark, folder, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("label") + 2)).alias("embedding"))
    return normalize_vectors(stretched, "embedding").select("vec_id", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", F.col("i").cast("long").alias("i"), (F.round("x", 6) + 0.0).alias("x"))

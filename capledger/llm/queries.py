"""The operators of this subpackage as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.llm.decontaminate import contaminations
from capledger.llm.fingerprints import edit_report
from capledger.llm.html_text import extract_texts, fit_weights
from capledger.llm.language_crf import languages_of
from capledger.llm.mixing import BITS, BLOCK_TOKENS, MOST_BLOCKS, mix_sources
from capledger.llm.order_minhash import near_duplicate_classes
from capledger.llm.spelling import EDIT_EVERY, FORM_FACTOR, LEAST_COUNT, LEAST_LENGTH, spelling_variants
from capledger.llm.spherical import COSINE, embedding_duplicates
from capledger.llm.surrogates import replace_entities
from capledger.llm.token_counts import token_length_report
from capledger.llm.toxicity import toxicity_scores
from capledger.llm.warc import LEAST_REVISIT, read_archives, resolved, write_archives
from capledger.llm.whitening import whitened_embeddings
from capledger.sources.scratch import scratch_path

#: A deployment passes a secret of its own.
SURROGATE_KEY = "surrogates of the test tables"
MOST_REPETITIONS = 1.25

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_order_minhash")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    classes = near_duplicate_classes(table(spark, folder, "documents"))
    kept = F.col("id").eqNullSafe(F.col("class_id"))
    return classes.select(F.col("id").alias("doc_id"), "class_id", "n_texts", "n_rows", kept.alias("kept"))


@query("op2_language_crf")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return languages_of(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


OP3_SQL = f"""SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to, CAST(NULL AS VARCHAR) AS fault
FROM (SELECT *, octet_length(encode(payload)) >= {LEAST_REVISIT} AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again
  FROM (SELECT page_id, coalesce(html, '') AS payload, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages))"""


@query("op3_warc_segments", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_archives(table(spark, folder, "pages"), path)
    return resolved(read_archives(spark, path)).withColumnRenamed("row_id", "page_id")


@query("op4_counterfactual_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels")).withColumnRenamed("id", "doc_id")


@query("op5_surrogates")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    replaced = replace_entities(table(spark, folder, "documents"), SURROGATE_KEY, count_col="n_entities")
    return replaced.select("doc_id", "text", "n_entities")


OP6_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
usable AS (SELECT * FROM v WHERE x IS NOT NULL AND label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  AND list_cosine_similarity(a.x, b.x) >= {COSINE}),
reached(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON l.a = r.other)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.vec_id) AS n_links, min(other) AS component_id, v.vec_id = min(other) AS kept
FROM v JOIN reached r ON r.vec_id = v.vec_id GROUP BY v.vec_id"""


@query("op6_spherical_cells", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_duplicates(table(spark, folder, "embeddings"))


_REPEATS = "total * list_max(list_transform(t, lambda x: exp({a} * ln(x / peak)) / x)) / list_sum(list_transform(t, lambda x: exp({a} * ln(x / peak))))"
_NEXT = "(low + pow(0.5, i + 1))"
OP7_SQL = f"""WITH RECURSIVE r AS (SELECT doc_id, source, coalesce('=' || source, '~') AS key, coalesce(CAST(doc_id AS VARCHAR), '') AS id,
  CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\r\\n]+')), 0) AS BIGINT) AS n FROM documents),
s AS (SELECT key, CAST(sum(n) AS BIGINT) AS tokens FROM r GROUP BY key HAVING sum(n) > 0),
l AS (SELECT list(CAST(tokens AS DOUBLE) ORDER BY key) AS t, CAST(sum(tokens) AS DOUBLE) AS total, CAST(max(tokens) AS DOUBLE) AS peak FROM s),
bisected(i, low) AS (SELECT 0, CAST(0 AS DOUBLE) UNION ALL
  SELECT i + 1, CASE WHEN {_REPEATS.format(a=_NEXT)} > {MOST_REPETITIONS} THEN {_NEXT} ELSE low END FROM bisected, l WHERE i < {BITS}),
e AS (SELECT CASE WHEN {_REPEATS.format(a="1.0")} > {MOST_REPETITIONS} THEN 1.0 WHEN {_REPEATS.format(a="0.0")} <= {MOST_REPETITIONS} THEN 0.0
  ELSE low + pow(0.5, {BITS}) END AS a, total FROM bisected, l WHERE i = {BITS}),
w AS (SELECT key, tokens, exp(a * ln(CAST(tokens AS DOUBLE) / total)) AS power, total FROM s, e),
p AS (SELECT *, own // tokens AS epochs, own % tokens AS rest FROM (SELECT key, tokens, CAST(floor(power / (SELECT sum(power) FROM w) * total) AS BIGINT) AS own,
  least({MOST_BLOCKS}, CAST(ceil(tokens / {BLOCK_TOKENS}) AS BIGINT)) AS blocks FROM w)),
partial AS (SELECT DISTINCT key, id FROM (SELECT key, id, rest, sum(n) OVER (PARTITION BY key ORDER BY o RANGE UNBOUNDED PRECEDING) AS so_far
  FROM (SELECT r.key, id, n, rest, md5('mix|' || epochs || '|' || r.key || '|' || id) AS o FROM r JOIN p USING (key))) WHERE so_far <= rest AND rest > 0),
copies AS (SELECT r.*, p.*, unnest(range(epochs + CASE WHEN q.id IS NULL THEN 0 ELSE 1 END)) AS epoch
  FROM r JOIN p ON p.key = r.key LEFT JOIN partial q ON q.key = r.key AND q.id = r.id),
placed AS (SELECT *, CAST(floor(CAST('0x' || left(md5('mix|' || epoch || '|' || key || '|' || id), 8) AS BIGINT) * blocks / pow(2, 32)) AS BIGINT) AS block FROM copies)
SELECT doc_id, source, n AS n_tokens, CAST(epoch AS INT) AS epoch, block, least((epoch * blocks + block + 0.5::DOUBLE) / (blocks * own / tokens + 1), 1.0::DOUBLE) AS slot FROM placed"""


@query("op7_temperature_mixing", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(table(spark, folder, "documents"), repetitions=MOST_REPETITIONS)
    return mixed.select("doc_id", "source", *[F.col(f"mix_{c}").alias(c) for c in ("n_tokens", "epoch", "block", "slot")])


@query("op8_cgk_decontamination")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return contaminations(table(spark, folder, "documents"), table(spark, folder, "benchmark")).withColumnRenamed("id", "doc_id")


@query("op9_length_histogram")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return token_length_report(table(spark, folder, "documents"))


@query("op10_main_text")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract_texts(pages, fit_weights(pages))


# The crc32 of each pair of document and run goes byte by byte through its table of 256 numbers.
OP11_SQL = f"""WITH RECURSIVE bits(k, i, c) AS (SELECT k, 0, k FROM range(256) t(k) UNION ALL
  SELECT k, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE i < 8),
crc AS (SELECT k, c AS v FROM bits WHERE i = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT row_number() OVER () AS p, id, run, count(*) AS n FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY id, run),
coded AS (SELECT p, hex(encode(id || ':' || run)) AS bytes FROM counted),
walk(p, i, c, bytes) AS (SELECT p, 0, 4294967295, bytes FROM coded UNION ALL
  SELECT p, i + 1, xor(c >> 8, v), bytes FROM walk JOIN crc ON k = xor(c & 255, CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)) WHERE 2 * i < length(bytes)),
hashed AS (SELECT p, xor(c, 4294967295) AS h FROM walk WHERE 2 * i = length(bytes)),
edited AS (SELECT CASE WHEN h % {EDIT_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM counted JOIN hashed USING (p)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) t(i)),
near AS (SELECT c.word, w.word AS other FROM cut c JOIN words w ON w.word = c.rest UNION SELECT w.word, c.word FROM cut c JOIN words w ON w.word = c.rest
  UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, struct_pack(m := -o.n, w := other)) AS form, max(o.n) AS form_n FROM near JOIN words o ON o.word = near.other GROUP BY near.word),
forms AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {FORM_FACTOR} * n THEN form END AS form, CASE WHEN form_n >= {FORM_FACTOR} * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
path(word, p, further) AS (SELECT word, word, form FROM forms UNION ALL SELECT x.word, f.word, f.form FROM path x JOIN forms f ON f.word = x.further)
SELECT word, form, p AS root, n, n_near, form_n FROM path JOIN forms USING (word) WHERE further IS NULL"""


@query("op11_trie_frontier", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


@query("op12_minhash_fingerprints")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return edit_report(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op13_incremental_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whitened_embeddings(table(spark, folder, "embeddings")).withColumnRenamed("id", "vec_id")

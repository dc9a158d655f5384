"""Chunks to facts: search, ask, read the answers, check them, add what is new."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.functions.vocabulary import FACT_KINDS, FIELD_NOTES, FactKind
from capledger.operators import answers as A
from capledger.operators import records as R
from capledger.operators.bounded import fits
from capledger.operators.layout import first_k_text
from capledger.operators.vectors import cosine_topk
from capledger.sources.scratch import stored

TOP_K = 15

MATCH_QUESTION = """Does this table state the fact {concept}, that is {about}?
{candidate}
Columns: {columns}
Answer with JSON: is_match, jurisdiction, label_column, value_column, period_start, period_end, unit."""

PROSE_QUESTION = """List every {concept} stated below, as JSON {"records": [...]}. It is {about}.
Fields:
{fields}
{candidate}"""

JURISDICTION_QUESTION = """Which jurisdiction does this document govern? Answer with JSON: jurisdiction.
{text}"""

MATCH_FIELDS = {
    "jurisdiction": "string", "label_column": "string", "value_column": "string",
    "period_start": "int", "period_end": "int", "unit": "string",
}
_TYPES = {"period_start": "int", "period_end": "int", "exceptions": "array<string>"}


@dataclass
class Extraction:
    """Records of one kind of fact, before and after checking, and the answers without any:
    (concept, rag_id, chunk_id, answer, error) of calls that failed or gave no JSON."""

    records: DataFrame
    accepted: DataFrame
    rejected: DataFrame
    failed: DataFrame


def candidates(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """The ``k`` best chunks per document and query, with their texts."""
    near = stored(cosine_topk(vectors, queries, k, "chunk_id", "embedding", scope=["rag_id"]), "nearest")
    return chunks.join(F.broadcast(near) if fits(near) else near, ["rag_id", "chunk_id"])


def jurisdictions(first_texts: DataFrame, ask: Callable[[dict], object]) -> DataFrame:
    """(rag_id, jurisdiction): asked once per document, from its opening chunks."""
    asked = A.render_questions(
        first_texts.where(F.col("full_text").isNotNull()), JURISDICTION_QUESTION, {"text": F.col("full_text")}
    )
    answers = stored(A.annotate(asked, ask, ["question"], ["rag_id"]), "jurisdictions")
    parsed, _ = A.parse_answers(answers, "answer")
    return parsed.select("rag_id", A.single_value("parsed", "jurisdiction").alias("jurisdiction"))


def ask_tables(found: DataFrame, kind: FactKind, ask: Callable[[dict], object]) -> DataFrame:
    asked = A.render_questions(found, MATCH_QUESTION, {
        "concept": F.lit(kind.name),
        "about": F.lit(kind.about),
        "candidate": A.candidate_block(F.col("chunk_id"), F.col("page_number"), F.col("full_text")),
        "columns": A.headers_line(F.col("column_headers")),
    })
    return A.annotate(asked, ask, ["question"], ["rag_id", "chunk_id"])


def ask_prose(found: DataFrame, kind: FactKind, ask: Callable[[dict], object]) -> DataFrame:
    """Prose candidates of a table fact are asked about one by one; for a prose fact
    all candidates of a document, at most ``k``, go into one question in rank order."""
    fields = A.field_lines([
        (f, "number" if f == kind.number else _TYPES.get(f, "string"), f in kind.required or f == kind.number,
         kind.allowed if f == kind.label else ())
        for f in kind.fields
    ], FIELD_NOTES)
    block = A.candidate_block(F.col("chunk_id"), F.col("page_number"), F.col("raw_text"))
    if kind.from_tables:
        blocks = found.select("rag_id", block.alias("candidate"))
    else:
        blocks = found.groupBy("rag_id").agg(
            F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs")
        ).select("rag_id", F.array_join(F.transform("bs", lambda x: x["b"]), "\n---\n").alias("candidate"))
    asked = A.render_questions(blocks, PROSE_QUESTION, {
        "concept": F.lit(kind.name), "about": F.lit(kind.about), "fields": F.lit(fields), "candidate": F.col("candidate"),
    })
    return A.annotate(asked, ask, ["question"], ["rag_id"])


def table_records(answered: DataFrame, rows: DataFrame, kind: FactKind) -> DataFrame:
    """Records of matched tables, read from the stored rows by the columns the answer names."""
    parsed, _ = A.parse_answers(answered, "answer")
    matches = A.keep_matches(parsed, "parsed").select("rag_id", "chunk_id", *[
        F.try_variant_get("parsed", f"$.{n}", t).alias(n) for n, t in MATCH_FIELDS.items()
    ])
    stored = rows.select("rag_id", "chunk_id", "row", "cells")
    return R.rows_by_column(matches, stored, ["rag_id", "chunk_id"], kind.label, kind.number).drop("row")


def prose_records(answered: DataFrame, kind: FactKind) -> DataFrame:
    parsed, _ = A.parse_answers(answered, "answer")
    fields = {"chunk_id": "int", **{f: _TYPES.get(f, "string") for f in kind.fields}}
    return A.explode_records(parsed, "parsed", fields, ["rag_id"])


def extract(
    found: DataFrame, rows: DataFrame, kind: FactKind, ask: Callable[[dict], object], known: DataFrame,
) -> Extraction:
    """All records of one kind of fact: tables by their columns, other chunks by their text.

    Candidates and answers are stored, so that no chunk is searched for twice and no
    question asked twice, whatever is done with the records.
    """
    found = stored(found, "candidates")
    tables, prose = A.route_by_kind(found) if kind.from_tables else (None, found)
    told = stored(ask_prose(prose, kind, ask), "prose-answers")
    records, failed = prose_records(told, kind), failures(told, kind)
    if tables is not None:
        told = stored(ask_tables(tables, kind, ask), "table-answers")
        records = R.union_records(table_records(told, rows, kind), records)
        failed = failures(told, kind).unionByName(failed)
    records = R.stamp_from_parent(records, known, "rag_id", "jurisdiction").withColumn("concept", F.lit(kind.name))
    accepted, rejected = R.validate(records, R.Rules.of(kind))
    return Extraction(records, accepted, rejected, failed)


def failures(answered: DataFrame, kind: FactKind) -> DataFrame:
    """Answers that hold no JSON, and calls that raised."""
    _, broken = A.parse_answers(answered, "answer")
    chunk = F.col("chunk_id").cast("long") if "chunk_id" in broken.columns else F.lit(None).cast("long")
    return broken.select(F.lit(kind.name).alias("concept"), "rag_id", chunk.alias("chunk_id"), "answer", "error")


def new_facts(stored: DataFrame, accepted: DataFrame, kind: FactKind) -> DataFrame:
    return R.insert_new(stored, accepted, list(kind.key), ["chunk_id", kind.label, kind.number])


def add_facts(path: str, accepted: DataFrame, kind: FactKind) -> DataFrame:
    """The new ones of the accepted facts, appended to the table of their kind at ``path``, of
    which only the buckets that hold keys of the batch are read."""
    return R.add_new(accepted.sparkSession, path, accepted, list(kind.key), ["chunk_id", kind.label, kind.number])


def load_facts(
    chunks: DataFrame, vectors: DataFrame, rows: DataFrame, queries: DataFrame, targets: Mapping[str, DataFrame],
    ask: Callable[[dict], object], kinds: Mapping[str, FactKind] = FACT_KINDS, opening: int = 3, k: int = TOP_K,
) -> tuple[dict[str, DataFrame], DataFrame, DataFrame, DataFrame]:
    """All kinds of facts of some documents: (new facts by kind, counts, rejected, failed).

    ``queries`` has (query_id, query_vector) with the kind's name as id, ``targets`` the facts
    that are there. One search serves all kinds; jurisdictions are asked for once per
    document. ``counts`` is (concept, extracted, skipped); ``rejected`` names the failing
    fields, ``failed`` the calls and answers that gave nothing.
    """
    known = stored(jurisdictions(first_k_text(chunks, "rag_id", opening), ask), "known")
    found = stored(candidates(chunks, vectors, queries, k), "found")
    fresh, counts, rejected, failed = {}, [], [], []
    for name, kind in kinds.items():
        got = extract(found.where(F.col("query_id") == name).drop("query_id"), rows, kind, ask, known)
        records = stored(got.records, "records")
        ok, bad = R.validate(records, R.Rules.of(kind))
        fresh[name] = stored(new_facts(targets[name], ok, kind), "new-facts")
        counts.append(R.extraction_counts(records, bad))
        rejected.append(bad.select("concept", "rag_id", F.col("chunk_id").cast("long").alias("chunk_id"), "failing", "reason"))
        failed.append(got.failed)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return fresh, union(counts), union(rejected), union(failed)

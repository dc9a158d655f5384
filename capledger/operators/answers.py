"""Questions about chunks, and the answers that come back as loosely formatted JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capledger.functions.columns import computed_once

FENCE = "```"


def _fenced(text: Column) -> Column:
    """What stands between the first two fences, without the name of a language."""
    pieces = F.split(text, FENCE)
    return F.when(F.size(pieces) > 2, F.regexp_replace(F.get(pieces, F.lit(1)), r"^[\w+-]*(?=\s)", ""))


def _spanned(text: Column, first: str, last: str) -> Column:
    """From the first ``first`` to the last ``last``."""
    begin, behind = F.instr(text, first), F.instr(F.reverse(text), last)
    return F.when((begin > 0) & (behind > 0), F.substring(text, begin, F.length(text) - behind - begin + 2))


def parse_json(text: Column) -> Column:
    """The first reading of ``text`` that is JSON, as a variant: all of it, a fenced
    block, the widest ``{…}``, the widest ``[…]``. NULL when none is."""
    readings = [text, _fenced(text), _spanned(text, "{", "}"), _spanned(text, "[", "]")]
    return F.coalesce(*[F.try_parse_json(F.trim(r)) for r in readings])


def parse_answers(df: DataFrame, column: str, out: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """(parsed, unparsable): an answer that holds no JSON is set aside, not an error."""
    read = computed_once(df, {out: parse_json(F.col(column))})
    return read.where(F.col(out).isNotNull()), read.where(F.col(out).isNull()).drop(out)


def explode_records(df: DataFrame, parsed: str, fields: Mapping[str, str], keep: list[str]) -> DataFrame:
    """One typed row per entry of ``records``; answers without that list give none.

    Fields are read one by one, so a value of the wrong type only makes itself NULL.
    """
    each = df.select(*keep, F.explode(F.try_variant_get(parsed, "$.records", "array<variant>")).alias("__r"))
    return each.select(*keep, *[
        F.try_variant_get("__r", f"$.{name}", kind).alias(name) for name, kind in fields.items()
    ])


def single_value(parsed: str, name: str) -> Column:
    """A trimmed, non-blank text field of an answer, else NULL (numbers do not count)."""
    path = f"$.{name}"
    is_text = F.schema_of_variant(F.try_variant_get(parsed, path, "variant")) == "STRING"
    return F.when(is_text, F.nullif(F.trim(F.try_variant_get(parsed, path, "string")), F.lit("")))


def keep_matches(df: DataFrame, parsed: str) -> DataFrame:
    """Answers that say the candidate is a match."""
    return df.where(F.coalesce(F.try_variant_get(parsed, "$.is_match", "boolean"), F.lit(False)))


def route_by_kind(candidates: DataFrame, kind: str = "block_type") -> tuple[DataFrame, DataFrame]:
    """(tables, prose): candidates of unknown kind are read as prose."""
    is_table = F.coalesce(F.col(kind) == "table", F.lit(False))
    return candidates.where(is_table), candidates.where(~is_table)


def headers_line(headers: Column) -> Column:
    """``Type; Value``, or a note that the columns have no names."""
    named = F.filter(headers, lambda h: h != "")
    return F.when(F.size(named) > 0, F.array_join(named, "; ")).otherwise("(without names)")


def candidate_block(chunk_id: Column, page: Column, text: Column) -> Column:
    """A chunk between marks that name it, and its page where that is known."""
    place = F.concat(F.lit("<chunk id="), chunk_id.cast("string"), F.coalesce(F.concat(F.lit(" page="), page.cast("string")), F.lit("")), F.lit(">"))
    return F.concat_ws("\n", place, text, F.lit("</chunk>"))


def field_lines(fields: list[tuple[str, str, bool, tuple[str, ...]]], notes: Mapping[str, str] | None = None) -> str:
    """``(name, type, required, allowed)`` as numbered lines, each with its note."""
    lines = []
    for i, (name, kind, required, allowed) in enumerate(fields, 1):
        line = f"{i}. {name}: {kind}, {'always' if required else 'if stated'}"
        if allowed:
            line += "; one of " + " | ".join(allowed)
        if note := (notes or {}).get(name):
            line += f". {note}"
        lines.append(line)
    return "\n".join(lines)


def render_questions(df: DataFrame, template: str, values: Mapping[str, Column], out: str = "question") -> DataFrame:
    """Fills ``{name}`` marks of a template from each row: one question per row."""
    pieces, rest = [], template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not spots:
            pieces.append(F.lit(rest))
            break
        at, name = min(spots)
        pieces += [F.lit(rest[:at]), F.coalesce(values[name].cast("string"), F.lit("None"))]
        rest = rest[at + len(name) + 2:]
    return df.withColumn(out, F.concat(*pieces))


def annotate(
    df: DataFrame, fn: Callable[[dict], object], inputs: list[str], keep: list[str], out: str = "answer",
) -> DataFrame:
    """Calls ``fn`` once per row with its ``inputs`` and adds the text it returns.

    A call that raises gives a NULL answer and its message in ``error``; the other
    rows go on. ``fn`` sees the values as they are, NULL as None; kept columns are passed
    through. Retries are up to ``fn``. Store the result before using it more than
    once: every use of the DataFrame asks again.
    """
    types = {f.name: f for f in df.schema.fields}
    schema = T.StructType([
        *[types[c] for c in keep], T.StructField(out, T.StringType()), T.StructField("error", T.StringType()),
    ])
    read = list(dict.fromkeys([*keep, *inputs]))

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for row in batch.select(inputs).to_pylist():
                try:
                    answer = fn(row)
                    answers.append(None if answer is None else str(answer))
                    errors.append(None)
                except Exception as e:
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            columns = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], names=[*keep, out, "error"])

    return df.select(*read).mapInArrow(call, schema)

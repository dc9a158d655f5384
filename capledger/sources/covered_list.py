"""The published list of covered buildings, as text lines of a fixed layout."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.functions.columns import computed_once
from capledger.operators.ordered import first_per_key
from capledger.sources.tables import write_table

# The fields of the list, in the order of a line.
LINE_FIELDS = (
    "bbl", "requires_water_data", "borough", "block", "lot", "easement", "building_class", "tax_class",
    "building_count", "dof_square_footage", "street_number", "street_name", "zip_code", "multi_building_lot_flag",
)
LINE_START = "^[0-9]{10} "
GAP = " {2,}"  # columns are at least two blanks apart
#: Shapes of single cells, and of cells that begin or end with one.
DIGITS, LETTERS_2, TAX, AREA, ZIP = "^[0-9]+$", "^[A-Z0-9]{2}$", "^[0-9][A-Z]?$", "^[0-9,]+$", "^[0-9]{1,5}(-[0-9]{4})?$"
AREA_FIRST, ZIP_LAST = "^[0-9,]+( |$)", "(^| )[0-9]{1,5}(-[0-9]{4})?$"


def read_fields(lines: DataFrame, line: str) -> DataFrame:
    """Adds the fields of a line by their place, and ``fits``: whether all have their shape.

    Five cells lead; an easement may stand before the building class; after the area come
    the words of the address, whose first is a street number if others follow, the zip code,
    and in a cell of its own an optional flag. A line has an easement if the four cells behind it are shaped like
    class, tax class, count and area: of ``E  A1  2B  7  1,000  12 MAIN ST`` the easement is E, but
    ``A1  2B  7  1,000  12 MAIN ST`` fits that shape as well, with easement A1, class 2B and area 12.

    Cells, the place of the class, words and fields are read one after the other, each once per line.
    """
    shaped = lambda c, shape: c.rlike(shape)
    cell = lambda i: F.coalesce(F.get("__cells", F.lit(i) if isinstance(i, int) else i), F.lit(""))
    read = computed_once(lines, {"__cells": F.split(line, GAP)})
    has_easement = shaped(cell(6), LETTERS_2) & shaped(cell(7), TAX) & shaped(cell(8), DIGITS) & shaped(cell(9), AREA_FIRST)
    read = computed_once(read, {"__at": F.when(has_easement, 6).otherwise(5), "__count": F.size("__cells")})
    at, count = F.col("__at"), F.col("__count")
    address = F.array_join(F.slice("__cells", at + 4, F.greatest(count - at - 3, F.lit(0))), " ")
    flagged = ~cell(count - 1).contains(" ") & shaped(cell(count - 2), ZIP_LAST) & (count - 2 > at + 3)
    read = computed_once(read, {"__words": F.split(address, " +"), "__flagged": flagged})
    words, last = F.col("__words"), F.size("__words") - F.col("__flagged").cast("int")
    street = F.filter(F.slice(words, F.lit(2), F.greatest(last - 2, F.lit(0))), lambda w: w != "")
    read = computed_once(read, {"__street": street, "__zip": F.coalesce(F.get(words, last - 1), F.lit(""))})
    street, numbered = F.col("__street"), F.size("__street") > 1
    fits = [
        shaped(cell(0), "^[0-9]{10}$"), cell(1).isin("Yes", "No"), shaped(cell(2), "^[0-9]$"), shaped(cell(3), DIGITS), shaped(cell(4), DIGITS),
        shaped(cell(at), LETTERS_2), shaped(cell(at + 1), TAX), shaped(cell(at + 2), DIGITS), shaped(words[0], AREA), F.size(street) > 0, shaped(F.col("__zip"), ZIP),
    ]
    parts = [
        cell(0), cell(1), cell(2), cell(3), cell(4), F.when(at == 6, cell(5)), cell(at), cell(at + 1), cell(at + 2), words[0],
        F.when(numbered, street[0]), F.array_join(F.when(numbered, F.slice(street, 2, F.size(street))).otherwise(street), " "),
        F.col("__zip"), F.when(F.col("__flagged"), cell(count - 1)),
    ]
    fields = {**dict(zip(LINE_FIELDS, parts, strict=True)), "fits": reduce(and_, fits)}
    return computed_once(read, fields).drop("__cells", "__at", "__count", "__words", "__flagged", "__street", "__zip")


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text): the lines of text files in their order. Numbers rise within a
    file and are not consecutive."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("text"))


def parse_layout_lines(lines: DataFrame, text: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, unmatched): parsed lines, and lines that begin like one and do not fit.

    Other lines (headers, footers, notes) are ignored.
    """
    begun = lines.select(*keep, F.trim(F.col(text)).alias("line")).where(F.col("line").rlike(LINE_START))
    read = read_fields(begun, "line")
    return read.where("fits").select(*keep, *LINE_FIELDS), read.where("NOT fits").select(*keep, "line")


def reload_covered_list(spark: SparkSession, text_path: str, table_path: str, source_file: str) -> dict:
    """Replaces the table of covered buildings by what the text files list; the first line of a
    lot wins. Returns how many lots there are and how many lines did not fit."""
    rows, unmatched = parse_layout_lines(scan_lines(spark, text_path), "text", keep=("file", "line_no"))
    write_table(covered_buildings(rows, ["file", "line_no"], source_file).drop("file", "line_no"), table_path)
    return {"lots": spark.read.parquet(table_path).count(), "unmatched": unmatched.count()}


def covered_buildings(rows: DataFrame, order: list[str], source_file: str) -> DataFrame:
    """Typed list rows, one per lot; the first in ``order`` wins."""
    typed = rows.withColumns({
        "building_count": F.col("building_count").try_cast("int"),
        "dof_square_footage": F.replace("dof_square_footage", F.lit(","), F.lit("")).try_cast("decimal(18,2)"),
        "requires_water_data": F.col("requires_water_data") == "Yes",
        "source_file": F.lit(source_file),
    })
    return first_per_key(typed, ["bbl"], [F.col(c).asc_nulls_last() for c in order])

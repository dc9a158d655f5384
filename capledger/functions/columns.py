"""Column expressions shared by the operators. All of them stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exact arithmetic: rates keep the 18 places in which facts are stored; products, sums and
# differences are kept at 12 places, and doubles appear only in the final output. What
# does not fit into these types fails the job.
QUANTITY = "decimal(27,8)"
RATE = "decimal(24,18)"
AMOUNT = "decimal(38,12)"

# What counts as one number in a header cell.
NUMBER_TEXT = (
    r"(?i)^\s*[+-]?("
    r"(\d+(_\d+)*\.?|\d+(_\d+)*\.\d+(_\d+)*|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?"
    r"|inf|infinity|nan)\s*$"
)


def to_number(c: Column) -> Column:
    """Text to double; text that is not one number becomes NULL, and so do NaN and infinities."""
    return finite(c.try_cast("double"))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def quantity(c: Column) -> Column:
    """Double or text to an exact quantity; NULL when it is not a finite number. A number
    beyond 19 digits before the point is an error, never NULL."""
    return finite(c.try_cast("double")).cast(QUANTITY)


def nullif_any(c: Column, values: list[str]) -> Column:
    return F.when(~c.isin(*values), c)


def parse_time(c: Column, fmt: str) -> Column:
    """NULL, not a failed job, on text that does not match ``fmt``."""
    return F.try_to_timestamp(c, F.lit(fmt))


def key_list(c: Column, separator: str = ";", drop: str = "-") -> Column:
    """``1-02235-0029;1-02235-0035`` to ``[1022350029, 1022350035]``."""
    return F.transform(F.split(c, separator), lambda part: F.replace(part, F.lit(drop), F.lit("")))


def first_key(keys: Column) -> Column:
    return F.try_element_at(keys, F.lit(1))


def looks_like_header(cells: Column) -> Column:
    """Some cell is filled and no filled cell is just a number."""
    filled = F.filter(cells, lambda t: t != "")
    return (F.size(filled) > 0) & ~F.exists(filled, lambda t: t.rlike(NUMBER_TEXT))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def times(qty: Column, rate: Column) -> Column:
    """Product of a QUANTITY and a RATE, to 12 places.

    The rate's first 8 and last 10 places are multiplied apart, each within 38 digits.
    """
    head = F.floor(rate * F.lit(10**8)).cast("decimal(14,0)")
    coarse = (head * F.lit(10**-8).cast("decimal(9,8)")).cast("decimal(14,8)")
    fine = (rate - coarse).cast("decimal(18,18)")
    return ((qty * coarse).cast(AMOUNT) + (qty * fine).cast(AMOUNT)).cast(AMOUNT)


def sum_amounts(amounts: list[Column]) -> Column:
    """Sum of AMOUNT columns where NULL adds nothing; 0 for none."""
    total = F.lit(0).cast(AMOUNT)
    for a in amounts:
        total = (total + F.coalesce(a, F.lit(0).cast(AMOUNT))).cast(AMOUNT)
    return total


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\x0b\x0c"))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds costly columns behind a generator, so that filters and later columns read
    them instead of evaluating them again."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))

"""Lookups whose small side is measured first, with a salted shuffle beyond the bound."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MAX_ROWS = 100_000
MAX_BYTES = 64 * 1024 * 1024
MAX_LITERAL_ROWS = 1_000
SALTS = 32
HOT_SHARE, HOT_ROWS = 10_000, 10_000  # a hot key has 1/10,000 of all rows, and 10,000 rows at least
_SALT = "__salt"


def fits(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether the whole of ``df`` is small enough to send to every executor.

    One pass over ``df``, reduced to a count and a size in each task.
    """
    size = F.octet_length(F.to_json(F.struct(*[f"`{c}`" for c in df.columns])))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).first()
    return row["n"] <= max_rows and (row["size"] or 0) <= max_bytes


def localized(df: DataFrame, max_rows: int = MAX_LITERAL_ROWS) -> DataFrame | None:
    """A copy of ``df`` held in the plan itself, if it has at most ``max_rows`` rows, else None.

    What is built on the copy does not compute ``df`` again.
    """
    rows = few_rows(df, max_rows)
    if rows is None:
        return None
    copy = pa.Table.from_pylist([r.asDict() for r in rows], to_arrow_schema(df.schema))
    return df.sparkSession.createDataFrame(copy, df.schema)


def few_rows(df: DataFrame, max_rows: int = MAX_LITERAL_ROWS) -> list[Row] | None:
    """The rows of ``df`` if there are at most ``max_rows``, else None."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype.fields)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def _salt_of(df: DataFrame, salts: int):
    # A hash of the whole row, not rand(): a task that is run again must place its rows alike.
    parts = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.MapType):
            c, kind = F.map_entries(c), T.ArrayType(T.StructType([T.StructField("k", kind.keyType), T.StructField("v", kind.valueType)]))
        if _hashable(kind):
            parts.append(c)
    return F.pmod(F.xxhash64(*parts), F.lit(salts)).cast("int")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi-join that spreads every key of ``big`` over ``salts`` reducers.

    ``small`` is repeated once per salt. With an empty ``on`` each row of ``big``
    meets each row of ``small``. Only joins that keep the left side are exact here.
    """
    _check_kind(how)
    left = big.withColumn(_SALT, _salt_of(big, salts))
    right = small.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, _SALT], how).drop(_SALT)


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", tiny: bool = False) -> DataFrame:
    """Join to a reference table: broadcast when it measures small, else shuffled
    but for the hot keys of ``big``.

    ``tiny`` tells that it most likely has a few hundred rows: these are then
    computed once, and copied into the plan.
    """
    copy = localized(small) if tiny else None
    if copy is not None:
        return big.join(F.broadcast(copy), on, how)
    if fits(small):
        return big.join(F.broadcast(small), on, how)
    return split_join(big, small, on, how)


def hot_keys(df: DataFrame, on: list[str], unless: Column | None = None) -> list[int] | None:
    """Hashes of the keys that hold a large share of ``df``; at most 10,000 by their share.
    None if ``unless`` holds for any row.

    One pass over the key columns with a sketch of fixed size. What a join gives does
    not depend on which keys are found, only how its rows are spread.
    """
    hashed = df.select(F.xxhash64(*on).alias("h"), (F.lit(False) if unless is None else unless).alias("u"))
    row = hashed.agg(F.count(F.lit(1)).alias("n"), F.max("u").alias("u"), F.expr(f"approx_top_k(h, {HOT_SHARE}, {10 * HOT_SHARE})").alias("top")).first()
    if row["u"]:
        return None
    least = max(HOT_ROWS, row["n"] / HOT_SHARE)
    return [t["item"] for t in row["top"] or [] if t["count"] >= least]


def split_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join of two large sides that keeps hot keys of ``big`` out of the shuffle.

    Rows of hot keys stay where they are and meet a broadcast of the few rows of
    ``small`` that have such a key, once those measure small; the others are shuffled.
    Only joins that keep the left side are exact here. ``big`` is read for its keys first.
    """
    _check_kind(how)
    hot = hot_keys(big, on)
    if not hot:
        return big.join(small, on, how)
    # Equal keys of different types have different hashes.
    alike = small.withColumns({c: F.col(c).try_cast(big.schema[c].dataType) for c in on})
    is_hot = F.xxhash64(*on).isin(hot)
    few = alike.where(is_hot)
    if not fits(few):
        return salted_join(big, alike, on, how)
    cold = big.where(~is_hot).join(alike.where(~is_hot), on, how)
    return cold.unionByName(big.where(is_hot).join(F.broadcast(few), on, how))


def _check_kind(how: str) -> None:
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"cannot do a {how} join here")


def many_salts(df: DataFrame) -> int:
    """As many salts as shuffle partitions, for joins that have no key but the salt."""
    return max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def cross_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Every row of ``df`` with every row of ``rows`` (periods, rate lines).

    A handful of rows becomes an array literal that is exploded in place, without
    a shuffle or a join; a longer list is matched over salts.
    """
    local = few_rows(rows)
    if local is None:
        return salted_join(df, rows, [], "inner", many_salts(df))
    return cross_lines(df, [tuple(r) for r in local], rows.schema)


def cross_lines(df: DataFrame, lines: list[tuple], schema: T.StructType) -> DataFrame:
    fields = schema.fields
    if not lines:
        return df.limit(0).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    literals = F.array(*[
        F.struct(*[F.lit(r[i]).cast(f.dataType).alias(f.name) for i, f in enumerate(fields)]) for r in lines
    ])
    return df.select("*", F.inline(literals))

"""Running totals, carry-forward and neighbours inside ordered groups of any size.

A plain window sends a whole group to one task. Here a group with a large share of all
rows is cut into blocks of its order key. Each (group, block) is windowed by itself, one
summary row per block is windowed per group, and the result is carried back into the
blocks, so the largest unit in one task is one block. The other groups, most often all,
take one shuffle and a plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.operators.bounded import hot_keys

DEFAULT_SPAN = 100_000
PUSHED_RANKS = 1_000


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    block: Column | None,
    *,
    totals: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    last_before: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
) -> DataFrame:
    """Add columns computed along ``order`` within ``keys``.

    ``block`` must never fall while ``order`` rises; ``order`` must be total
    within ``keys``, and both free of NULLs. The keys of ``df`` are read once before, to find
    the large groups. Without a ``block`` every group goes to one task: for groups that came from one row.

    totals       running sum up to and including the row
    last         latest non-NULL value up to and including the row
    last_before  latest non-NULL value strictly before the row
    previous     value of the row before, NULL on the first
    following    value of the row after, NULL on the last
    """
    wanted = (totals or {}, last or {}, last_before or {}, previous or {}, following or {})
    if block is None:
        return _scan_groups(df, keys, order, [], *wanted)
    by_block = _scan_blocks(df, keys, order, block, *wanted)
    hot = hot_keys(df, keys, unless=block.isNull())
    if hot is None:
        return by_block
    # Rows with a NULL key have nothing carried from block to block.
    apart = F.when(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]), block)
    rest = df.where(~F.xxhash64(*keys).isin(hot)) if hot else df
    out = _scan_groups(rest, keys, order, [apart], *wanted)
    out = out.withColumns({n: F.col(n).cast(by_block.schema[n].dataType) for n in wanted[0]}) if wanted[0] else out
    return out.unionByName(_scan_blocks(df.where(F.xxhash64(*keys).isin(hot)), keys, order, block, *wanted)) if hot else out


def _scan_groups(
    df: DataFrame, keys: list[str], order: list[str], apart: list[Column], totals: dict, last: dict, last_before: dict, previous: dict, following: dict,
) -> DataFrame:
    here = Window.partitionBy(*keys, *apart).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    final = {n: F.coalesce(F.sum(c).over(upto), F.lit(0)) for n, c in totals.items()}
    final |= {n: F.last(c, ignorenulls=True).over(upto) for n, c in last.items()}
    final |= {n: F.last(c, ignorenulls=True).over(before) for n, c in last_before.items()}
    final |= {n: F.lag(c).over(here) for n, c in previous.items()}
    final |= {n: F.lead(c).over(here) for n, c in following.items()}
    return df.select(*[f"`{c}`" for c in df.columns if c not in final], *[c.alias(n) for n, c in final.items()])


def _scan_blocks(
    df: DataFrame, keys: list[str], order: list[str], block: Column, totals: dict, last: dict, last_before: dict, previous: dict, following: dict,
) -> DataFrame:
    blk = "__block"
    rows = df.withColumn(blk, block)
    here = Window.partitionBy(*keys, blk).orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)

    # Neighbour values travel inside a struct, so "no row" and "NULL value" differ.
    local, summary, carried, final = {}, [], {}, {}
    ahead = Window.partitionBy(*keys).orderBy(blk)
    past = ahead.rowsBetween(Window.unboundedPreceding, -1)
    for name, c in totals.items():
        local[f"__l_{name}"] = F.sum(c).over(upto)
        summary.append(F.sum(c).alias(f"__s_{name}"))
        carried[f"__c_{name}"] = F.sum(f"__s_{name}").over(past)
        final[name] = F.coalesce(F.col(f"__l_{name}"), F.lit(0)) + F.coalesce(F.col(f"__c_{name}"), F.lit(0))
    for names, frame in ((last, upto), (last_before, before)):
        for name, c in names.items():
            local[f"__l_{name}"] = F.last(c, ignorenulls=True).over(frame)
            summary.append(F.max_by(c, F.when(c.isNotNull(), at)).alias(f"__s_{name}"))
            carried[f"__c_{name}"] = F.last(f"__s_{name}", ignorenulls=True).over(past)
            final[name] = F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}"))
    for names, pick, step in ((previous, F.max_by, F.lag), (following, F.min_by, F.lead)):
        for name, c in names.items():
            boxed = F.struct(c.alias("v"))
            local[f"__l_{name}"] = step(boxed).over(here)
            summary.append(pick(boxed, at).alias(f"__s_{name}"))
            carried[f"__c_{name}"] = step(f"__s_{name}").over(ahead)
            final[name] = F.coalesce(F.col(f"__l_{name}"), F.col(f"__c_{name}"))["v"]

    per_block = rows.groupBy(*keys, blk).agg(*summary)
    carry = per_block.select(*keys, blk, *[c.alias(n) for n, c in carried.items()])
    out = rows.select("*", *[c.alias(n) for n, c in local.items()]).join(carry, [*keys, blk], "left")
    return out.select(*[f"`{c}`" for c in df.columns if c not in final], *[c.alias(n) for n, c in final.items()])


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; the rank limit applies before the shuffle too.

    Spark limits ranks before a shuffle up to ``PUSHED_RANKS``. For more, the first ``k`` are
    picked from each of many parts of a key before those are ranked together, so no task
    gets a whole large key. ``order`` should be total, else ties are settled by chance.
    """
    name = rank or "__rank"
    w = Window.partitionBy(*keys).orderBy(*order)
    if k > PUSHED_RANKS:
        part = Window.partitionBy(*keys, "__part").orderBy(*order)
        parted = df.withColumn("__part", F.spark_partition_id())
        df = parted.withColumn(name, F.row_number().over(part)).where(F.col(name) <= k).drop(name, "__part")
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out if rank else out.drop(name)

"""Rates and periods that are both many, without pairing them.

Whether some rate of a key contains a period is a search in a tree of fixed fan-out over
the starts of its rates: a node knows for each child the latest end below it. A period
goes up from its own start until a child to the left reaches its end, and down again along
the last child that does, so it meets one node per level instead of every rate. The rate
that ended last, and the narrowest among rates of one start, come from ordered scans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from capledger.operators import bounded
from capledger.operators.ordered import ordered_scan
from capledger.sources.scratch import stored

BITS = 6  # a node has 64 children
SCAN_BITS = 10  # an ordered scan takes 1,024 years, or days, at a time
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def countable(df: DataFrame, *columns: str) -> bool:
    """Whether the columns are whole numbers, which the tree needs."""
    return all(isinstance(df.schema[c].dataType, _INTEGRAL) for c in columns)


def effective_rate_many(
    rates: DataFrame, periods: DataFrame, key: str, value: str,
    start: str = "period_start", end: str = "period_end",
) -> DataFrame:
    """(key, period_start, period_end, value) as ``effective.effective_rate`` gives it, for any
    number of rates per key and of periods; both sides' bounds are whole numbers.

    A NULL key is a key. Periods that lack a bound have no row.
    """
    bound = lambda c: F.col(f"`{c}`").cast("long")
    given = rates.select(
        F.struct(F.col(f"`{key}`").alias("key")).alias("k"), bound(start).alias("f"), bound(end).alias("t"),
        F.struct(F.col(f"`{value}`").alias("value")).alias("box"),
    )
    # Of equal spans the greatest value counts. Boxes tell a NULL rate from none.
    spans = stored(given.groupBy("k", "f", "t").agg(F.max("box").alias("box")), "spans")
    asked = _asked(spans, periods)
    lasting = spans.where("f IS NOT NULL AND t IS NOT NULL")
    within = stored(_narrowest(_latest_start(asked, lasting), lasting), "within")
    always = spans.where("f IS NULL").groupBy("k").agg(F.max(F.struct((-F.col("t")).alias("t"), "box")).alias("a"))
    chosen = bounded.lookup_join(_ended_last(within, lasting), always, ["k"], "left").withColumn(
        "box", F.coalesce("within", F.col("a.box"), "ended"))
    bounds = [F.col(own).cast(periods.schema[c].dataType).alias(c) for own, c in (("s", "period_start"), ("e", "period_end"))]
    return chosen.where("box IS NOT NULL").select(F.col("k.key").alias(key), *bounds, F.col("box.value").alias(value))


def _asked(spans: DataFrame, periods: DataFrame) -> DataFrame:
    """(k, s, e): every key in every period, which is also what the result has."""
    keys = spans.select(F.col("k.key").alias("key")).distinct()
    times = periods.select(F.col("period_start").cast("long").alias("s"), F.col("period_end").cast("long").alias("e"))
    times = stored(times.where("s IS NOT NULL AND e IS NOT NULL").distinct(), "periods")
    few = bounded.few_rows(times)
    both = bounded.cross_rows(times, keys) if few is None else bounded.cross_lines(keys, [tuple(r) for r in few], times.schema)
    return both.select(F.struct("key").alias("k"), "s", "e")


def _child(x: Column, level: int) -> Column:
    return F.shiftright(x, BITS * level).bitwiseAND(F.lit((1 << BITS) - 1))


def _tree(tops: DataFrame, levels: int) -> DataFrame:
    """(level, k, node, children): each child with the latest end of the rates below it."""
    entries, parts = tops, []
    for level in range(levels):
        nodes = entries.groupBy("k", F.shiftright("x", BITS).alias("node")).agg(
            F.array_sort(F.collect_list(F.struct(_child(F.col("x"), 0).alias("c"), "t"))).alias("children"), F.max("t").alias("t"))
        parts.append(nodes.select(F.lit(level).alias("level"), "k", "node", "children"))
        entries = nodes.select("k", F.col("node").alias("x"), "t")
    return stored(reduce(DataFrame.unionByName, parts), "starts")


def _latest_start(asked: DataFrame, lasting: DataFrame) -> DataFrame:
    """Adds ``f``: the latest start of a rate that contains the period, NULL if none does."""
    ends = stored(lasting.groupBy("k", "f").agg(F.max("t").alias("t")), "ends")
    low, high = ends.agg(F.min("f"), F.max("f")).first()
    if low is None:
        return asked.withColumn("f", F.lit(None).cast("long"))
    levels = max(1, -(-(high - low).bit_length() // BITS))
    tree = _tree(ends.select("k", (F.col("f") - low).alias("x"), "t"), levels)
    place = F.when(F.col("s") >= low, F.least("s", F.lit(high)) - low)
    q = asked.withColumns({"place": place, "x": F.lit(None).cast("long"), "depth": F.lit(None).cast("int")})

    def met(q: DataFrame, level: int, node: Column) -> DataFrame:
        return bounded.lookup_join(q.withColumn("node", node), tree.where(F.col("level") == level).drop("level"), ["k", "node"], "left")

    def last_child(fits) -> Column:
        found = F.filter("children", lambda n: (n["t"] >= F.col("e")) & fits(n["c"]))
        return F.col("node") * (1 << BITS) + F.try_element_at(found, F.lit(-1))["c"]

    for level in range(levels):  # up: children left of the own place, on the lowest level the own one too
        own = _child(F.col("place"), level)
        up = met(q, level, F.coalesce(F.shiftright("place", BITS * (level + 1)), F.lit(-1) - F.col("e")))
        hit = F.when(F.col("x").isNull(), last_child(lambda c: c <= own if level == 0 else c < own))
        q = up.withColumn("hit", hit).withColumns({
            "depth": F.coalesce("depth", F.when(F.col("hit").isNotNull(), level)), "x": F.coalesce("x", "hit"),
        }).drop("hit", "node", "children")
    for level in reversed(range(levels - 1)):  # down: the last child that lasts long enough
        down = met(q, level, F.coalesce("x", F.lit(-1) - F.col("e")))
        q = down.withColumn("x", F.when(F.col("depth") > level, last_child(lambda c: F.lit(True))).otherwise(F.col("x"))).drop("node", "children")
    return q.select("k", "s", "e", (F.col("x") + low).alias("f"))


def _scanned(asked: DataFrame, facts: DataFrame, keys: list[str], at: Column, first: bool, out: str) -> DataFrame:
    """Adds ``out``: the box of the last fact (keys, at, box) at or before ``at``; strictly before it unless ``first``."""
    kind = int(first)  # of equal places the lower kind comes first
    rows = asked.withColumns({"at": at, "kind": F.lit(kind), "box": F.lit(None).cast(facts.schema["box"].dataType)})
    order = {"kind": F.lit(1 - kind), "s": F.lit(0).cast("long"), "e": F.lit(0).cast("long")}
    lines = rows.unionByName(facts.withColumns(order), allowMissingColumns=True)
    done = ordered_scan(lines, keys, ["at", "kind", "s", "e"], F.shiftright("at", SCAN_BITS), last={out: F.col("box")})
    return done.where(F.col("kind") == kind).drop("at", "kind", "box")


def _narrowest(asked: DataFrame, lasting: DataFrame) -> DataFrame:
    """Adds ``within``: of the rates that start at ``f``, the one that ends first at or after the period."""
    asked = stored(asked, "stabbed")
    facts = lasting.select("k", "f", (-F.col("t")).alias("at"), "box")
    hit = _scanned(asked.where("f IS NOT NULL"), facts, ["k", "f"], -F.col("e"), True, "within").drop("f")
    return hit.unionByName(asked.where("f IS NULL").drop("f"), allowMissingColumns=True)


def _ended_last(asked: DataFrame, lasting: DataFrame) -> DataFrame:
    """Adds ``ended``: the rate that ended last before the period, of several the latest start, then the greatest value."""
    facts = lasting.groupBy("k", F.col("t").alias("at")).agg(F.max(F.struct("f", "box")).alias("best")).select("k", "at", F.col("best.box").alias("box"))
    return _scanned(asked, facts, ["k"], F.col("s"), False, "ended")

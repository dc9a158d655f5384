"""Temperature mixing of sources into budgeted block permutations.

A source with t tokens has weight t^a over the sum of all t^a. The exponent a is found by
bisection: 1 keeps the natural shares, 0 makes all equal. It is the largest exponent whose
weights reach a target entropy, or the least one with which no source is repeated more
often than a limit; with both, the limit wins. A source then gets its weight of the token
budget: whole epochs, and of one more epoch the first documents that fit.

Each epoch is a keyed permutation of the documents. It is cut into blocks by the leading
digits of the key; whole blocks are in or out by sums of blocks, and only the block where the
budget ends is summed row by row. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.sources.scratch import stored

BLOCK_TOKENS = 65_536
MOST_BLOCKS = 65_536
BITS, ROUND_BITS = 30, 6


def token_count(text: str) -> Column:
    """Runs of anything but blanks, tabs and line ends; 0 for NULL."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("long")


def source_key(source: str) -> Column:
    """A text for every source, NULL included."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("~"))


def _tried(sources: DataFrame, exponents: list[float], budget: int) -> dict[float, tuple[float, float]]:
    """For each exponent the entropy of the weights and the most repetitions of a source."""
    peak = sources.agg(F.max("tokens")).first()[0]
    each = sources.select("tokens", F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a"))
    each = each.withColumn("z", F.col("a") * F.log(F.col("tokens") / F.lit(float(peak))))
    power = F.exp("z")
    rows = each.groupBy("a").agg(F.sum(power).alias("s"), F.sum(power * F.col("z")).alias("sz"), F.max(power / F.col("tokens")).alias("r")).collect()
    # H = ln s - sum(p z) with p = exp(z) / s
    from math import log

    return {r["a"]: (log(r["s"]) - r["sz"] / r["s"], budget * r["r"] / r["s"]) for r in rows}


def _bisected(sources: DataFrame, budget: int, holds) -> float:
    """The greatest of the dyadic exponents in [0, 1] of ``BITS`` bits up to which ``holds`` is
    true, several bits in one job; 0 if it holds nowhere."""
    low, step = 0.0, 1.0
    if holds(*_tried(sources, [1.0], budget)[1.0]):
        return 1.0
    for _ in range(BITS // ROUND_BITS):
        step /= 1 << ROUND_BITS
        tried = _tried(sources, [low + i * step for i in range(1 << ROUND_BITS)], budget)
        good = [a for a, got in tried.items() if holds(*got)]
        low = max(good, default=low)
    return low


def mixing_exponent(sources: DataFrame, budget: int, entropy: float | None = None, repetitions: float | None = None) -> float:
    """``sources`` has (tokens) of each source, all positive.

    ``entropy`` in nats; one that no exponent in [0, 1] reaches gives 0, one below the
    natural shares' gives 1. ``repetitions`` that not even natural shares keep give 1.
    """
    exponent = 0.0
    if entropy is not None:
        exponent = _bisected(sources, budget, lambda h, r: h >= entropy)
    if repetitions is not None and exponent < 1:
        step = 2.0**-BITS
        if entropy is None or _tried(sources, [exponent], budget)[exponent][1] > repetitions:
            below = _bisected(sources, budget, lambda h, r: r > repetitions)
            broken = _tried(sources, [below], budget)[below][1] > repetitions
            exponent = max(exponent, min(1.0, below + step) if broken else 0.0)
    return exponent


def mix_sources(
    docs: DataFrame, *, budget: int | None = None, entropy: float | None = None, repetitions: float | None = None, seed: str = "mix",
    block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", prefix: str = "mix_",
) -> DataFrame:
    """Every chosen copy of a row, all columns kept, and after them

    n_tokens, epoch, block, slot   each with ``prefix``: words, number of the copy, block of that
                                   epoch's permutation, and where the block stands in the whole
                                   mixture, from 0 to 1

    ``budget`` is in tokens; without one it is the tokens there are. A NULL source is a source,
    a source without tokens is left out, a row without tokens takes no budget. Rows with the
    same id stand at the same place and are in or out together. No rows give none.
    """
    names = [f"{prefix}{c}" for c in ("n_tokens", "epoch", "block", "slot")]
    if set(names) & set(docs.columns):
        raise ValueError(f"{names} are columns already")
    rows = docs.withColumn(names[0], token_count(text_col)).withColumn("__key", source_key(source_col)).withColumn("__id", F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    slim = stored(rows.select(F.col("__key").alias("key"), F.col("__id").alias("id"), F.col(names[0]).alias("n")), "mixed-rows")
    sources = stored(slim.groupBy("key").agg(F.sum("n").alias("tokens")).where("tokens > 0"), "sources")
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return rows.limit(0).select(*[f"`{c}`" for c in docs.columns], names[0], F.lit(0).alias(names[1]), F.lit(0).cast("long").alias(names[2]), F.lit(0.0).alias(names[3]))
    budget = total if budget is None else budget
    exponent = 1.0 if entropy is None and repetitions is None else mixing_exponent(sources, budget, entropy, repetitions)
    power = F.exp(F.lit(exponent) * F.log(F.col("tokens") / F.lit(float(total))))
    whole = sources.agg(F.sum(power)).first()[0]
    plan = sources.select(
        "key", "tokens", F.floor(power / F.lit(whole) * F.lit(float(budget))).cast("long").alias("own"),
        F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("tokens") / block_tokens)).cast("long").alias("blocks"),
    ).select("*", F.floor(F.col("own") / F.col("tokens")).cast("int").alias("epochs"), F.pmod("own", "tokens").alias("rest"))
    plan = stored(plan, "mix-plan")

    def order(epoch: Column, key: str = "key", id_: str = "id") -> Column:
        return F.md5(F.concat_ws("|", F.lit(seed), epoch.cast("string"), F.col(key), F.col(id_)).cast("binary"))

    def block(order_: Column, blocks: str = "blocks") -> Column:
        return F.floor(F.conv(F.substring(order_, 1, 8), 16, 10).cast("long") * F.col(blocks) / F.lit(2**32)).cast("long")

    # The last epoch: blocks that fit, the block where the budget ends, and the last row that fits in it.
    last = slim.join(plan, "key").withColumn("o", order(F.col("epochs"))).withColumn("b", block(F.col("o")))
    sums = last.groupBy("key", "rest", "b").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("key").orderBy("b")
    edges = sums.select("key", "rest", "b", F.sum("n").over(upto).alias("end"), (F.sum("n").over(upto) - F.col("n")).alias("start")).where("end > rest")
    edges = stored(edges.groupBy("key").agg(F.min_by(F.struct(F.col("b").alias("edge"), "start"), "b").alias("e")).select("key", "e.*"), "edges")
    inner = last.join(edges, "key").where("b = edge")
    so_far = F.col("start") + F.sum("n").over(Window.partitionBy("key").orderBy("o").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = inner.select("key", "o", "rest", so_far.alias("so_far")).where("so_far <= rest").groupBy("key").agg(F.max("o").alias("cut"))
    plan = stored(plan.join(edges, "key", "left").join(cut, "key", "left"), "mix-plan")

    named = rows.join(plan.withColumnRenamed("key", "__key").select("__key", *[F.col(c).alias(f"__{c}") for c in ("tokens", "own", "blocks", "epochs", "rest", "edge", "cut")]), "__key")
    o = order(F.col("__epochs"), "__key", "__id")
    b = block(o, "__blocks")
    partial = (F.col("__rest") > 0) & ((F.coalesce(b < F.col("__edge"), F.lit(True))) | ((b == F.col("__edge")) & F.coalesce(o <= F.col("__cut"), F.lit(False))))
    copies = F.col("__epochs") + F.when(partial, 1).otherwise(0)
    out = named.withColumn("__copies", copies).where("__copies > 0").withColumn(names[1], F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    out = out.withColumn(names[2], block(order(F.col(names[1]), "__key", "__id"), "__blocks"))
    slot = (F.col(names[1]) * F.col("__blocks") + F.col(names[2]) + F.lit(0.5)) / (F.col("__blocks") * F.col("__own") / F.col("__tokens") + F.lit(1))
    return out.select(*[f"`{c}`" for c in docs.columns], names[0], names[1], names[2], F.least(slot, F.lit(1.0)).alias(names[3]))

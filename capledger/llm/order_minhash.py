"""Near-duplicate classes by Order MinHash.

A text is the sequence of its runs of five words, each labelled with how often that
run has come before, so that no two symbols of one text are equal. A sketch takes the
three symbols with the least hash values and keeps them in the order of the text: two
texts share a sketch when these agree *and* follow each other alike. With a similarity
of 0.8 a sketch agrees with probability 0.8^3; of twenty sketches none agrees in one
of a million pairs.

The similarity of two texts is that of the best alignment of their symbol sequences:
aligned symbols over the symbols of both. An alignment with 0.8 or more leaves out at
most a ninth of all symbols, so it never leaves that band around the diagonal, and only
the band is searched.

Texts that meet in a sketch are compared with one leader of that sketch, never all with
all. Where a sketch still holds several components, its texts are compared exactly but
for what cannot be similar: of two texts with a similarity of 0.8, ordered from rare to
frequent symbols, the first fifths share a symbol. There each text outside the largest
component of a symbol meets the others, if the parities of their symbol counts in 512
bins, which bound from below how many symbols differ, allow it. How frequent a symbol is comes from a table of
fixed size, which only decides the order and so cannot lose a pair.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.llm.components import component_labels
from capledger.llm.text import mix, slices, small_batches, string_buffers, words
from capledger.operators.bounded import lookup_join, split_join
from capledger.sources.scratch import stored

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 20
ORDERED = 3
SLOTS = 1 << 18
PARITIES = 512

_SKETCHED = "id long, digest long, node long, twin long, symbols int, sketch array<long>, parity array<long>, words binary"


def _symbols(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``k`` words of each text with the number of equal runs before; a shorter
    text is one run. Returns (symbols, number of the first symbol of each text)."""
    count = np.diff(first)
    runs = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    begin = np.r_[0, np.cumsum(runs)]
    doc = np.repeat(np.arange(len(runs)), runs)
    at = np.arange(begin[-1]) - begin[doc] + first[doc]
    padded = np.r_[hashes, np.zeros(k, np.uint64)]
    left = count[doc] - (at - first[doc])
    symbol = np.zeros(len(at), np.uint64)
    for j in range(k):
        symbol = mix(symbol + np.where(j < left, padded[at + j], np.uint64(0)), j + 1)
    order = np.lexsort((symbol, doc))
    same = np.r_[False, (symbol[order][1:] == symbol[order][:-1]) & (doc[order][1:] == doc[order][:-1])]
    if same.any():
        place = np.arange(len(same))
        label = place - np.maximum.accumulate(np.where(same, 0, place))
        symbol[order] = np.where(same, mix(symbol[order] + label.astype(np.uint64), 99), symbol[order])
    return symbol, begin


def _least_in_order(values: np.ndarray, begin: np.ndarray, symbol: np.ndarray, take: int) -> np.ndarray:
    """Of each text the ``take`` symbols of least value, hashed together in text order."""
    filled = np.flatnonzero(np.diff(begin))
    out = np.zeros(len(begin) - 1, np.uint64)
    if not len(filled):
        return out
    at = begin[filled]
    doc = np.repeat(np.arange(len(filled)), np.diff(begin)[filled])
    values = values.copy()
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    places = []
    for _ in range(take):
        least = np.minimum.reduceat(values, at)
        hit = np.flatnonzero((values == least[doc]) & (values != none))
        place = np.full(len(filled), -1)
        place[doc[hit][::-1]] = hit[::-1]
        values[place[place >= 0]] = none
        places.append(place)
    ordered = np.sort(np.stack(places), axis=0)
    key = np.zeros(len(filled), np.uint64)
    for place in ordered:
        key = mix(key + np.where(place >= 0, symbol[place], np.uint64(1)), 5)
    out[filled] = key
    return out


def _sketch(seed: int, k: int, sketches: int, take: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                local = offsets[a : b + 1] - offsets[a]
                w = words(part, local)
                n = b - a
                hashes = mix(w.hashes, seed)
                symbol, begin = _symbols(hashes, w.first, k)
                count = np.diff(begin)
                sketch = np.empty((n, sketches), np.uint64)
                for s in range(sketches):
                    values = mix(symbol, seed * 1000 + s + 1)
                    sketch[:, s] = mix(_least_in_order(values, begin, symbol, take), s + 1)
                # Two numbers of the text: of its words, or of its bytes where it has none.
                place = np.arange(len(hashes)) - w.first[w.doc] if len(hashes) else np.zeros(0, np.int64)
                numbers = []
                for salt in (11, 12):
                    coded = mix(hashes + mix(place.astype(np.uint64), salt), salt)
                    total = np.r_[np.uint64(0), np.cumsum(coded)]
                    number = mix(total[w.first[1:]] - total[w.first[:-1]] + np.diff(w.first).astype(np.uint64), salt)
                    for i in np.flatnonzero(count == 0):
                        raw = bytes(part[local[i] : local[i + 1]])
                        number[i] = np.uint64(int.from_bytes(blake2b(raw, digest_size=8, salt=bytes([salt, seed])).digest(), "little"))
                    numbers.append(number.view(np.int64))
                odd = np.bincount(np.repeat(np.arange(n), count) * PARITIES + (symbol % np.uint64(PARITIES)).astype(np.int64), minlength=n * PARITIES) & 1
                parity = np.packbits(odd.astype(np.uint8)).view(np.int64)
                wide = PARITIES // 64
                small = hashes.astype(np.uint32)
                kept = np.where(count > 0, sketches, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)], pa.int32()), pa.array(sketch[count > 0].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], batch.column(2)[a:b], pa.array(numbers[0]), pa.array(numbers[1]), pa.array(count, pa.int32()), lists,
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * wide, pa.int32()), pa.array(parity)),
                    pa.array([small[w.first[i] : w.first[i + 1]].tobytes() for i in range(n)], pa.binary()),
                ], names=["id", "digest", "node", "twin", "symbols", "sketch", "parity", "words"])

    return run


def ordered_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Aligned symbols over all symbols of two sequences of distinct symbols, or 0 below ``least``.

    Symbols are distinct, so the best alignment is the longest run of common symbols that
    rises in both; only pairs within the band that ``least`` leaves are looked at.
    """
    both = len(a) + len(b)
    band = int(both * (1 - least) / (1 + least) + 1e-9)
    if not both or abs(len(a) - len(b)) > band:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) * (1 + least) < least * both - 1e-9:
        return 0.0
    if not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        aligned = len(tails)
    else:
        aligned = len(j)
    return aligned / (both - aligned)


def _compare(k: int, least: float):
    def sequences(column: pa.Array, ids: pa.Array) -> dict[int, np.ndarray]:
        """The symbols of each different text of a column, all computed at once."""
        _, first = np.unique(ids.to_numpy(), return_index=True)
        data, offsets = string_buffers(column.take(pa.array(first)))
        hashes = np.frombuffer(data.tobytes(), np.uint32).astype(np.uint64)
        symbol, begin = _symbols(hashes, offsets // 4, k)
        names = ids.to_numpy()[first].tolist()
        return {name: symbol[begin[i] : begin[i + 1]] for i, name in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                left, right = sequences(batch.column(2), batch.column(0)), sequences(batch.column(3), batch.column(1))
                u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                keep = [ordered_similarity(left[a], right[b], least) >= least - 1e-12 for a, b in zip(u, v, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


_RARE = "node long, component long, symbols int, rare array<long>"


def _of_batch(batch: pa.RecordBatch, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for r, raw in enumerate(batch.column("words").to_pylist()):
        h = np.frombuffer(raw, np.uint32).astype(np.uint64)
        yield r, _symbols(h, np.array([0, len(h)]), k)[0]


def _frequencies(texts: DataFrame, k: int) -> np.ndarray:
    """How many symbols fall into each of a fixed number of slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, symbol in _of_batch(batch, k):
                np.add.at(counts, (symbol % np.uint64(SLOTS)).astype(np.int64), 1)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts[slot])], names=["slot", "n"])

    total = np.zeros(SLOTS, np.int64)
    found = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return total


def _rare_symbols(counts: np.ndarray, k: int, least: float):
    """The symbols of each text that a similar text must share one of, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes = [], []
            for _, symbol in _of_batch(batch, k):
                n = len(symbol)
                take = n - int(np.ceil(least * n - 1e-9)) + 1
                order = np.lexsort((symbol, counts[(symbol % np.uint64(SLOTS)).astype(np.int64)]))[:take]
                kept.append(symbol[order].view(np.int64))
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("component"), pa.array(sizes, pa.int32()), pa.array(kept, pa.list_(pa.int64())),
            ], names=["node", "component", "symbols", "rare"])

    return run


def _alike(a: str, b: str, least: float):
    """Whether the lengths alone allow the similarity."""
    return (F.least(a, b) >= F.greatest(a, b) * F.lit(least)) & (F.col(a) > 0)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    left = texts.select(F.col("node").alias("u"), F.col("words").alias("left"))
    right = texts.select(F.col("node").alias("v"), F.col("words").alias("right"))
    found = pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right")
    return found.mapInArrow(_compare(k, least), "u long, v long")


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.lower(F.col(f"`{text_col}`").cast("string"))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("digest"))


def placed_rows(given: DataFrame, shingle: int, similarity: float, sketches: int, ordered: int) -> DataFrame:
    """(id, digest, node, component) of each row of ``given`` (id, text, digest) with a text: node is
    the same for equal word sequences, component for one class. A stored table."""
    small_batches(given.sparkSession)
    texts = given.where("text IS NOT NULL")
    for seed in range(1, 6):
        rows = stored(texts.mapInArrow(_sketch(seed, shingle, sketches, ordered), _SKETCHED), "sketched")
        nodes = rows.groupBy("node").agg(
            F.min("twin").alias("twin"), F.max("twin").alias("other"), F.any_value("symbols").alias("symbols"), F.any_value("sketch").alias("sketch"), F.any_value("parity").alias("parity"),
        )
        nodes = stored(nodes, "nodes")
        if nodes.where("twin <> other").isEmpty():  # else two texts share a number: again with others
            break
    else:
        raise RuntimeError("texts could not be told apart by their numbers")

    met = nodes.select("node", "symbols", F.explode("sketch").alias("key"))
    leaders = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"), F.min_by("symbols", "node").alias("leader_symbols")).where("n > 1")
    members = stored(met.join(leaders.drop("n"), "key"), "members")
    led = members.where("node <> leader").where(_alike("symbols", "leader_symbols", similarity))
    pairs = stored(led.select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct(), "led")
    needed = members.select("node").distinct()
    sequences = stored(rows.select("node", "words").join(needed, "node", "left_semi").dropDuplicates(["node"]), "sequences")
    links = stored(_verified(pairs, sequences, shingle, similarity), "links")
    labels = stored(component_labels(links), "labels")

    # Sketches with several components: their texts again, by their rare symbols.
    placed = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    parted = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    unsettled = stored(placed.join(parted, "key", "left_semi").select("node", "component").distinct(), "unsettled")
    again = stored(sequences.join(unsettled, "node"), "again")
    rare = stored(again.mapInArrow(_rare_symbols(_frequencies(again, shingle), shingle, similarity), _RARE), "rare")
    # With each symbol the two before it: texts that share one of these have met there already.
    each = rare.select("node", "component", "symbols", "rare", F.posexplode("rare").alias("rank", "symbol")).select(
        "node", "component", "symbols", "rank", "symbol", *[F.coalesce(F.get("rare", F.col("rank") - i), F.lit(-i)).alias(f"before_{i}") for i in (1, 2)])
    parts = each.groupBy("symbol", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("symbol").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    shared = each.join(largest.select("symbol", "main"), "symbol").join(nodes.select("node", "parity"), "node")
    shared = stored(shared, "shared")
    outside = shared.where("component <> main").select("symbol", *[F.col(c).alias(f"o_{c}") for c in shared.columns if c not in ("symbol", "main")])
    both = F.col("o_symbols") + F.col("symbols")
    differ = reduce(add, [F.bit_count(F.get("o_parity", F.lit(i)).bitwiseXOR(F.get("parity", F.lit(i)))) for i in range(PARITIES // 64)])
    # At its first common symbol what follows must be enough; most later ones are left out.
    seen = F.lit(False)
    for i, o in ((1, 1), (2, 2), (1, 2), (2, 1)):
        seen = seen | ((F.col(f"before_{i}") == F.col(f"o_before_{o}")) & (F.col("rank") >= i) & (F.col("o_rank") >= o))
    follows = F.least(F.col("o_symbols") - F.col("o_rank"), F.col("symbols") - F.col("rank"))
    rest = outside.join(shared, "symbol").where(
        (F.col("o_component") != F.col("component")) & _alike("o_symbols", "symbols", similarity)
        & (follows >= both * F.lit(similarity / (1 + similarity)) - F.lit(1e-6)) & (differ <= both * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6))
        & ~seen)
    rest = rest.withColumnRenamed("o_node", "u")
    rest = rest.select(F.greatest("u", "node").alias("u"), F.least("u", "node").alias("v")).distinct().join(
        pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti")
    more = stored(_verified(rest, sequences, shingle, similarity), "more-links")
    if not more.isEmpty():
        labels = stored(component_labels(links.unionByName(more)), "labels")

    whole = split_join(rows.select("id", "digest", "node"), labels, ["node"]).select("id", "digest", F.coalesce("component", "node").alias("component"), "node")
    return stored(whole, "placed")


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE,
    similarity: float = SIMILARITY, sketches: int = SKETCHES, ordered: int = ORDERED,
) -> DataFrame:
    """(id, class_id, n_texts, n_rows) for each row of ``docs``.

    class_id is the least id of the class, n_texts the count of its different word
    sequences, n_rows that of its rows. Texts with equal words are one class whatever
    their length; texts without any word are one class when they are equal byte by byte
    in lower case. A NULL text is a class of its own row: its id, with NULL n_texts. NULL ids
    are passed through and never name a class unless all its ids are NULL. Rows with the
    same id and different texts stay apart. Empty tables give empty results.
    """
    given = _given(docs, id_col, text_col)
    whole = placed_rows(given, shingle, similarity, sketches, ordered)
    classes = whole.groupBy("component").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n_rows"))
    n_texts = whole.select("component", "node").distinct().groupBy("component").agg(F.count(F.lit(1)).alias("n_texts"))
    # One class may hold a large share of all rows: these are not dealt by their class.
    named = split_join(whole, stored(classes.join(n_texts, "component"), "classes"), ["component"], "inner").select("id", "class_id", "n_texts", "n_rows")
    alone = given.where("text IS NULL").select("id", F.col("id").alias("class_id"), F.lit(None).cast("long").alias("n_texts"), F.lit(1).cast("long").alias("n_rows"))
    return named.unionByName(alone)


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, similarity: float = SIMILARITY,
    sketches: int = SKETCHES, ordered: int = ORDERED,
) -> DataFrame:
    """One row of each class, all columns kept: that of its least id, NULL last, and the least hash of its text.

    A row with a NULL text is always kept. Of rows that are alike in id and lower-cased text one
    is kept; which one is open where they differ in other columns.
    """
    key = ["__near_id", "__near_null", "__near_digest"]
    if clash := set(key) & set(docs.columns):
        raise ValueError(f"columns of these names are needed here: {sorted(clash)}")
    whole = placed_rows(_given(docs, id_col, text_col), shingle, similarity, sketches, ordered)
    own = F.struct(F.col("id").isNull().alias("null"), "id", "digest")
    first = stored(whole.groupBy("component").agg(F.min(own).alias("first")), "first-rows")
    judged = split_join(whole, first, ["component"], "inner").withColumn("own", own)
    pair = [F.coalesce("id", F.lit(0)).alias(key[0]), F.col("id").isNull().alias(key[1]), F.col("digest").alias(key[2])]
    drop = stored(judged.where(~F.col("own").eqNullSafe(F.col("first"))).select(*pair).distinct(), "losers")
    repeated = stored(judged.where(F.col("own").eqNullSafe(F.col("first"))).groupBy(*pair).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-rows")
    id_, text = F.col(f"`{id_col}`").cast("long"), F.lower(F.col(f"`{text_col}`").cast("string"))
    # NULL texts have no digest, so they meet nothing.
    keyed = docs.withColumns(dict(zip(key, [F.coalesce(id_, F.lit(0)), id_.isNull(), F.when(text.isNotNull(), F.xxhash64(text))], strict=True)))
    kept = lookup_join(keyed, drop, key, "left_anti")
    if not repeated.isEmpty():
        kept = lookup_join(kept, repeated, key, "left_anti").unionByName(lookup_join(kept, repeated, key, "left_semi").dropDuplicates(key))
    return kept.select(*[f"`{c}`" for c in docs.columns])

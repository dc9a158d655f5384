"""Benchmark items that occur in documents up to a few edited words.

Windows of a document are read by the CGK random walk: at each step the word under a
pointer is given out, and the pointer goes on or stays by a random bit of step and word.
Texts with few edits fall into step again after each, so their walks differ in few places:
edit distance becomes Hamming distance. Some places of the walk, sampled at random, make a
key; a window and an item that agree in a key are a candidate. Several walks and samples
reach the target recall, and an exact alignment decides each candidate.

A window starts at every ``stride``-th word of a document. An item is entered once for each
of its offsets, so wherever it stands some window begins at one of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.llm.text import mix, slices, small_batches, string_buffers, words
from capledger.operators.bounded import lookup_join
from capledger.sources.scratch import stored

EDIT_SHARE = 0.1  # edited words of an item, at most
WALKS, SAMPLES, PLACES = 6, 3, 4
MOST_STEPS = 64
MOST_STRIDE = 8
BLOCK_BYTES = 128 << 20  # of the items and keys in one index
RUNS = 16
BITMAP_BITS = 20

_KEY = np.uint64(0x9E3779B97F4A7C15)
_TEXT, _HASHES = "__decontaminate_text", ("__decontaminate_a", "__decontaminate_b")


@dataclass
class Layout:
    least: int  # words of the shortest item
    stride: int
    multipliers: np.ndarray  # (walks, steps): odd numbers that make the bits
    samples: list[list[tuple[int, np.ndarray]]]  # of each walk: (size class, sorted places)


@dataclass
class Items:
    layout: Layout
    ids: list
    symbols: list[np.ndarray]  # word hashes, never 0
    keys: np.ndarray  # sorted
    entries: np.ndarray  # (item, offset) of each key
    bitmap: np.ndarray


def _walked(symbols: np.ndarray, at: np.ndarray, multipliers: np.ndarray, samples: list[tuple[int, np.ndarray]], numbers=None) -> list[np.ndarray]:
    """The key of every sample, for walks from all the places ``at``. A symbol 0 ends the text:
    its bit is 0, so the pointer stays there. ``numbers`` are those of the samples, if some only are asked for."""
    pointer = at.astype(np.int64)
    keys = [np.full(len(at), np.uint64(7919 * (i + 1)), np.uint64) for i in numbers or range(len(samples))]
    taken: dict[int, list[np.ndarray]] = {}
    for key, (_, places) in zip(keys, samples, strict=True):
        for t in places.tolist():
            taken.setdefault(t, []).append(key)
    here, bit = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for t in range(max(taken) + 1):
        np.take(symbols, pointer, out=here, mode="clip")
        for key in taken.get(t, ()):
            np.multiply(key, _KEY, out=key)
            np.add(key, here, out=key)
        np.multiply(here, multipliers[t], out=bit)
        np.right_shift(bit, np.uint64(63), out=bit)
        np.add(pointer, bit.view(np.int64), out=pointer)
    return [mix(key) for key in keys]


def _symbols(texts: pa.Array) -> list[np.ndarray]:
    data, offsets = string_buffers(texts)
    w = words(data, offsets)
    hashes = np.maximum(w.hashes, np.uint64(1))
    return [hashes[w.first[i] : w.first[i + 1]] for i in range(len(texts))]


def size_class(n, least: int):
    """Items of one class have windows of one size. Walks of long windows would end early, so the classes do too."""
    most = 0
    while 1.6 * _window(most, least) < MOST_STEPS:
        most += 1
    return min((n // least).bit_length() - 1, most)


def _stride(least: int) -> int:
    return max(1, min(MOST_STRIDE, least // 2))


def _window(c: int, least: int) -> int:
    return least * 2**c - _stride(least) + 1


def make_layout(least: int, classes: list[int], walks: int = WALKS, samples: int = SAMPLES, places: int = PLACES, seed: int = 5) -> Layout:
    """What all items share: their fewest words decide the stride, their size classes the samples."""
    rng = np.random.default_rng(seed)
    multipliers = rng.integers(0, 1 << 63, (walks, MOST_STEPS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    drawn: list[list[tuple[int, np.ndarray]]] = []
    for _ in range(walks):
        own = []
        for c in classes:
            steps = max(1, min(MOST_STEPS, int(1.6 * _window(c, least))))
            # Spread over the walk: neighbouring places often give the same word.
            count = min(places, steps)
            own += [(c, np.floor((np.arange(count) + rng.uniform()) * steps / count).astype(int)) for _ in range(samples)]
        drawn.append(own)
    return Layout(least, _stride(least), multipliers, drawn)


def entered_offsets(n: int, window: int, stride: int) -> np.ndarray:
    """Where the windows of an item of ``n`` words begin: at each word, and in long items at
    ``RUNS`` runs of as many words as a stride has, spread over the item. Some window of a
    document meets each run, wherever the item stands."""
    last = n - window + 1
    if last <= RUNS * stride:
        return np.arange(last)
    begin = np.linspace(0, last - stride, RUNS).astype(np.int64)
    return np.unique((begin[:, None] + np.arange(stride)).ravel())


def prepare_items(ids: list, texts: list[str], layout: Layout) -> Items:
    """The index of some items."""
    found = list(zip(ids, _symbols(pa.array(texts, pa.large_string())), strict=True))
    keys, entries = [], []
    for n, (_, s) in enumerate(found):
        ended, own = np.r_[s, np.zeros(1, np.uint64)], size_class(len(s), layout.least)
        offsets = entered_offsets(len(s), _window(own, layout.least), layout.stride)
        entry = np.stack([np.full(len(offsets), n), offsets], axis=1)
        for walk, samples in enumerate(layout.samples):
            mine = [i for i, (c, _) in enumerate(samples) if c == own]
            for i, key in zip(mine, _walked(ended, offsets, layout.multipliers[walk], [samples[i] for i in mine], mine), strict=True):
                keys.append(key + np.uint64(walk * 1000 + i))
                entries.append(entry)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    bitmap = np.zeros(1 << BITMAP_BITS, bool)
    bitmap[key >> np.uint64(64 - BITMAP_BITS)] = True
    return Items(layout, [i for i, _ in found], [s for _, s in found], key[order], np.concatenate(entries)[order], bitmap)


def least_edits(item: np.ndarray, segment: np.ndarray) -> int:
    """Fewest edits that turn the item into some run of the segment."""
    n = len(segment)
    place = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, symbol in enumerate(item, 1):
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (segment != symbol))
        new[0] = i
        row = np.minimum.accumulate(new - place) + place
    return int(row.min())


def _close(starts: list[int], gap: int) -> list[tuple[int, int]]:
    """Rising starts, in groups whose neighbours are at most ``gap`` apart: (first, last) of each.
    Edits shift a start, so one place of an item often has several."""
    groups = [[starts[0], starts[0]]]
    for p in starts[1:]:
        if p - groups[-1][1] <= gap:
            groups[-1][1] = p
        else:
            groups.append([p, p])
    return [(a, b) for a, b in groups]


def find_items(items: Items, data: np.ndarray, offsets: np.ndarray, share: float) -> list[tuple[int, int, int, int]]:
    """(row, item number, edits, word): every item found in each text, with its fewest edits."""
    w = words(data, offsets)
    n = len(offsets) - 1
    count = np.diff(w.first)
    begin = w.first[:-1] + np.arange(n)  # a 0 follows each text
    symbols = np.zeros(len(w.hashes) + n, np.uint64)
    symbols[np.arange(len(w.hashes)) + w.doc] = np.maximum(w.hashes, np.uint64(1))
    stride, multipliers = items.layout.stride, items.layout.multipliers
    windows = -(-count // stride)
    row = np.repeat(np.arange(n), windows)
    if not len(row):
        return []
    at = begin[row] + (np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)) * stride
    seen = set()
    for walk, samples in enumerate(items.layout.samples):
        for i, key in enumerate(_walked(symbols, at, multipliers[walk], samples)):
            key += np.uint64(walk * 1000 + i)
            hit = np.flatnonzero(items.bitmap[key >> np.uint64(64 - BITMAP_BITS)])
            low, high = np.searchsorted(items.keys, key[hit], "left"), np.searchsorted(items.keys, key[hit], "right")
            for h, a, b in zip(hit[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                for e in range(a, b):
                    item, offset = items.entries[e]
                    seen.add((int(row[h]), int(item), int(at[h] - begin[row[h]] - offset)))
    found: dict[tuple[int, int], tuple[int, int]] = {}
    sets = {item: set(items.symbols[item].tolist()) for item in {c[1] for c in seen}}  # a missing word is an edit at least
    for (r, item), starts in groupby(sorted(seen), lambda c: c[:2]):
        own = items.symbols[item]
        allowed = int(share * len(own) + 1e-9)
        text = symbols[begin[r] : begin[r] + count[r]]
        at = [c[2] for c in starts]
        exact = next((p for p in at if p >= 0 and np.array_equal(text[p : p + len(own)], own)), None)
        if exact is not None:
            found[r, item] = (0, exact)
            continue
        for first, last in _close(at, allowed) if allowed else ():
            low, high = max(0, first - allowed), min(int(count[r]), last + len(own) + allowed)
            if high - low >= len(own) - allowed and len(sets[item].difference(text[low:high].tolist())) <= allowed:
                edits = least_edits(own, text[low:high])
                if edits <= allowed and ((r, item) not in found or edits < found[r, item][0]):
                    found[r, item] = (edits, max(0, first))
    return [(r, item, edits, place) for (r, item), (edits, place) in found.items()]


def _with_words(given: DataFrame) -> DataFrame:
    """(id, text, words) of the items that have a word. A stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(s) for s in _symbols(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["id", "text", "words"])

    return stored(given.mapInArrow(run, "id long, text string, words long").where("words > 0"), "items")


def _blocks(items: DataFrame, id_col: str, text_col: str) -> list[tuple[DataFrame, Layout]]:
    """All items in blocks whose index takes about ``BLOCK_BYTES``, or twice that; an item that is larger is alone."""
    given = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text")).where("text IS NOT NULL").distinct()
    rows = _with_words(given)
    least = rows.agg(F.min("words")).first()[0]
    if least is None:
        return []
    top = size_class(1 << 40, least)
    classes = rows.select(F.least(F.length(F.bin(F.floor(F.col("words") / least).cast("long"))) - 1, F.lit(top)).alias("c")).distinct().collect()
    layout = make_layout(least, sorted(r["c"] for r in classes))
    size = 8 * F.col("words") + 24 * WALKS * SAMPLES * F.least("words", F.lit(RUNS * layout.stride))
    n = max(1, -(-rows.agg(F.sum(size)).first()[0] // BLOCK_BYTES))
    while True:
        block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
        sums = rows.groupBy(block.alias("b")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"))
        if sums.where((F.col("n") > 1) & (F.col("size") > 2 * BLOCK_BYTES)).isEmpty():
            break
        n *= 2
    return [(rows.where(block == r["b"]), layout) for r in sums.select("b").orderBy("b").toLocalIterator()]


def _indexed(block: tuple[DataFrame, Layout]) -> Items:
    rows = block[0].orderBy("id", "text").collect()  # bounded by the size of a block
    return prepare_items([r["id"] for r in rows], [r["text"] for r in rows], block[1])


def _each_slice(batch: pa.RecordBatch, items: Items, share: float) -> Iterator[tuple[int, int, int, int]]:
    data, offsets = string_buffers(batch.column(batch.num_columns - 1))
    for a, b in slices(offsets):
        for r, item, edits, place in find_items(items, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], share):
            yield a + r, item, edits, place


def _found_in(given: DataFrame, block: tuple[DataFrame, Layout], share: float) -> DataFrame:
    """(id, item_id, edits, word) of each item of the block found in (id, text)."""
    index = _indexed(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = list(_each_slice(batch, index, share))
            at = pa.array([h[0] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(at), pa.array([index.ids[h[1]] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.int32()), pa.array([h[3] for h in hits], pa.int64()),
            ], names=["id", "item_id", "edits", "word"])

    return given.mapInArrow(run, "id long, item_id long, edits int, word long")


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """(id, item_id, edits, word): one row for each row of ``docs`` and item that occurs in it
    with at most ``share`` of its words edited; the fewest edits, and about where.

    NULL and empty texts, and items without a word, are never found. Repeated rows and items
    are reported each. Items are indexed in blocks of ``BLOCK_BYTES``, each of which takes a pass over
    all documents; with more than one block each pass is stored, so one index is held at a time.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"))
    blocks = _blocks(items, item_id, item_text)
    parts = [_found_in(given, b, share) if len(blocks) == 1 else stored(_found_in(given, b, share), "found") for b in blocks]
    return reduce(DataFrame.unionByName, parts, docs.sparkSession.createDataFrame([], "id long, item_id long, edits int, word long"))


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns kept.

    One block of items is looked for in place. With more, rows are told by two hashes of their
    text: those found are stored block by block and then left out.
    """
    small_batches(docs.sparkSession)
    text = F.lower(F.col(f"`{text_col}`").cast("string"))
    blocks = _blocks(items, item_id, item_text)
    if not blocks:
        return docs
    if len(blocks) > 1:
        if clash := set(_HASHES) & set(docs.columns):
            raise ValueError(f"columns of these names are needed here: {sorted(clash)}")
        hashes = [F.xxhash64(text).alias(_HASHES[0]), F.xxhash64(F.lit("again"), text).alias(_HASHES[1])]
        given = docs.select(*hashes, text.alias("text"))
        found = [stored(_rows_found(given, b, share), "found") for b in blocks]
        hit = stored(reduce(DataFrame.unionByName, found).distinct(), "contaminated")
        return lookup_join(docs.select("*", *hashes), hit, list(_HASHES), "left_anti").select(*[f"`{c}`" for c in docs.columns])
    if _TEXT in docs.columns:
        raise ValueError(f"a column of this name is needed here: {_TEXT}")
    index = _indexed(blocks[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[h[0] for h in _each_slice(batch, index, share)]] = False
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(keep))

    return docs.withColumn(_TEXT, text).mapInArrow(run, docs.schema)


def _rows_found(given: DataFrame, block: tuple[DataFrame, Layout], share: float) -> DataFrame:
    """The hashes of the texts in which some item of the block is found."""
    index = _indexed(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array(sorted({h[0] for h in _each_slice(batch, index, share)}), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in _HASHES], names=list(_HASHES))

    return given.mapInArrow(run, ", ".join(f"{c} long" for c in _HASHES)).distinct()

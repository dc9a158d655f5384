"""Document fingerprints: MinHash over runs of five words, in vectorised numpy.

The shingles of a text are hashed runs of five words (a shorter text is one run, one without words its bytes).
A permutation is a multiplication with an odd number and an addition, modulo 2^64; for each
of them a text keeps sixteen bits of its least shingle. The fingerprint is these in hex, and the likeness of two is the share
of equal places, an estimate of the Jaccard similarity of the shingle sets.

``similar_classes`` cuts fingerprints into bands that Spark joins and verifies what meets by the Jaccard
similarity of the sets. ``edit_report`` compares each text with an edited one and with its successor: texts are
dealt out once, in ranges of their order, and the first text of a range goes along with the range before.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.llm.components import component_labels
from capledger.llm.text import SLICE_BYTES, mix, slices, small_batches, string_buffers, words
from capledger.operators.bounded import split_join
from capledger.sources.scratch import stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 5
PERMUTATIONS = BANDS * ROWS
LEAST_BLOCK = 1_000  # texts in a range, at least
_FACTORS, _TERMS = np.random.default_rng(12).integers(1, 1 << 63, (2, PERMUTATIONS), dtype=np.uint64) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts, where those of each text begin); a text has one at least."""
    w = words(data, offsets)
    count = np.diff(w.first)
    runs = np.maximum(count - k + 1, 1)
    begin = np.r_[0, np.cumsum(runs)]
    doc = np.repeat(np.arange(len(runs)), runs)
    place = np.arange(begin[-1]) - begin[doc]
    padded = np.r_[w.hashes, np.zeros(k, np.uint64)]
    at, left = place + w.first[doc], count[doc] - place
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out = mix(out + np.where(j < left, padded[at + j], np.uint64(0)), j + 1)
    for i in np.flatnonzero(count == 0):
        raw = data[offsets[i] : offsets[i + 1]].tobytes()
        out[begin[i]] = int.from_bytes(blake2b(raw, digest_size=8).digest(), "little")
    return out, begin


def signatures(symbols: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of sixteen-bit values for each text."""
    least = np.empty((len(begin) - 1, PERMUTATIONS), np.uint64)
    if len(least):
        for p in range(PERMUTATIONS):
            least[:, p] = np.minimum.reduceat(symbols * _FACTORS[p] + _TERMS[p], begin[:-1])
    return (mix(least, 3) >> np.uint64(48)).astype(np.uint16)


def _sets(symbols: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    return [np.unique(symbols[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; both are never empty."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _hex(signature: np.ndarray) -> list[str]:
    raw = signature.astype(">u2").tobytes().hex()
    size = PERMUTATIONS * 4
    return [raw[i * size : (i + 1) * size] for i in range(len(signature))]


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for a, b in slices(offsets):
            symbols, begin = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            signature = signatures(symbols, begin)
            sets = _sets(symbols, begin)
            node = [int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0)[a:b], pa.array(node, pa.int64()), pa.array(_hex(signature)), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], names=["id", "node", "fingerprint", "size", "shingles"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, node, fingerprint, size, shingles) of each row; texts with equal shingle sets have one node and one fingerprint.

    A NULL text is an empty one. Case does not matter.
    """
    small_batches(docs.sparkSession)
    text = F.lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    given = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(_fingerprinted, f"id {kind}, node long, fingerprint string, size int, shingles binary")


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(v, np.uint64) for v in batch.column(i).to_pylist()] for i in (2, 3))
            keep = [jaccard(a, b) >= similarity - 1e-12 for a, b in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    left = nodes.select(F.col("node").alias("u"), F.col("shingles").alias("left"))
    right = nodes.select(F.col("node").alias("v"), F.col("shingles").alias("right"))
    return pairs.join(left, "u").join(right, "v").select("u", "v", "left", "right").mapInArrow(_verify(similarity), "u long, v long")


def similar_classes(prints: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id) of each row of ``fingerprints``: the least id that verified links reach.

    Texts of a band meet its leader. Where a band still holds several components, the texts outside its largest
    one meet those of the other components whose sizes allow the similarity. One of 30,000 pairs at exactly 0.8
    shares no band. NULL ids never name a class unless all its ids are NULL.
    """
    rows = stored(prints, "prints")
    nodes = stored(rows.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("fingerprint", "size", "shingles")]), "nodes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("fingerprint", i * 4 * ROWS + 1, F.lit(4 * ROWS))))
    met = nodes.select("node", "size", F.explode(bands).alias("band"))
    leaders = met.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader"), F.min_by("size", "node").alias("leader_size")).where("n > 1")
    members = stored(met.join(leaders.drop("n"), "band"), "members")

    def alike(a, b):
        return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity - 1e-9)

    led = members.where(alike("size", "leader_size") & (F.col("node") != F.col("leader"))).select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    links = stored(_verified(led, nodes, similarity), "links")
    labels = stored(component_labels(links), "labels")
    placed = members.select("band", "node", "size").join(labels, "node", "left").select("band", "node", "size", F.coalesce("component", "node").alias("component"))
    parts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    again = stored(placed.join(mixed.select("band", "main"), "band"), "again")
    outside = again.where("component <> main").select("band", *[F.col(c).alias(f"o_{c}") for c in ("node", "size", "component")])
    rest = outside.join(again, "band").where((F.col("o_component") != F.col("component")) & alike("o_size", "size"))
    rest = rest.select(F.greatest("o_node", "node").alias("u"), F.least("o_node", "node").alias("v")).distinct()
    more = stored(_verified(rest, nodes, similarity), "more-links")
    if not more.isEmpty():
        labels = stored(component_labels(links.unionByName(more)), "labels")
    named = stored(rows.select("id", "node").join(labels, "node", "left").select("id", F.coalesce("component", "node").alias("component")), "placed")
    least = named.groupBy("component").agg(F.min("id").alias("class_id"))
    return split_join(named, least, ["component"], "inner").select("id", "class_id")


# Texts in ranges of their order


def _key(id_, digest) -> tuple:
    return (False, digest) if id_ is None else (True, id_, digest)


def _range_starts(docs: DataFrame) -> list[tuple]:
    """The first key of each range, as many as there are partitions to fill."""
    keys = stored(docs.select("id", "digest"), "keys")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(partitions, keys.count() // LEAST_BLOCK))
    first = keys.repartitionByRange(n, "id", "digest").groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "digest")).alias("k"))
    return sorted({_key(r["k"]["id"], r["k"]["digest"]) for r in first.collect()})


def _dealt(starts: list[tuple]):
    """Each text with the number of its range; the first one of a range also as a guest of the range before, that of all as guest of the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, digests = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = [_key(i, d) for i, d in zip(ids, digests, strict=True)]
            block = [bisect_right(starts, k) - 1 for k in keys]
            guests = [i for i, (k, b) in enumerate(zip(keys, block, strict=True)) if starts[b] == k]
            take = pa.array([*range(len(keys)), *guests], pa.int64())
            packed = pa.array([packer.compress(t or b"") for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(block + [(block[i] - 1) % len(starts) for i in guests], pa.int32()),
                pa.array([False] * len(keys) + [True] * len(guests)),
                batch.column(0).take(take), batch.column(1).take(take), packed.take(take),
            ], names=["block", "guest", "id", "digest", "text"])

    return run


_REPORT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def _compared(ids: list, texts: list[str], following: list[str], kind: pa.DataType) -> pa.RecordBatch:
    def shingled(values: list[str]):
        joined = pa.array([v.lower() for v in values], pa.string())
        symbols, begin = shingles(*string_buffers(joined))
        return signatures(symbols, begin), _sets(symbols, begin)

    edited = []
    for text, after in zip(texts, following, strict=True):
        k = len(text) // 4
        edited.append(text[: len(text) - k] + after[:k])
    # The successor of a text is mostly the next text of this list.
    own, own_sets = shingled([*texts, following[-1]])
    changed, changed_sets = shingled(edited)
    out = [i for i in range(len(texts) - 1) if following[i] is not texts[i + 1]]
    after, after_sets = own[1:].copy(), own_sets[1:]
    if out:
        after[out], sets = shingled([following[i] for i in out])
        for i, s in zip(out, sets, strict=True):
            after_sets[i] = s
    own, own_sets = own[: len(texts)], own_sets[: len(texts)]
    return pa.RecordBatch.from_arrays([
        pa.array(ids, kind), pa.array([len(t) for t in texts], pa.int64()), pa.array([sha256(t.encode()).hexdigest() for t in edited]),
        pa.array(_hex(own)), pa.array(_hex(changed)), pa.array(_likeness(own, changed)), pa.array(_likeness(own, after)),
        pa.array([jaccard(a, b) for a, b in zip(own_sets, changed_sets, strict=True)]), pa.array([jaccard(a, b) for a, b in zip(own_sets, after_sets, strict=True)]),
    ], names=["id", *[c.split()[0] for c in _REPORT.split(", ")]])


def _reported(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        ids, texts, following, size = [], [], [], 0
        last = None  # (block, id, text) of a row whose successor comes next
        for batch in batches:
            for block, guest, id_, packed in zip(*[batch.column(c).to_pylist() for c in ("block", "guest", "id", "text")], strict=True):
                text = unpacker.decompress(packed).decode("utf-8", "replace") if last is None or last[0] == block or not guest else ""
                if last is not None and last[0] == block:
                    ids.append(last[1])
                    texts.append(last[2])
                    following.append(text)
                    size += len(last[2])
                    if size >= SLICE_BYTES:
                        yield _compared(ids, texts, following, kind)
                        ids, texts, following, size = [], [], [], 0
                # Of the guests only the first one counts; none is a text of this range.
                last = None if guest else (block, id_, text)
        if ids:
            yield _compared(ids, texts, following, kind)

    return run


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, jaccard_edited, jaccard_next).

    The last quarter of each text, in code points, is replaced by as many of the next one's first, and both are compared with it: ``near``
    by fingerprints, ``jaccard`` by the sets themselves. Texts follow each other by id, NULL first, those of one id
    by a hash of the text, and the first follows the last; a single text follows itself. A NULL text is an empty one.
    """
    small_batches(docs.sparkSession)
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(raw).alias("digest"), raw.cast("binary").alias("text"))
    kind = given.schema["id"].dataType
    starts = _range_starts(given)
    if not starts:
        return docs.sparkSession.createDataFrame([], f"id {kind.simpleString()}, {_REPORT}")
    dealt = given.mapInArrow(_dealt(starts), f"block int, guest boolean, id {kind.simpleString()}, digest long, text binary")
    ordered = dealt.repartitionById(len(starts), "block").sortWithinPartitions("block", "guest", "id", "digest")
    from pyspark.sql.pandas.types import to_arrow_type

    return ordered.mapInArrow(_reported(to_arrow_type(kind)), f"id {kind.simpleString()}, {_REPORT}")

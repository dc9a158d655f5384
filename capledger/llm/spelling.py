"""Spelling variants: words within one edit of each other, found on a trie that is a table.

The words of a corpus form a trie whose nodes are stored as edges (node, label, child). Chains
without a branch are one edge, so a very long word has few of them. A frontier of states
(word, position, node, edits) is joined with the edges level by level: a state without an edit
follows its own edge, or spends its edit on another one by leaving out a letter of the word or by
putting the edge's letter in its place; a state with an edit follows only the edge that spells its
word. What ends on a word after one edit is a neighbour. An inserted letter is a left out one
seen from the other side, and two spellings part at a node of the trie, so no other transition is needed.

Near the root each node has many children, near the ends few. One edit leaves one half of a word as
it is, so a state starts where the first half of its word ends, and the edits of that half are
found on a second trie, of the words read backwards. Both are in one table, and no node
has more words below it than share half of their letters.

Nodes are named by a 64-bit hash of their prefix. Equal hashes of different prefixes would
only join two nodes: that adds states and loses none, and each pair is checked at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capledger.llm.text import hash_runs, mix
from capledger.operators.bounded import fits
from capledger.sources.scratch import stored

LETTERS = "[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
FORM_FACTOR = 5
EDIT_EVERY = 199

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORD = "word string, way int, first int, twin long, id long"
_AT = "id long, twin long, start boolean, depth int, node long, head int"
_END = -1  # in the place of a next letter


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, edit_every: int | None = EDIT_EVERY,
                least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters up to U+00FF, capitals A to Z lowered, that are long and frequent enough.

    One in ``edit_every`` pairs of id and run, as the crc32 of ``<id>:<run>`` tells, loses a
    letter (None: none does). NULL texts have no runs, a NULL id is an empty one.
    """
    lowered = F.translate(F.col(f"`{text_col}`").cast("string"), _CAPITALS, _CAPITALS.lower())
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(LETTERS), F.lit(0))).alias("run"))
    word = F.col("run")
    if edit_every is not None:
        runs = runs.where(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % edit_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each letter of all words, which reach up to U+00FF, and where each word begins."""
    words = column.to_pylist()
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8), np.r_[0, np.cumsum([len(w) for w in words], dtype=np.int64)]


def _nodes(data: np.ndarray, start: np.ndarray, end: np.ndarray, way: np.ndarray) -> np.ndarray:
    return (hash_runs(data, start, end) ^ mix(way.astype(np.uint64), 1)).view(np.int64)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, begin = _letters(batch.column("word"))
        node = _nodes(data, begin[:-1], begin[1:], batch.column("way").to_numpy())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node)], names=[*batch.schema.names, "id"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of each word from its first half on, with the letter that follows."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            data, begin = _letters(part.column("word"))
            first = part.column("first").to_numpy()
            count = np.diff(begin) - first + 1
            word = np.repeat(np.arange(len(count)), count)
            depth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + first[word]
            at = begin[word] + depth
            head = np.where(at < begin[word + 1], np.r_[data, np.uint8(0)][at].astype(np.int32), _END)
            node = _nodes(data, begin[word], at, part.column("way").to_numpy()[word])
            ids, twins = part.column("id").to_numpy(), part.column("twin").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[word]), pa.array(twins[word]), pa.array(depth == first[word]), pa.array(depth.astype(np.int32)), pa.array(node), pa.array(head)],
                                             names=["id", "twin", "start", "depth", "node", "head"])


def trie_paths(words: DataFrame) -> DataFrame:
    """Each of ``words`` (word, way, first, twin, id) with its path (depth, node, ends): the nodes it
    passes from depth ``first`` on where words begin, part or end."""
    prefixes = stored(words.mapInArrow(_prefixes, _AT), "prefixes")
    nodes = prefixes.groupBy("node").agg(F.min("head").alias("least"), F.max("head").alias("most"), F.max("start").alias("start"))
    kept = nodes.where(f"start OR least = {_END} OR least <> most").select("node", (F.col("least") == _END).alias("ends"))
    on_path = prefixes.select("id", "twin", "depth", "node").join(kept, "node")
    paths = on_path.groupBy("id", "twin").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "ends"))).alias("path"))
    return words.join(paths, ["id", "twin"])


def trie_edges(paths: DataFrame) -> DataFrame:
    """(node, head, label, child, ends): the edges of all paths. ``head`` is the first letter of the label,
    ``ends`` tells that a word ends at the child."""

    def edge(i):
        came, to = F.get("path", i), F.get("path", i + 1)
        letters = F.substring("word", came["depth"] + 1, to["depth"] - came["depth"])
        return F.struct(came["node"].alias("node"), F.substring(letters, F.lit(1), F.lit(1)).alias("head"), letters.alias("label"), to["node"].alias("child"), to["ends"].alias("ends"))

    steps = F.when(F.size("path") > 1, F.sequence(F.lit(0), F.size("path") - 2))
    return paths.select(F.inline(F.transform(steps, edge))).distinct()


def _edited_late(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(word, way, other): what each word of ``trie_paths`` becomes as another one when one letter is left out
    or replaced, not before its path begins.

    The frontier goes on until it is empty, as many levels as nodes lie on one path.
    """
    small = fits(edges)
    left, next_letter = F.length("word") - F.col("position"), F.substring("word", F.col("position") + 1, F.lit(1))
    size = F.length("label")

    def rest(skip, length):
        return F.substring("word", F.col("position") + skip + 1, length)

    def state(condition, moved, edits, at, put):
        return F.when(condition, F.struct((F.col("position") + moved).alias("position"), F.col("child").alias("node"), edits.alias("edits"),
                                          at.alias("at"), put.alias("put"), F.col("ends").alias("ends")))

    # ``at`` and ``put``: the letter that is edited, and what stands there instead; the last one goes unless another is edited.
    own = F.col("head") == next_letter
    spelled = F.array_compact(F.array(state(rest(0, size) == F.col("label"), size, F.col("edits"), F.col("at"), F.col("put"))))
    edited = F.array_compact(F.array(
        state((left > size) & (rest(1, size) == F.col("label")), size + 1, F.lit(1), F.col("position"), F.lit("")),
        state((left >= size) & (rest(1, size - 1) == F.substring("label", F.lit(2), size - 1)), size, F.lit(1), F.col("position"), F.col("head")),
    ))
    start = {"position": F.get("path", F.lit(0))["depth"], "node": F.get("path", F.lit(0))["node"], "edits": F.lit(0),
             "at": F.length("word") - 1, "put": F.lit(""), "ends": F.get("path", F.lit(0))["ends"]}
    level = paths.select("word", "way", *[c.alias(name) for name, c in start.items()])
    found = []
    while True:
        # A word that ends here after one edit, or one letter short of this one.
        found.append(level.where(F.col("ends") & (left + F.col("edits") == 1)).select("word", "way", "node", "at", "put"))
        frontier = level.where(left > 0)
        if frontier.isEmpty():
            break
        met = frontier.drop("ends").join(F.broadcast(edges) if small else edges, "node").where(own | (F.col("edits") == 0))
        level = stored(met.select("word", "way", F.inline(F.when(own, spelled).otherwise(edited))), "frontier")
    others = paths.select(F.col("id").alias("node"), "way", F.col("word").alias("other"))
    spelling = F.concat(F.substring("word", F.lit(1), F.col("at")), "put", F.substring("word", F.col("at") + 2, F.length("word")))
    return reduce(DataFrame.unionByName, found).join(others, ["node", "way"]).where(F.col("other") == spelling).select("word", "way", "other")


def one_edit_pairs(words: DataFrame) -> DataFrame:
    """(word, other): each of the distinct words of ``words`` with every one that differs by one inserted, deleted or replaced letter."""
    half = F.floor(F.length("word") / 2).cast("int")
    both = words.select(F.inline(F.array(F.struct("word", F.lit(0).alias("way"), half.alias("first")),
                                         F.struct(F.reverse("word").alias("word"), F.lit(1).alias("way"), (F.length("word") - half).alias("first")))))
    named = stored(both.withColumn("twin", F.xxhash64("word", "way")).mapInArrow(_named, _WORD), "words")
    paths = stored(trie_paths(named), "paths")
    pairs = _edited_late(paths, stored(trie_edges(paths), "edges"))
    pairs = pairs.select(*[F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c) for c in ("word", "other")])
    longer = pairs.where(F.length("word") > F.length("other"))
    return pairs.unionByName(longer.select(F.col("other").alias("word"), F.col("word").alias("other"))).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms of ``forms`` (word, form) lead to in the end. A form is
    several times more frequent than its word, so paths are short; each round doubles what a step spans."""
    roots = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = stored(roots.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        roots = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return roots


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, factor: int = FORM_FACTOR, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``docs``; ``options`` as for ``word_counts``.

    A word's form is the most frequent of its neighbours (ties: the first in code-point order) if it is
    ``factor`` times as frequent, else NULL; its root is where forms lead to in the end, itself
    without a form. NULL and empty texts and empty tables give no words, repeated rows
    count each time, other columns are not read.
    """
    words = stored(word_counts(docs, id_col, text_col, **options), "counts")
    pairs = one_edit_pairs(words)
    near = pairs.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    good = F.col("best.minus") * -1 >= F.col("n") * factor
    known = words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n"))
    known = stored(known, "forms")
    roots = _roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

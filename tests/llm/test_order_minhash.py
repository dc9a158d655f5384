import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from capledger.llm.order_minhash import near_duplicate_classes, ordered_similarity, without_near_duplicates
from capledger.llm.text import BATCH_BYTES, small_batches

SCHEMA = "node string, doc_id long, text string, class_id int, key int"


def _shingles(text):
    words, seen, out = re.findall(r"[^\W_]+", text.lower()), Counter(), []
    for i in range(max(1, len(words) - 4)) if words else []:
        run = tuple(words[i : i + 5])
        out.append((run, seen[run]))
        seen[run] += 1
    return out


def _similarity(a, b):
    """Longest common subsequence of labelled runs, by the plain table."""
    if not a or not b:
        return 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b) - row[-1])


def _classes(rows):
    """Least id of the connected texts; equal words are equal, as are equal texts without words."""
    made = [(_shingles(t), t.lower()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            (a, x), (b, y) = made[i], made[j]
            if (a and a == b) or (not a and not b and x == y) or (a and b and _similarity(a, b) >= 0.8 - 1e-12):
                parent[find(i)] = find(j)
    groups = {}
    for i, (n, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(n)
    return sorted((n, min(groups[find(i)])) for i, (n, _) in enumerate(rows))


def _corpus():
    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdefghij", k=4)) for _ in range(300)]
    passage = r.choices(vocabulary, k=25)
    rows = []
    for base in range(12):
        words = r.choices(vocabulary, k=r.choice([4, 9, 60, 90]))
        for copy in range(r.choice([1, 2, 6])):
            own = list(words)
            for _ in range(copy):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            rows.append(" ".join(own + (passage if base % 3 == 0 else [])))
    rows += ["", "", "?!", "?!", "!", "One", "one.", "one two", rows[5].upper(), rows[5], "x " * 3000, "x " * 2950 + "y"]
    return [(i, t) for i, t in enumerate(rows)]


def test_classes_agree_with_all_pairs(spark):
    rows = _corpus()
    docs = spark.createDataFrame([("a", n, t, 1, 2) for n, t in rows], SCHEMA).repartition(3)
    got = near_duplicate_classes(docs).collect()
    assert sorted((r["id"], r["class_id"]) for r in got) == _classes(rows)


def test_mixed_sketches_are_settled_exactly(spark):
    """Copies of one text with so many edits each that some are alike and others are not."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        own = list(base)
        for at in r.sample(range(150), r.choice([1, 1, 2, 3, 5])):
            own[at] = f"e{i}x{at}"
        rows.append((i, " ".join(own)))
    got = near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["id"], x["class_id"]) for x in got) == _classes(rows)


def test_nulls_and_repeats(spark):
    docs = spark.createDataFrame([
        ("a", None, "same words here", 1, 1), ("a", 7, "Same words, here", 1, 1), ("a", 7, "Same words, here", 1, 1), ("a", 8, None, 1, 1),
        ("a", 8, "other", 1, 1), ("a", None, None, 1, 1), (None, 9, "same words here", None, None),
    ], SCHEMA)
    got = sorted(((r["id"], r["class_id"], r["n_texts"], r["n_rows"]) for r in near_duplicate_classes(docs).collect()), key=str)
    assert got == sorted([(None, 7, 1, 4), (7, 7, 1, 4), (7, 7, 1, 4), (8, 8, None, 1), (8, 8, 1, 1), (None, None, None, 1), (9, 7, 1, 4)], key=str)
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(7, "Same words, here"), (8, None), (8, "other"), (None, None)], key=str)


def test_ids_that_are_null_or_head_another_class(spark):
    docs = spark.createDataFrame([("a", i, t, 1, 1) for i, t in [(None, "x y"), (None, "x y"), (5, "x y"), (3, "x y"), (3, "p q"), (2, "p q"), (None, "lone"), (None, "lone")]], SCHEMA)
    assert sorted(((r["doc_id"], r["text"]) for r in without_near_duplicates(docs).collect()), key=str) == [(2, "p q"), (3, "x y"), (None, "lone")]
    with pytest.raises(ValueError):
        without_near_duplicates(docs.withColumnRenamed("n", "__near_id") if "n" in docs.columns else docs.withColumn("__near_id", docs["doc_id"]))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicate_classes(docs).collect() == []
    assert without_near_duplicates(docs).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_band_loses_no_similar_pair(seed):
    r = random.Random(seed)
    a = r.sample(range(1000), 80)
    b = [x for x in a if r.random() > 0.05]
    b[3:3] = r.sample(range(2000, 3000), r.choice([0, 2, 6]))
    b[10], b[40] = b[40], b[10]
    want = _similarity(a, b)
    got = ordered_similarity(np.array(a, np.uint64), np.array(b, np.uint64), 0.8)
    assert got == pytest.approx(want) if want >= 0.8 else got <= want + 1e-12


def test_batches_of_long_texts_are_bounded_by_their_size(spark):
    small_batches(spark)
    long = spark.range(0, 64, 1, 1).selectExpr("repeat('ab', 1 << 19) AS text")  # 64 MB

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    sizes = [r["n"] for r in long.mapInArrow(rows, "n long").collect()]
    assert len(sizes) >= 3 and max(sizes) <= BATCH_BYTES + (2 << 20)
    small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)


def test_symbol_counts_reach_the_driver_as_columns(spark):
    import tracemalloc

    from capledger.llm.order_minhash import SLOTS, _frequencies

    words = np.random.default_rng(3).integers(0, 1 << 32, 600_000, dtype=np.uint32).reshape(600, 1000)
    texts = spark.createDataFrame([(w.tobytes(),) for w in words], "words binary")
    tracemalloc.start()
    counts = _frequencies(texts, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(counts) == SLOTS and counts.sum() == 600 * 996 and (counts > 0).sum() > 200_000
    assert peak < 16 << 20, peak  # one row object for each slot takes several times as much

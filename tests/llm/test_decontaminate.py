import random
import re

from capledger.llm import decontaminate
from capledger.llm.decontaminate import EDIT_SHARE, RUNS, contaminations, entered_offsets, least_edits, without_contaminated
import numpy as np
import pytest

SCHEMA = "doc_id long, text string, item_id long, edits int"


def _words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _least(item, text):
    """Fewest edits of the item against any run of the text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def _edited(r, words, n, vocabulary):
    out = list(words)
    for _ in range(n):
        at, kind = r.randrange(len(out)), r.randrange(3)
        out[at : at + (kind != 1)] = [] if kind == 0 else [r.choice(vocabulary)]
    return out


def _corpus(seed=1, copies=3):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.choice([2, 4, 5]))) for _ in range(400)]
    items = [(100 + i, r.choices(vocabulary, k=n)) for i, n in enumerate([15, 18, 22, 30, 35, 40, 47, 55] * 3)]
    docs = []
    for n, words in items:
        for _ in range(copies):
            allowed = int(EDIT_SHARE * len(words))
            own = _edited(r, words, r.randrange(allowed + 3), vocabulary)
            docs.append(r.choices(vocabulary, k=r.randrange(60)) + own + r.choices(vocabulary, k=r.randrange(60)))
    docs += [r.choices(vocabulary, k=100) for _ in range(30)]
    return items, [(i, " ".join(d)) for i, d in enumerate(docs)]


def test_recall_of_edited_items(spark):
    items, docs = _corpus(copies=6)
    want = {}
    for d, text in docs:
        for n, words in items:
            edits = _least(words, text.split())
            if edits <= int(EDIT_SHARE * len(words)):
                want[d, n] = edits
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {(r["id"], r["item_id"]): r["edits"] for r in contaminations(frame, spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")).collect()}
    assert got.items() <= want.items()  # nothing that an alignment does not confirm
    exact = {k for k, e in want.items() if e == 0}
    assert exact <= got.keys() and len(exact) > 5
    edited = want.keys() - exact
    assert len(edited) > 40 and len(edited & got.keys()) >= 0.9 * len(edited)


@pytest.mark.parametrize("n", [64, 200, 400, 1000])
def test_recall_of_long_items(spark, n):
    r = random.Random(n)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(3000)]
    items = [(i, r.choices(vocabulary, k=n)) for i in range(40)] + [(99, r.choices(vocabulary, k=14))]
    docs = [(i, " ".join(r.choices(vocabulary, k=r.randrange(40)) + _edited(r, w, n // 10, vocabulary) + r.choices(vocabulary, k=9))) for i, w in items[:-1]]
    found = contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(row["id"], row["item_id"]): row["edits"] for row in found.collect()}
    assert all(a == b and e <= n // 10 for (a, b), e in got.items()) and len(got) >= 38


def test_items_in_many_blocks_are_found_alike(spark, monkeypatch):
    items, docs = _corpus(copies=2)
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    frame = spark.createDataFrame([*docs, (None, docs[0][1].upper()), (9, None)], "doc_id long, text string")
    whole = sorted(map(tuple, contaminations(frame, bench).collect()), key=str)
    kept = sorted(map(tuple, without_contaminated(frame, bench).collect()), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60_000)
    assert len(decontaminate._blocks(bench, "item_id", "text")) > 4
    assert sorted(map(tuple, contaminations(frame, bench).collect()), key=str) == whole
    assert sorted(map(tuple, without_contaminated(frame, bench).collect()), key=str) == kept and (9, None) in kept


def test_a_very_long_item_is_entered_at_a_bounded_number_of_places():
    for n in (200, 20_000, 10**6):
        at = entered_offsets(n, 50, 8)
        assert len(at) <= RUNS * 8 and at[0] == 0 and at[-1] == n - 50
    assert entered_offsets(59, 50, 7).tolist() == list(range(10))


def test_odd_rows(spark):
    items, _ = _corpus()
    text = " ".join(items[3][1])
    bench = spark.createDataFrame([(n, " ".join(w), 1) for n, w in items] + [(1, None, 1), (2, "", 1), (3, "?!", 1), (103, text, 1), (None, "a quite different item of some words", 1)], "item_id long, text string, doc_id int")
    docs = spark.createDataFrame([
        (1, None, 1, 1), (2, "", 1, 1), (3, text, 1, 1), (3, text, 1, 1), (None, f"x {text.upper()}!", 1, 1), (5, "pad " * 60_000 + text, 1, 1),
        (6, " ".join(f"{w}&&&" for w in text.split()), None, None), (7, "a quite different item of some words", 1, 1), (8, text[: len(text) // 2], 1, 1),
    ], SCHEMA)
    got = sorted(((r["id"], r["item_id"], r["edits"]) for r in contaminations(docs, bench).collect()), key=str)
    assert got == sorted([(3, 103, 0), (3, 103, 0), (None, 103, 0), (5, 103, 0), (6, 103, 0), (7, None, 0)], key=str)
    kept = without_contaminated(docs, bench)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [1, 2, 8]
    assert contaminations(docs.limit(0), bench).collect() == [] == contaminations(docs, bench.limit(0)).collect()
    assert without_contaminated(docs, bench.limit(0)).count() == 9


@pytest.mark.parametrize("seed", range(4))
def test_alignment(seed):
    r = random.Random(seed)
    a, b = r.choices(range(5), k=9), r.choices(range(5), k=30)
    assert least_edits(np.array(a, np.uint32), np.array(b, np.uint32)) == _least(a, b)

import hashlib
import random

import pytest

from capledger.llm import fingerprints as P

SCHEMA = "doc_id long, text string, id long, node string, block int"


def _set(text):
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    if not words:
        return {text.lower()}
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def _jaccard(a, b):
    return len(_set(a) & _set(b)) / len(_set(a) | _set(b))


def _rows():
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 6))) for _ in range(500)]
    rows = []
    for i in range(400):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 20, 80, 400]))]
        rows.append((i * 7, " ".join(words), i, "n", None))
        if i % 9 == 0:
            for at in range(0, len(words), 97):
                words[at] = "zz"
            rows.append((i * 7 + 1, " ".join(words), i, None, 0))
    rows += [(9001, None, 0, "", 0), (9002, "", 0, "", 0), (9003, " !? ", 0, "", 0), (9003, "a", 0, "", 0), (9003, "a", 0, "", 0), (None, "once upon a time there was", 0, "", 0),
             (None, "😀" * 9, 0, "", 0), (9004, "w " * 100_000, 0, "", 0)]
    rows += [(20_000 + i, "the same text comes many times here " * 5, 0, "", 0) for i in range(300)]
    return rows


@pytest.mark.parametrize("least", [1, 30, 100_000])
def test_report_agrees_with_a_plain_walk(spark, least, monkeypatch):
    monkeypatch.setattr(P, "LEAST_BLOCK", least)
    rows = _rows()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = P.edit_report(frame).collect()
    assert len(got) == len(rows)
    # Rows of one id follow each other in either order: their results are compared as a set of what is possible.
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    by_id = {}
    for r in got:
        by_id.setdefault(r.id, []).append(r)
    for i, (doc, text, *_) in enumerate(ordered):
        if sum(o[0] == doc for o in ordered[max(0, i - 2) : i + 4]) > 1 or ordered[(i + 1) % len(ordered)][0] in (None, 9003):
            continue
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        r, = by_id[doc]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.jaccard_edited - _jaccard(text, edited)) < 1e-12 and abs(r.jaccard_next - _jaccard(text, after)) < 1e-12
        assert abs(r.near_edited - r.jaccard_edited) < 0.21 and abs(r.near_next - r.jaccard_next) < 0.21
        assert (r.fingerprint == r.edited_fingerprint) == (_set(text) == _set(edited))
    error = [r.near_edited - r.jaccard_edited for r in got]
    assert abs(sum(error) / len(error)) < 0.01
    assert len({r.fingerprint for r in got if r.id is not None and r.id >= 20_000}) == 1


def test_single_text_and_empty_table(spark):
    r, = P.edit_report(spark.createDataFrame([(4, "abcdefgh", 0, "", 0)], SCHEMA)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and r.near_next == 1.0
    empty = P.edit_report(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns[:3] == ["id", "n_chars", "edited_sha256"]


def test_names_of_any_type(spark):
    frame = spark.createDataFrame([("b", "two words"), ("a", "one"), ("ä", "3")], "doc_id string, text string")
    got = {r.id: r.edited_sha256 for r in P.edit_report(frame).collect()}
    assert got["b"] == hashlib.sha256(b"two wor3").hexdigest()


def test_classes_agree_with_all_pairs(spark):
    rows = [r for r in _rows() if r[0] is not None]
    got = {}
    for r in P.similar_classes(P.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(3))).collect():
        got.setdefault(r.id, set()).add(r.class_id)
    sets = [(r[0], _set(r[1] or "")) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                parent[find(i)] = find(j)
    want = {}
    for i, (doc, _) in enumerate(sets):
        want.setdefault(doc, set()).add(min(sets[j][0] for j in range(len(sets)) if find(j) == find(i)))
    assert got == want


def test_no_rows_have_no_classes(spark):
    assert P.similar_classes(P.fingerprints(spark.createDataFrame([], SCHEMA))).collect() == []

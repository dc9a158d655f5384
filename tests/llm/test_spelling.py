import random
import re
import zlib
from collections import Counter

import pytest

from capledger.llm.spelling import spelling_variants, word_counts

SCHEMA = "doc_id long, text string, word string, n int, node long"


def _words(rows):
    counts = Counter()
    for doc, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def _near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def _brute(rows):
    n = _words(rows)
    form, near = {}, {}
    for w in n:
        others = [o for o in n if _near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        near[w] = len(others)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def _got(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


def _rows():
    rng = random.Random(4)
    letters = "abé÷"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(300):
        text = []
        for _ in range(40):
            w = rng.choice(stems[: rng.randint(1, 60)])
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            text.append(w.capitalize() if rng.random() < 0.2 and w[0] < "z" else w)
        rows.append((i, rng.choice([" ", "-", "1", ", "]).join(text), "x", 1, 2))
    rows += [(None, "abababab " * 30, None, None, None), (1, None, "", 0, 0), (2, "", "", 0, 0), (3, "ÀÉàé ß÷× " * 9, "", 0, 0), (3, "ÀÉàé ß÷× " * 9, "", 0, 0)]
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_agrees_with_all_pairs(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr("capledger.llm.spelling.fits", lambda df: False)
    rows = _rows()
    got = _got(spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == _brute(rows)
    assert sum(r[1] is not None for r in got) > 20


def test_chains_of_forms_and_ties(spark):
    text = "abcdef " * 1300 + "abcdeg " * 250 + "abcdeh " * 250 + "abcdxg " * 40 + "abyxxg " * 7 + "abyxxgz " * 7 + "abcdx " * 9
    rows = [(7, text, "", 0, 0)]
    got = _got(spelling_variants(spark.createDataFrame(rows, SCHEMA)))
    assert got == _brute(rows) and any(r[1] != r[2] for r in got if r[1])


def test_very_long_words_take_few_levels(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    variants = [base, base[:-1], base[:50_000] + base[50_001:], base[:70_000] + "z" + base[70_001:]]
    rows = [(i * 1000 + j, v, "", 0, 0) for j, v in enumerate(variants) for i in range(7)]
    got = _got(spelling_variants(spark.createDataFrame(rows, SCHEMA), edit_every=None))
    want = {v: sum(_near(v, o) for o in variants) for v in variants}
    assert {r[0]: r[4] for r in got} == want


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []
    assert word_counts(spark.createDataFrame([], SCHEMA)).columns == ["word", "n"]

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

from capledger.llm.mixing import mix_sources, mixing_exponent

SCHEMA = "doc_id long, source string, text string, key string, n int"


def _docs(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for source, n in (("a", 120), ("b", 40), ("c", 8), (None, 20)):
        for _ in range(n):
            rows.append((len(rows), source, " ".join(["w"] * r.randrange(0, 30)), "k", 1))
    return spark.createDataFrame(rows, SCHEMA), rows


def _weights(tokens, a):
    total = sum(t**a for t in tokens.values())
    return {s: t**a / total for s, t in tokens.items()}


def _entropy(w):
    return -sum(x * math.log(x) for x in w.values())


def test_exponent_meets_its_targets(spark):
    tokens = {"a": 900, "b": 300, "c": 40}
    sources = spark.createDataFrame([(s, t) for s, t in tokens.items()], "key string, tokens long")
    target = 0.95
    a = mixing_exponent(sources, 1240, entropy=target)
    assert _entropy(_weights(tokens, a)) >= target > _entropy(_weights(tokens, a + 1e-6))
    a = mixing_exponent(sources, 1240, repetitions=2.0)
    repeats = lambda a: max(1240 * w / tokens[s] for s, w in _weights(tokens, a).items())
    assert repeats(a) <= 2.0 < repeats(a - 1e-6)
    assert mixing_exponent(sources, 1240, repetitions=50.0) == 0.0
    assert mixing_exponent(sources, 1240, repetitions=0.5) == 1.0
    assert mixing_exponent(sources, 1240, entropy=9.0) == 0.0
    assert mixing_exponent(sources, 1240, entropy=0.1) == 1.0
    assert mixing_exponent(sources, 1240, entropy=9.0, repetitions=2.0) == a


def _brute(rows, budget, exponent, block_tokens, seed="mix"):
    words = lambda t: len((t or "").split())
    key = lambda s: "~" if s is None else f"={s}"
    tokens = defaultdict(int)
    for _, s, t, *_ in rows:
        tokens[key(s)] += words(t)
    tokens = {s: t for s, t in tokens.items() if t}
    w = _weights(tokens, exponent)
    out = Counter()
    for s, total in tokens.items():
        own = math.floor(w[s] * budget)
        blocks = math.ceil(total / block_tokens)
        epochs, rest = divmod(own, total)

        def place(e, i):
            h = hashlib.md5(f"mix|{e}|{s}|{'' if i is None else i}".encode()).hexdigest()
            return h, int(h[:8], 16) * blocks // 2**32

        mine = [(i, words(t)) for i, x, t, *_ in rows if key(x) == s]
        for e in range(epochs):
            out.update((i, s, e, place(e, i)[1]) for i, _ in mine)
        so_far = 0
        groups = defaultdict(list)
        for i, n in mine:
            groups[place(epochs, i)].append((i, n))
        for (h, b), members in sorted(groups.items()):
            so_far += sum(n for _, n in members)
            if so_far > rest or not rest:
                break
            out.update((i, s, epochs, b) for i, _ in members)
    return out


@pytest.mark.parametrize("budget,exponent_of,block_tokens", [(None, {"repetitions": 1.5}, 50), (700, {}, 64), (9000, {"entropy": 1.2}, 1 << 20)])
def test_copies_agree_with_one_list(spark, budget, exponent_of, block_tokens):
    docs, rows = _docs(spark)
    rows += [rows[3], rows[3], (None, "b", "x y z", "k", 1), (900, "b", None, "k", 1), (901, "empty", "  ", "k", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    total = sum(len((t or "").split()) for _, _, t, *_ in rows)
    got = mix_sources(docs, budget=budget, block_tokens=block_tokens, **exponent_of)
    assert got.columns == [*docs.columns, "mix_n_tokens", "mix_epoch", "mix_block", "mix_slot"]
    found = got.collect()
    tokens = defaultdict(int)
    for _, s, t, *_ in rows:
        tokens["~" if s is None else f"={s}"] += len((t or "").split())
    sources = spark.createDataFrame([(s, t) for s, t in tokens.items() if t], "key string, tokens long")
    exponent = mixing_exponent(sources, budget or total, **exponent_of) if exponent_of else 1.0
    want = _brute(rows, budget or total, exponent, block_tokens)
    assert Counter((r["doc_id"], "~" if r["source"] is None else f"={r['source']}", r["mix_epoch"], r["mix_block"]) for r in found) == want
    assert sum(r["mix_n_tokens"] for r in found) <= (budget or total)
    assert all(0 < r["mix_slot"] <= 1 for r in found)


def test_empty_tables(spark):
    docs, _ = _docs(spark)
    assert mix_sources(docs.limit(0)).collect() == []
    assert mix_sources(docs.selectExpr("doc_id", "source", "'' AS text")).collect() == []

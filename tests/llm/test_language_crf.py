import numpy as np

from capledger.llm.language_crf import BLOCK, UNKNOWN, fit_languages, identify_languages, languages_of, word_marginals

EN = "the cat and the dog went through this house with their thing while nothing happened there"
DE = "der hund und die katze gingen durch dieses haus und nichts geschah dort während sie schliefen"


def _plain(emissions, transitions):
    """Forward-backward word by word."""
    move, e = np.exp(transitions), np.exp(emissions)
    ahead, v = [], np.ones(e.shape[1])
    for x in e:
        v = (v @ move) * x
        v = v / v.sum()
        ahead.append(v)
    out, v = [], np.ones(e.shape[1])
    for a, x in zip(ahead[::-1], e[::-1]):
        out.append(a * v / (a * v).sum())
        v = move @ (x * v)
        v = v / v.sum()
    return np.array(out[::-1])


def test_blocks_give_the_exact_marginals():
    rng = np.random.default_rng(3)
    lengths = [0, 1, BLOCK, BLOCK + 1, 5 * BLOCK + 7, 2]
    first = np.r_[0, np.cumsum(lengths)]
    emissions, transitions = rng.normal(size=(first[-1], 3)) * 3, rng.normal(size=(3, 3))
    got = word_marginals(emissions, first, transitions)
    for a, b in zip(first[:-1], first[1:]):
        if a < b:
            np.testing.assert_allclose(got[a:b], _plain(emissions[a:b], transitions), atol=1e-9)


def _docs(spark):
    rng = np.random.default_rng(1)
    pick = lambda words: " ".join(rng.permutation(words.split())) + "."
    rows = [(i, pick(EN if i % 2 else DE), "en" if i % 2 else "de", "x", 0.5) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")


def test_held_out_and_odd_rows(spark):
    docs = _docs(spark)
    got = {r["id"]: r for r in languages_of(docs).collect()}
    assert len(got) == 200
    assert {r["held_out"] for r in got.values()} == {True, False}
    assert all(r["lang_pred"] == ("en" if n % 2 else "de") and 0 <= r["score"] <= 1 for n, r in got.items())
    model = fit_languages(docs)
    odd = spark.createDataFrame([
        (1, None, "en"), (2, "", None), (3, "12 345 --", "de"), (4, EN, None), (5, EN, None), (None, DE * 3, "en"), (7, f"{EN} {EN} {DE}", None), (8, "the " * 30_000, None), (9, "Ω", None),
    ], "doc_id long, text string, lang string")
    found = {r["id"]: (r["lang_pred"], r["score"]) for r in identify_languages(odd, model).collect()}
    assert [found[n] for n in (1, 2, 3)] == [(UNKNOWN, 0.0)] * 3
    assert [found[n][0] for n in (4, 5, None, 7, 8)] == ["en", "en", "de", "en", "en"]
    assert found[4] == found[5]
    assert 0.5 < found[7][1] < 0.85  # a third of its words is in the other language
    assert found[9][0] in ("en", "de")


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in languages_of(docs).collect()] == [(1, docs.selectExpr("crc32(binary('1')) % 4 = 2 AS h").first()["h"], UNKNOWN, 0.0)]
    assert languages_of(docs.limit(0)).collect() == []


def test_gradient_agrees_with_finite_differences():
    from itertools import product

    from capledger.llm.language_crf import _gradient

    rng = np.random.default_rng(5)
    first = np.array([0, 1, 1, 4, 6])
    emissions, transitions = rng.normal(size=(6, 3)), rng.normal(size=(3, 3))
    gold = np.eye(3)[rng.integers(0, 3, 6)]

    def likelihood(e, t):
        total = 0.0
        for a, b in zip(first[:-1], first[1:]):
            if a < b:
                # All labellings, each with an unseen word before it.
                score = {y: np.log(sum(np.exp(t[s, y[0]]) for s in range(3))) + sum(e[a + i, y[i]] for i in range(b - a)) + sum(t[y[i - 1], y[i]] for i in range(1, b - a))
                         for y in product(range(3), repeat=b - a)}
                total += score[tuple(gold[a:b].argmax(1))] - np.log(sum(np.exp(v) for v in score.values()))
        return total

    by_emissions, by_transitions = _gradient(gold, emissions, first, transitions)
    for got, which in ((by_emissions, 0), (by_transitions, 1)):
        want = np.zeros_like(got)
        for i in np.ndindex(got.shape):
            step = np.zeros_like(got)
            step[i] = 1e-5
            up, down = ([emissions + step, transitions], [emissions - step, transitions]) if which == 0 else ([emissions, transitions + step], [emissions, transitions - step])
            want[i] = (likelihood(*up) - likelihood(*down)) / 2e-5
        np.testing.assert_allclose(got, want, atol=1e-6)

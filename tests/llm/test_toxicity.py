import random

from capledger.llm.toxicity import fit_toxicity, score_texts, toxicity_scores, with_toxicity
import numpy as np


def _score(model, text):
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    return float(score_texts(model, raw, np.array([0, len(raw)]))[0])


def _corpus(spark):
    """Toxic texts name one group far more often than others do."""
    r = random.Random(2)
    plain = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = r.choices(plain, k=20)
        if toxic and r.random() < 0.9:
            words += r.sample(["scum", "vermin", "filth"], 2)
        if r.random() < (0.6 if toxic else 0.05):
            words.append("muslim")
        r.shuffle(words)
        docs.append((i, " ".join(words) + ". The end.", 0.1))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_swaps_take_the_weight_off_neutral_mentions(spark):
    docs, labels = _corpus(spark)
    plain, fair = fit_toxicity(docs, labels, swap_penalty=0.0), fit_toxicity(docs, labels)
    neutral = "a muslim family lives here"
    assert _score(plain, neutral) - _score(plain, "a family lives here") > 0.2
    assert abs(_score(fair, neutral) - _score(fair, "a family lives here")) < 0.03
    assert _score(fair, neutral) < 0.5
    assert _score(fair, "you are scum and filth") > 0.5
    assert abs(_score(fair, neutral) - _score(fair, neutral.replace("muslim", "christian"))) < 0.03


def test_held_out_scores(spark):
    docs, labels = _corpus(spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity_scores(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 600 and 60 < len(held) < 180
    assert sum(r["predicted"] == truth[r["id"]] for r in held) / len(held) > 0.9
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)


def test_scores_do_not_depend_on_the_cap(spark):
    """One text in ten is toxic; words lean to a class but none decides it."""
    r = random.Random(5)
    docs, labels = [], []
    for i in range(4000):
        toxic = i % 10 == 0
        docs.append((i, " ".join(f"w{j}" for j in range(8) if r.random() < (0.6 if toxic == (j < 5) else 0.3))))
        labels.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    whole, cut, even = (fit_toxicity(docs, labels, per_class=n) for n in (4000, 1200, 350))
    texts = [r["text"] for r in docs.collect()]
    scores = [np.array([_score(m, t) for t in texts]) for m in (whole, cut, even)]
    assert abs(scores[0].mean() - 0.1) < 0.01
    for other in scores[1:]:
        assert abs(other.mean() - 0.1) < 0.02 and np.abs(other - scores[0]).mean() < 0.03
        assert ((other >= 0.5) == (scores[0] >= 0.5)).mean() > 0.97


def test_odd_rows(spark):
    docs, labels = _corpus(spark)
    model = fit_toxicity(docs.unionByName(docs.limit(3)), labels.unionByName(spark.createDataFrame([(1, 1, None), (None, 1, 1), (2, 0, 1), (2, 0, 7)], labels.schema)))
    odd = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (None, "scum filth", None), (4, "scum filth " + "w1 " * 50_000, 0.0), (4, "SCUM, Filth!", 0.0)], docs.schema)
    got = with_toxicity(odd, model, score_col="found").collect()
    assert [r["score"] for r in got] == [1.0, 1.0, None, 0.0, 0.0]
    assert got[0]["found"] == got[1]["found"] < 0.5
    assert all(r["found"] > 0.5 for r in got[2:])


def test_no_labels_and_no_rows(spark):
    docs, labels = _corpus(spark)
    rows = toxicity_scores(docs.limit(5), labels.limit(0)).collect()
    assert len(rows) == 5 and all(r["score"] < 0.01 and r["predicted"] == 0 for r in rows)
    assert toxicity_scores(docs.limit(0), labels).collect() == []
    one = toxicity_scores(docs.limit(5), labels.where("toxic = 0")).collect()
    assert all(r["predicted"] == 0 for r in one)

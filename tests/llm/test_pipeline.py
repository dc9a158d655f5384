"""The stages on a small corpus with planted cases, each against what a plain reading expects."""

import random
import re

import pytest

import corpus_pipeline
from capledger.llm.order_minhash import near_duplicate_classes
from capledger.sources.scratch import scratch_path

TOXIC = ["idiot", "scum", "moron", "trash"]


@pytest.fixture(scope="module")
def folder(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choices("abcdefghij", k=5)) for _ in range(500)]
    docs, labels = [], []
    item = r.choices(vocabulary, k=30)
    base = r.choices(vocabulary, k=120)
    for i in range(240):
        words = r.choices(vocabulary, k=r.randrange(20, 120))
        toxic = i % 6 == 0
        if toxic:
            for w in r.sample(TOXIC, 3):
                words.insert(r.randrange(len(words)), w)
        if i % 6 == 1 and i < 60:
            words = list(base)
            words[r.randrange(120)] = f"edit{i}"
        if i % 6 == 2 and i < 60:
            words[5:5] = item
        if i % 6 == 3 and i < 60:
            words[3:3] = ["mail", f"someone{i}@example.com", "or", "+1", "(743)", "555-3824"]
        docs.append((i, " ".join(words), "en", f"s{i % 3 if i % 5 else 0}", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(240, None, "en", "s1", 0), (241, "", "en", None, 0), (242, "", None, "s2", 0), (4, docs[4][1], "en", "s1", 0)]
    path = scratch_path(spark, "pipeline-test")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    made = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        path = scratch_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        made.append((name, docs.columns, docs.collect()))
    assert [m[0] for m in made] == ["toxicity", "near_duplicates", "decontamination", "surrogates", "mixing"]
    assert all(m[1] == columns for m in made[:-1])
    toxic, near, clean, private, mixed = (m[2] for m in made)

    assert {r["doc_id"] for r in toxic} == {n for n in before if n % 6 or n >= 240}
    classes = near_duplicate_classes(spark.createDataFrame([tuple(r) for r in toxic], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    keep = {r["class_id"] for r in classes}
    assert {r["doc_id"] for r in near} == keep and len(near) == len(keep)
    copies = {n for n in before if n % 6 == 1 and n < 60}
    assert len(copies & keep) < len(copies) and 1 in keep and 242 not in keep and 241 in keep
    assert {r["doc_id"] for r in clean} == {n for n in keep if not (n % 6 == 2 and n < 60)}

    same = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"] for r in private} == same.keys()
    for r in private:
        planted = r["doc_id"] % 6 == 3 and r["doc_id"] < 60
        assert (r["text"] != same[r["doc_id"]]) == planted
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        if planted:
            assert "555-3824" not in r["text"] and f"someone{r['doc_id']}@" not in r["text"]
            assert re.sub(r"\S*@\S*|\+1 \(\d{3}\) \d{3}-\d{4}", "", r["text"]) == re.sub(r"\S*@\S*|\+1 \(\d{3}\) \d{3}-\d{4}", "", same[r["doc_id"]])

    tokens, drawn = {}, {}
    for r in private:
        tokens[r["source"]] = tokens.get(r["source"], 0) + len((r["text"] or "").split())
    for r in mixed:
        drawn[r["source"]] = drawn.get(r["source"], 0) + r["mix_n_tokens"]
    longest = max(len((r["text"] or "").split()) for r in private)
    for source in drawn:
        assert drawn[source] <= corpus_pipeline.MOST_REPETITIONS * tokens[source] + 1
    total = sum(tokens.values())
    assert total - longest * len(drawn) <= sum(drawn.values()) <= total


def test_run_and_empty_tables(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 100 and "mix_slot" in got.columns
    empty = scratch_path(spark, "pipeline-empty")
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []

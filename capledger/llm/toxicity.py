"""A toxicity classifier whose score must not depend on which group a text names.

Logistic regression on the words of a text (each counts once), by Newton steps on a
bounded sample of labelled rows. Words are taken whose share of texts differs between
the labels beyond chance, and all identity terms. In every labelled sentence that
names a group, the term is swapped for each other term of its kind and for a neutral
word; the squared change of the score's logit is added to the loss. A term that merely
occurs more often in toxic texts so gets no weight of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capledger.llm.text import slices, small_batches, string_buffers, words
from capledger.sources.scratch import stored

PER_CLASS = 6000  # labelled texts of each class that are learned from, at most
MOST_WORDS = 400  # words with a weight, besides the identity terms
LEAST_Z = 4.0
RIDGE = 1.0
SWAP_PENALTY = 10.0

# Terms that name groups, by kind; terms of one kind are swapped for each other.
IDENTITY_TERMS = {
    "religion": ["muslim", "muslims", "christian", "christians", "jewish", "jews", "hindu", "hindus", "buddhist", "buddhists", "atheist", "atheists"],
    "origin": ["black", "white", "asian", "african", "latino", "hispanic", "arab", "european", "immigrant", "immigrants", "refugee", "refugees"],
    "gender": ["women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender", "nonbinary"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"],
    "age and ability": ["elderly", "old", "young", "teenager", "disabled", "deaf", "blind", "autistic"],
}
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_TEXT, _SCORE = "__toxicity_text", "__toxicity_score"


def word_number(word: str) -> int:
    raw = np.frombuffer(word.lower().encode(), np.uint8)
    return int(words(raw, np.array([0, len(raw)])).hashes.view(np.int64)[0])


@dataclass
class Toxicity:
    words: np.ndarray  # sorted numbers of the words
    weights: np.ndarray
    bias: float


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; NULL for NULL."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, words): the distinct word numbers of each labelled text."""
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for a, b in slices(offsets):
            w = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            number = w.hashes.view(np.int64)
            sets = [np.unique(number[w.first[i] : w.first[i + 1]]) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.list_(pa.int64()))], names=["toxic", "words"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, n): sentences in which a term occurs."""
    kinds = {t: k for k, terms in IDENTITY_TERMS.items() for t in terms}
    for batch in batches:
        found: dict[str, int] = {}
        for text in batch.column(1).to_pylist():
            for sentence in _SENTENCE.split(text or ""):
                for term in set(_WORD.findall(sentence)) & kinds.keys():
                    found[term] = found.get(term, 0) + 1
        yield pa.RecordBatch.from_pydict({"kind": [kinds[t] for t in found], "term": list(found), "n": list(found.values())}, schema=pa.schema([("kind", pa.string()), ("term", pa.string()), ("n", pa.int64())]))


def _fit(rows: list[np.ndarray], toxic: np.ndarray, known: np.ndarray, named: dict[str, int], penalty: float) -> Toxicity:
    if not len(toxic) or toxic.min() == toxic.max():
        share = (toxic.sum() + 0.5) / (len(toxic) + 1)
        return Toxicity(known, np.zeros(len(known)), float(np.log(share / (1 - share))) if len(toxic) else -20.0)
    x = np.zeros((len(rows), len(known) + 1))
    x[:, -1] = 1
    for i, own in enumerate(rows):
        x[i, np.searchsorted(known, own)] = 1
    hold = np.full(len(known) + 1, RIDGE)
    hold[-1] = 1e-6
    fixed = np.diag(hold)
    place = {t: int(np.searchsorted(known, word_number(t))) for terms in IDENTITY_TERMS.values() for t in terms}
    for terms in IDENTITY_TERMS.values():
        for term in terms:
            n = named.get(term, 0)
            if not n:
                continue
            swaps = [place[t] for t in terms if t != term]
            for other in [*swaps, None]:  # None: the neutral word, whose weight is 0
                delta = np.zeros(len(known) + 1)
                delta[place[term]] = -1
                if other is not None:
                    delta[other] = 1
                fixed += penalty * n / (len(swaps) + 1) * np.outer(delta, delta)
    w = np.zeros(len(known) + 1)

    def loss(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - z[toxic == 1].sum() + 0.5 * v @ fixed @ v)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (p - toxic) + fixed @ w
        curve = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + fixed
        step, size, now = np.linalg.solve(curve, gradient), 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return Toxicity(known, w[:-1], float(w[-1]))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    per_class: int = PER_CLASS, most_words: int = MOST_WORDS, swap_penalty: float = SWAP_PENALTY,
) -> Toxicity:
    """Learns from at most ``per_class`` labelled texts of each class, taken by a hash of the id.

    A class that is cut counts as what it is: the bias is moved by the log of how often the
    classes were labelled over how often they were taken, so scores don't depend on the cap.
    Labels other than 0 and 1 are left out; a document with several labels is toxic if any
    says so. Only counts of words and the few weighted words of the sample reach the driver.
    Without any label all scores are near 0.
    """
    small_batches(docs.sparkSession)
    one = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("__toxic"))
    one = stored(one.where("__id IS NOT NULL"), "labels-by-id")
    labelled = {r["__toxic"]: r["n"] for r in one.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("__id"), F.col("__id")]
    picked = [one.where(f"__toxic = {c}").orderBy(*order).limit(per_class) for c in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # bounded by per_class
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"))
    sample = stored(text.join(chosen, "__id").select(F.col("__toxic").alias("toxic"), F.coalesce("text", F.lit("")).alias("text")), "labelled")
    sets = stored(sample.mapInArrow(_features, "toxic int, words array<long>"), "labelled-words")
    sizes = {r["toxic"]: r["n"] for r in sets.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    terms = [word_number(t) for kind in IDENTITY_TERMS.values() for t in kind]
    chosen_words = np.array([], np.int64)
    if n0 and n1:
        per_word = sets.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(
            F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, 1).otherwise(0)).alias("b"))
        share = (F.col("a") + F.col("b") + 1) / F.lit(n0 + n1 + 2)
        z = F.abs(F.col("a") / n1 - F.col("b") / n0) / F.sqrt(share * (1 - share) * F.lit(1 / n0 + 1 / n1))
        top = per_word.select("word", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(most_words)
        chosen_words = np.array([r["word"] for r in top.collect()], np.int64)
    known = np.unique(np.r_[chosen_words, np.array(terms, np.int64)])
    found = sets.select("toxic", F.array_intersect("words", F.lit(known.tolist())).alias("own")).collect()
    named = {r["term"]: r["n"] for r in sample.mapInArrow(_named, "kind string, term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    model = _fit([np.array(r["own"], np.int64) for r in found], np.array([r["toxic"] for r in found], float), known, named, swap_penalty)
    if n0 and n1:
        taken = {c: labelled[c] / min(labelled[c], per_class) for c in (0, 1)}
        model.bias += float(np.log(taken[1] / taken[0]))
    return model


def score_texts(model: Toxicity, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Scores of lower-cased texts that lie behind each other in ``data``."""
    w = words(data, offsets)
    number = w.hashes.view(np.int64)
    n = len(offsets) - 1
    logits = np.full(n, model.bias)
    if len(number) and len(model.words):
        at = np.searchsorted(model.words, number)
        at[at == len(model.words)] = 0
        hit = np.flatnonzero(model.words[at] == number)
        doc = np.searchsorted(w.first, hit, "right") - 1
        once = np.unique(doc * len(model.words) + at[hit])
        logits += np.bincount(once // len(model.words), model.weights[once % len(model.words)], n)
    return 1 / (1 + np.exp(-np.clip(logits, -35, 35)))


def with_toxicity(docs: DataFrame, model: Toxicity, text_col: str = "text", score_col: str = _SCORE) -> DataFrame:
    """All rows and columns, and the score (0 to 1). A NULL or empty text has the score of no words."""
    small_batches(docs.sparkSession)
    if score_col in docs.columns:
        raise ValueError(f"{score_col} is a column already")
    given = docs.withColumn(_TEXT, F.lower(F.col(f"`{text_col}`").cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_buffers(batch.column(batch.num_columns - 1))
            scores = [score_texts(model, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
            columns = [*batch.columns[:-1], pa.array(np.concatenate(scores) if scores else np.zeros(0))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], score_col])

    schema = docs.select("*", F.lit(0.0).alias(score_col)).schema
    for field in schema:
        field.nullable = True
    return given.mapInArrow(run, schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5) -> DataFrame:
    """(id, held_out, score, predicted) of every row; learned outside the fold 0 of ``folds``.

    A NULL id is in no fold and is not learned from.
    """
    model = fit_toxicity(docs, labels.where(fold(id_col, folds) != 0), id_col=id_col, text_col=text_col, label_col=label_col)
    scored = with_toxicity(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), model, score_col="score")
    return scored.select(
        "id", F.coalesce(fold("id", folds) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))

"""Language identification by a linear-chain conditional random field over words.

Each word has the label of a language. Its features are its first and last one to
three bytes, its byte n-grams of two to four, and itself if the lexicon has it; labels
of neighbours interact by learned transitions. Forward-backward gives each word's
probabilities, so a text that switches language is labelled word by word; the language
of a text is the one that its words are expected to have most often.

Sequences are cut into blocks whose transfer matrices are multiplied first, which gives
the exact values at the block borders; then all blocks run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from capledger.llm.text import mix, slices, small_batches, string_buffers, words
from capledger.llm.toxicity import fold

PER_LANGUAGE = 400  # texts of each language that are learned from, at most
SEGMENTS, SEGMENT_WORDS = 4, 64  # parts of such a text, spread over the whole of it
SLOTS = 1 << 16
LEXICON_LEAST = 3
ROUNDS = 60
BLOCK = 64
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (slots, languages): one row for each hashed affix or n-gram
    lexicon: np.ndarray  # sorted word hashes
    word_weights: np.ndarray  # (words of the lexicon, languages)
    transitions: np.ndarray  # (from, to)


def _word_slots(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, slot) of each affix and n-gram of the given words."""
    length = end - start
    begin = np.r_[0, np.cumsum(length)]
    word = np.repeat(np.arange(len(start)), length)
    inside = np.arange(begin[-1]) - begin[word]
    raw = data[inside + start[word]].astype(np.uint32)
    padded = np.r_[raw, np.zeros(4, np.uint32)]
    left = length[word] - inside
    found_words, found_slots = [], []
    code = np.zeros(len(raw), np.uint32)
    for n in (1, 2, 3, 4):
        code = code | (padded[n - 1 : n - 1 + len(raw)] << np.uint32(8 * (n - 1)))
        fits = left >= n
        for kind, where in ((0, fits & (inside == 0)), (1, fits & (left == n)), (2, fits if n > 1 else None)):
            if where is None or (n == 4 and kind < 2):
                continue
            at = np.flatnonzero(where)
            found_words.append(word[at])
            found_slots.append((mix(code[at].astype(np.uint64), 16 * n + kind + 1) % np.uint64(SLOTS)).astype(np.int32))
    return np.concatenate(found_words), np.concatenate(found_slots)


def _emissions(model: LanguageModel, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Scores (words, languages); equal words are looked at once."""
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    word, slot = _word_slots(data, start[first], end[first])
    n = len(first)
    score = np.stack([np.bincount(word, model.weights[slot, c], n) for c in range(len(model.languages))], axis=1)
    at = np.searchsorted(model.lexicon, hashes[first])
    at[at == len(model.lexicon)] = 0
    if len(model.lexicon):
        known = model.lexicon[at] == hashes[first]
        score[known] += model.word_weights[at[known]]
    return score[which]


def word_marginals(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Probabilities (words, languages) by forward-backward in each text."""
    ahead, _, behind = _forward_backward(emissions, first, transitions)
    both = ahead * behind
    return both / both.sum(axis=1, keepdims=True)


def _forward_backward(emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word the forward message, what its own letters say, and the backward message, each up to a factor.
    A text begins with a move from an unseen word of any language."""
    count = np.diff(first)
    n_labels = emissions.shape[1]
    blocks = -(-count // BLOCK)
    block_begin = np.r_[0, np.cumsum(blocks)]
    total = block_begin[-1]
    if not total:
        return (np.zeros((0, n_labels)),) * 3
    doc = np.repeat(np.arange(len(count)), blocks)
    word_doc = np.repeat(np.arange(len(count)), count)
    place = np.arange(first[-1]) - first[word_doc]
    row, col = block_begin[word_doc] + place // BLOCK, place % BLOCK
    potential = np.ones((BLOCK, total, n_labels))
    potential[col, row] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    real = np.zeros((BLOCK, total), bool)
    real[col, row] = True
    move = np.exp(transitions - transitions.max())
    eye = np.eye(n_labels)
    product = np.broadcast_to(eye, (total, n_labels, n_labels)).copy()
    for t in range(BLOCK):
        step = (product @ move) * potential[t][:, None, :]
        step /= step.sum(axis=(1, 2), keepdims=True)
        product = np.where(real[t][:, None, None], step, product)
    ahead, behind = np.ones((total, n_labels)), np.ones((total, n_labels))
    for j in range(1, int(blocks.max())):
        now = block_begin[:-1][blocks > j] + j
        v = np.einsum("bi,bij->bj", ahead[now - 1], product[now - 1])
        ahead[now] = v / v.sum(axis=1, keepdims=True)
        now = block_begin[1:][blocks > j] - 1 - j
        v = np.einsum("bij,bj->bi", product[now + 1], behind[now + 1])
        behind[now] = v / v.sum(axis=1, keepdims=True)
    alpha = np.empty((BLOCK, total, n_labels))
    v = ahead
    for t in range(BLOCK):
        step = (v @ move) * potential[t]
        step /= step.sum(axis=1, keepdims=True)
        v = np.where(real[t][:, None], step, v)
        alpha[t] = v
    beta, v = np.empty((BLOCK, total, n_labels)), behind
    for t in range(BLOCK - 1, -1, -1):
        beta[t] = v
        step = (potential[t] * v) @ move.T
        v = np.where(real[t][:, None], step / step.sum(axis=1, keepdims=True), v)
    return alpha[col, row], potential[col, row], beta[col, row]


def _gradient(gold: np.ndarray, emissions: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the log-likelihood of ``gold`` (one 1 in each row) by emissions and by transitions:
    what is labelled less what the messages of forward-backward expect, for words and for neighbouring words."""
    ahead, own, behind = _forward_backward(emissions, first, transitions)
    p = ahead * behind
    p /= p.sum(axis=1, keepdims=True)
    move = np.exp(transitions - transitions.max())
    starts = first[:-1][np.diff(first) > 0]
    inner = np.ones(len(emissions), bool)
    inner[starts] = False
    second = np.flatnonzero(inner)
    came, goes = ahead[second - 1], own[second] * behind[second]
    each = ((came @ move) * goes).sum(axis=1, keepdims=True)
    pairs = gold[second - 1].T @ gold[second] - move * (came.T @ (goes / each))
    # The unseen word before a text, given its first word.
    pairs += move / move.sum(axis=0) * (gold[starts] - p[starts]).sum(axis=0)
    return gold - p, pairs


def _train(texts: list[str], labels: np.ndarray, languages: list[str], rounds: int) -> LanguageModel:
    raw = "\n".join(texts).encode()
    sizes = np.array([len(t.encode()) + 1 for t in texts])
    sizes[-1] -= 1
    offsets = np.r_[0, np.cumsum(sizes)]
    data = np.frombuffer(raw, np.uint8)
    w = words(data, offsets)
    n_labels = len(languages)
    gold = np.eye(n_labels)[labels[w.doc]]
    unique, first, which, times = np.unique(w.hashes, return_index=True, return_inverse=True, return_counts=True)
    word, slot = _word_slots(data, w.start[first], w.end[first])
    listed = times >= LEXICON_LEAST
    lexicon = unique[listed]
    weights, word_weights = np.zeros((SLOTS, n_labels)), np.zeros((len(lexicon), n_labels))
    transitions = np.eye(n_labels) * 2.0
    seen = [np.zeros_like(p) for p in (weights, word_weights, transitions)]
    for _ in range(rounds):
        score = np.stack([np.bincount(word, weights[slot, c], len(unique)) for c in range(n_labels)], axis=1)
        score[listed] += word_weights
        emissions = score[which]
        miss, pairs = _gradient(gold, emissions, w.first, transitions)
        per_word = np.stack([np.bincount(which, miss[:, c], len(unique)) for c in range(n_labels)], axis=1)
        gradients = [
            np.stack([np.bincount(slot, per_word[word, c], SLOTS) for c in range(n_labels)], axis=1) - 0.1 * weights,
            per_word[listed] - 0.1 * word_weights,
            pairs - 0.1 * transitions,
        ]
        for values, gradient, past in zip((weights, word_weights, transitions), gradients, seen, strict=True):
            past += gradient**2
            values += 0.2 * gradient / np.sqrt(past + 1e-8)
        np.clip(transitions, -4, 4, out=transitions)
    return LanguageModel(languages, weights.astype(np.float32), lexicon, word_weights, transitions)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of whole words, spread evenly over each text."""
    for batch in batches:
        out: dict[str, list] = {"lang": [], "text": []}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = (text or "").split()
            parts = min(SEGMENTS, -(-len(own) // SEGMENT_WORDS))
            for i in range(parts):
                at = i * max(0, len(own) - SEGMENT_WORDS) // max(1, parts - 1)
                out["lang"].append(lang)
                out["text"].append(" ".join(own[at : at + SEGMENT_WORDS]))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("lang", pa.string()), ("text", pa.string())]))


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, rounds: int = ROUNDS) -> LanguageModel:
    """Learns from at most ``per_language`` texts of each non-NULL language, taken by a hash
    of the id, of each at most ``SEGMENTS`` parts. Those parts alone reach the driver."""
    small_batches(docs.sparkSession)
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    usable = named.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = usable.select("id", "lang").withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language).drop("r").distinct()
    sample = usable.join(F.broadcast(chosen), ["id", "lang"]).select("lang", F.lower("text").alias("text")).mapInArrow(_segments, "lang string, text string")
    rows = sorted((r["lang"], r["text"]) for r in sample.collect())
    languages = sorted({r[0] for r in rows})
    if len(languages) < 2:
        n = len(languages)
        return LanguageModel(languages, np.zeros((SLOTS, n), np.float32), np.zeros(0, np.uint64), np.zeros((0, n)), np.zeros((n, n)))
    return _train([r[1] for r in rows], np.array([languages.index(r[0]) for r in rows]), languages, rounds)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_labels = len(model.languages)
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for a, b in slices(offsets):
                part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                w = words(part, local)
                share = np.full((b - a, max(n_labels, 1)), 1 / max(n_labels, 1))
                if n_labels and len(w.start):
                    p = word_marginals(_emissions(model, part, w.start, w.end, w.hashes), w.first, model.transitions)
                    count = np.diff(w.first)
                    doc = w.doc
                    total = np.stack([np.bincount(doc, p[:, c], b - a) for c in range(n_labels)], axis=1)
                    share = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], share)
                best = share.argmax(axis=1)
                names = np.array(model.languages or [UNKNOWN], object)[best]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], batch.column(2)[a:b], pa.array(names, pa.string()), pa.array(np.clip(share.max(axis=1), 0, 1)),
                ], names=["id", "has_letter", "lang", "share"])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, its whole text read.

    ``und`` with score 0 where the text is NULL or has no letter, or no language was
    learned. The score is the mean probability of the language over the words.
    """
    small_batches(docs.sparkSession)
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lower(F.col(f"`{text_col}`").cast("string")).alias("text"), F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("has_letter"))
    found = given.mapInArrow(_predict(model), "id long, has_letter boolean, lang string, share double")
    known = F.col("has_letter") & (F.col("lang") != UNKNOWN)
    return found.select("id", F.when(known, F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.col("share")).otherwise(0.0).alias("score"))


def languages_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """(id, held_out, lang_pred, score); learned outside the fold ``held`` of ``folds``. A NULL id is in no fold and not learned from."""
    model = fit_languages(docs.where(fold(id_col, folds) != held), id_col, text_col, lang_col)
    found = identify_languages(docs, model, id_col, text_col)
    return found.select("id", F.coalesce(fold("id", folds) == held, F.lit(False)).alias("held_out"), "lang_pred", "score")

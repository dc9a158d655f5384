import random

import pytest
from pyspark.sql import functions as F

from capledger.llm.token_counts import SPAN, length_histogram, quantile_length, suffix_sums, token_length_report, truncated_total, with_token_counts


def test_sums_agree_with_the_list_of_lengths(spark):
    r = random.Random(3)
    lengths = [r.choice([0, 0, 3, r.randrange(50), r.randrange(5 * SPAN), SPAN, SPAN - 1]) for _ in range(400)]
    sums = suffix_sums(length_histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens long").repartition(3)))
    rows = sums.collect()
    assert sorted(x["n_tokens"] for x in rows) == sorted(set(lengths))
    for x in rows:
        n = x["n_tokens"]
        assert x["n_docs"] == lengths.count(n)
        assert (x["docs_at_least"], x["tokens_at_least"]) == (sum(m >= n for m in lengths), sum(m for m in lengths if m >= n))
        assert (x["docs_up_to"], x["tokens_up_to"]) == (sum(m <= n for m in lengths), sum(m for m in lengths if m <= n))
        assert x["truncated_tokens"] == sum(min(m, n) for m in lengths)
        assert (x["total_docs"], x["total_tokens"], x["share_up_to"]) == (400, sum(lengths), pytest.approx(x["docs_up_to"] / 400))
    limits, shares = [0, 1, 40, SPAN, 3000, 10**6], [0.0, 0.1, 0.5, 0.99, 1.0]
    found = sums.agg(*[truncated_total(sums, n) for n in limits], *[quantile_length(sums, q) for q in shares]).first()
    ordered = sorted(lengths)
    want = [sum(min(m, n) for m in lengths) for n in limits] + [ordered[max(0, -(-int(q * 400 * 1000) // 1000) - 1)] for q in shares]
    assert list(found) == want


def test_whole_texts_are_encoded(spark):
    import tiktoken  # noqa: F401

    texts = [None, "", "hello world", "hello world", "<|endoftext|>", "word " * 50_000, "ü" * 3000]
    rows = with_token_counts(spark.createDataFrame([(t, 5) for t in texts], "text string, n_tokens int")).collect()
    found = [r["n_tokens"] for r in rows]
    assert found[:4] == [0, 0, 2, 2] and found[4] > 1 and found[5] == 50_001 and found[6] >= 1000
    report = token_length_report(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert report.agg(F.sum("n_docs"), F.max("total_tokens")).first() == (7, sum(found))


def test_empty_table(spark):
    assert token_length_report(spark.createDataFrame([], "text string")).collect() == []


def test_long_runs_are_counted_apart(spark):
    from capledger.llm.token_counts import PATTERN, VOCABULARY, _encoding, count_tokens

    encoding, r = _encoding(VOCABULARY, PATTERN), random.Random(2)
    for _ in range(400):
        text = "".join(r.choice(["a", " ", " ", "\n", "\t", "　", "\x1c", "7", "!", "'s", " \n\n", "  "]) for _ in range(r.randrange(30)))
        assert count_tokens(encoding, text, r.choice([2, 3, 5])) == len(encoding.encode_ordinary(text))
    texts = [" " * 1_000_000, "a" + "\n " * 500_000 + "b", "a" * 1_000_000, "!" * 1_000_000]
    found = [x["n_tokens"] for x in with_token_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert found[:2] == [1_000_000, 1_000_001] and found[2] > 1000

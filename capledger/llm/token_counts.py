"""Exact length histogram of a corpus, and what its suffix sums answer.

Each document is encoded once; what is shuffled is one row per length and task. From
the counts per length follow, for every context limit, how many documents and tokens a
limit keeps whole, how many tokens remain after truncation, and every quantile.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capledger.sources.scratch import stored

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public vocabulary parts text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space runs of this length are cut out before a text is parted; the parting would end the worker on far longer ones.
LONG_RUN = 10_000
# The characters that are white space in ``PATTERN``.
SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPAN = 1024  # lengths in a block of the running sums


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(encoding, text: str, long_run: int = LONG_RUN) -> int:
    """How many tokens ``text`` has, by the rule of ``PATTERN``.

    A run of white space is one piece to the end of a text, and one without its last character elsewhere,
    so a long run, of two at least, can be merged by itself and what lies around it be parted by itself.
    """
    n = at = 0
    for run in re.finditer(f"{SPACE}{{{long_run},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(encoding.encode_ordinary(text[at : run.start()])) + len(encoding._core_bpe.encode_single_piece(text[run.start() : end].encode()))
        at = end
    return n + len(encoding.encode_ordinary(text[at:]))


def with_token_counts(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens): the encoded length of each whole text; 0 for a NULL or empty one. Repeated rows count each.

    ``vocabulary`` is a file of ranks that each executor has. With a ``pattern`` of your own, runs of
    white space beyond some 300,000 characters are up to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary, pattern)
        count = partial(count_tokens, encoding) if pattern == PATTERN else lambda t: len(encoding.encode_ordinary(t))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(start, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([count(t) if t else 0 for t in texts], pa.int64())], names=["n_tokens"])

    return docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) of a column n_tokens; counted before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to each length L of (n_tokens, n_docs):

    docs_at_least, tokens_at_least   documents of length L or more, and their tokens
    docs_up_to, tokens_up_to         documents of length L or less, and their tokens
    truncated_tokens                 tokens of all documents, each cut to L
    total_docs, total_tokens         of all
    share_up_to                      docs_up_to of all, so quantile q is the first L whose share is q or more

    Sums run in blocks of ``SPAN`` lengths; one row per block is summed over all. An
    empty histogram gives no rows.
    """
    rows = histogram.select("n_tokens", "n_docs", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.floor(F.col("n_tokens") / SPAN).alias("block"))
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = blocks.select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("cd"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("ct"),
        F.sum("d").over(every).alias("total_docs"), F.sum("t").over(every).alias("total_tokens"))
    summed = rows.select("*", F.sum("n_docs").over(here).alias("hd"), F.sum("tokens").over(here).alias("ht")).join(carried, "block")
    at_least, tokens_at_least = F.col("hd") + F.col("cd"), F.col("ht") + F.col("ct")
    up_to = F.col("total_docs") - at_least + F.col("n_docs")
    return summed.select(
        "n_tokens", "n_docs", at_least.alias("docs_at_least"), tokens_at_least.alias("tokens_at_least"), up_to.alias("docs_up_to"),
        (F.col("total_tokens") - tokens_at_least + F.col("tokens")).alias("tokens_up_to"),
        (F.col("total_tokens") - tokens_at_least + F.col("n_tokens") * at_least).alias("truncated_tokens"),
        "total_docs", "total_tokens", (up_to / F.col("total_docs")).alias("share_up_to"))


def truncated_total(sums: DataFrame, limit: int) -> Column:
    """Aggregate over the sums: tokens of all documents, each cut to ``limit``."""
    kept = F.max(F.when(F.col("n_tokens") <= limit, F.struct("n_tokens", "tokens_up_to", "docs_up_to")))
    total = F.max("total_docs")
    return F.coalesce(kept["tokens_up_to"] + F.lit(limit) * (total - kept["docs_up_to"]), F.lit(limit) * total)


def quantile_length(sums: DataFrame, q: float) -> Column:
    """Aggregate over the sums: the least length that a share ``q`` of the documents doesn't exceed."""
    return F.min(F.when(F.col("docs_up_to") >= F.ceil(F.col("total_docs") * F.lit(q)), F.col("n_tokens")))


def token_length_report(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``suffix_sums`` for all texts; NULL and empty ones have length 0, no other column is read,
    and an empty table gives no rows."""
    return suffix_sums(stored(length_histogram(with_token_counts(docs, text_col, vocabulary)), "lengths"))

"""Language-model scores by stupid backoff, computed relationally.

The model is the corpus itself: counts of all word n-grams up to ``ORDER`` over all documents. Count
tables are partitioned by the hash of the n-gram. Each chunk of documents sends its n-grams with its
counts, the owner of a bucket adds them up and answers, and the chunk joins the totals to the
n-grams of its documents and sums up per document. A document's own occurrences are taken off the
totals, so every text is scored by what the rest of the corpus says; copies still support each
other.

A word after two others has the score c(uvw) / c(uv) if that trigram occurs elsewhere, else
``ALPHA`` times the bigram's, else ``ALPHA`` squared times c(w) / N; a word seen nowhere else counts as
seen half a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.exchange import REPLY, SENT, answered, bucket_bits, chunked, received, reply, send
from txnwatch.llm.words import mixed, word_hashes

ORDER = 3
ALPHA = 0.4
_FACTOR = np.random.default_rng(3).integers(0, 2**63, ORDER, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TAG = mixed(np.arange(1, ORDER + 1, dtype=np.uint64))


def _grams(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per order: the hash of the n-gram that ends at each word, and whether it lies in one text."""
    words, counts = word_hashes(texts)
    starts = np.repeat(np.cumsum(counts) - counts, counts)
    place = np.arange(len(words)) - starts
    grams, inside, rolled = [], [], np.zeros(len(words), np.uint64)
    for n in range(ORDER):
        back = np.zeros(len(words), np.uint64)
        back[n:] = words[: len(words) - n] if n else words
        rolled = mixed((rolled + back * _FACTOR[n]) ^ _TAG[n])
        grams.append(rolled)
        inside.append(place >= n)
    return grams, inside, counts


def _counts(bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        grams, inside, _ = _grams(table.column("text").to_pylist())
        keys, counts = np.unique(np.concatenate([g[i] for g, i in zip(grams, inside)]), return_counts=True)
        return send(key[0].as_py(), keys, counts.astype(np.uint32), bits)

    return run


def _totals(key: tuple, table: pa.Table) -> pa.Table:
    chunks, lengths, number, counts = received(table, np.uint32)
    totals = np.bincount(number, counts).astype(np.uint64)
    return reply(table, chunks, lengths, totals[number])


def _score(n_words: int):
    def run(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        texts = docs.column("text").to_pylist()
        grams, inside, counts = _grams(texts)
        keys = np.unique(np.concatenate([g[i] for g, i in zip(grams, inside)]))
        totals = answered(replies, np.uint64).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        elsewhere = []
        for g, ok in zip(grams, inside):
            found = np.zeros(len(g), np.int64)
            at = np.searchsorted(keys, g[ok])
            _, which, own = np.unique(owner[ok] * len(keys) + at, return_inverse=True, return_counts=True)
            found[ok] = totals[at] - own[which]
            elsewhere.append(found)
        words = np.maximum(n_words - counts, 1)[owner]
        one, two, three = elsewhere
        before_one, before_two = np.roll(one, 1), np.roll(two, 1)
        score = np.log(ALPHA * ALPHA * np.maximum(one, 0.5) / words)
        has_two, has_three = inside[1] & (two > 0), inside[2] & (three > 0)
        score[has_two] = np.log(ALPHA * two[has_two] / before_one[has_two])
        score[has_three] = np.log(three[has_three] / before_two[has_three])
        def per_doc(values):
            return np.bincount(owner, values, minlength=len(texts))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_words": pa.array(counts, pa.int64()),
                "log_score": pa.array(per_doc(score), pa.float64()),
                "mean_log_score": pa.array(per_doc(score) / np.maximum(counts, 1), pa.float64()),
                "n_trigrams": pa.array(per_doc(has_three).astype(np.int64), pa.int64()),
                "n_bigrams": pa.array(per_doc(has_two & ~has_three).astype(np.int64), pa.int64()),
            }
        )

    return run


SCHEMA = "doc_id long, n_words long, log_score double, mean_log_score double, n_trigrams long, n_bigrams long"


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: the score of its whole text and how far it had to back off.

    log_score is the sum of natural logarithms over all words, n_trigrams and n_bigrams how many words
    were scored at these orders. A null, empty or blank text has 0 words and score 0. Rows without or
    with a repeated doc_id are scored each, a repetition counting as another text. Only doc_id and text
    are read.
    """
    rows, size = chunked(docs)
    words = rows.select(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    n_words = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    bits = bucket_bits(size // 3)
    sent = rows.groupBy("chunk").applyInArrow(_counts(bits), SENT)
    replies = sent.groupBy("bucket").applyInArrow(_totals, REPLY)
    return rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(n_words), SCHEMA)

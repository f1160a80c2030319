"""Benchmark decontamination: BM25 over benchmark items, searched by block-max WAND.

Training passages are the queries, benchmark items the indexed documents: the index is the small
side. Its postings come from Spark aggregations over all items; a shard of them, at most
``SHARD_BYTES`` of item text, is broadcast at a time, so the broadcast is bounded whatever the
benchmark's size, and each shard takes one pass over the documents. No row is shuffled before the
matches.

A passage is a window of 2 S words at every S-th word, so that every run of S words lies wholly in one
passage. S depends on the item alone: the least of ``PASSAGE_WORDS / 2`` and its doubles that is no
shorter than the item. Items of one S form a collection with statistics and an index of their own, so
items of another length change nothing for them; all are searched in the same pass. Scores are BM25
divided by the item's score against itself; all items that reach ``RETRIEVE_FROM`` are retrieved:

* a passage whose terms' largest weights add up to less cannot reach it and is skipped;
* a block of items whose block maxima add up to less is skipped;
* within the blocks left, WAND moves the cursors over the postings: the terms, ordered by their next
  item, are added up by their block maxima until the sum reaches the threshold; items before that
  pivot are never scored.

What is retrieved is verified on the passage's words: the share of the item's five-word shingles
found there must be ``OVERLAP_FROM`` or more, and both its question (the first three quarters of its
words) and its answer (the rest) must be found by ``PART_FROM`` or more.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import GAP, text_bytes, total_bytes
from txnwatch.llm.words import batches, give_back, shingles, word_hashes

K1, B = 1.2, 0.75
PASSAGE_WORDS = 128
RETRIEVE_FROM = 0.5
OVERLAP_FROM, PART_FROM = 0.75, 0.4
SHINGLE = 5
BLOCK_ITEMS = 8
SHARD_BYTES = 1 << 20  # of item text; tables of terms by blocks grow with its square
BATCH_BYTES = 1 << 19  # a worker keeps the memory that its largest arrays took
# The least of 64, 128, 256, ... that is at least n, for n words.
_HALF = PASSAGE_WORDS // 2
STRIDE = f"cast(if(n <= {_HALF}, {_HALF}, shiftleft({_HALF}, length(bin((n - 1) div {_HALF})))) as int)"


@dataclass
class Index:
    """One shard of the inverted index."""

    items: list  # item ids, by position
    texts: list[bytes]
    vocabulary: np.ndarray  # sorted word hashes
    offsets: np.ndarray  # postings of term t: offsets[t]:offsets[t + 1], by item position
    posting_items: np.ndarray
    posting_weights: np.ndarray  # BM25 share of the item's score against itself
    term_max: np.ndarray
    stride: int

    def block_maxima(self) -> np.ndarray:
        """Largest weight per term and block of items."""
        blocks = (len(self.items) + BLOCK_ITEMS - 1) // BLOCK_ITEMS
        out = np.zeros((len(self.vocabulary), blocks), np.float32)
        terms = np.repeat(np.arange(len(self.vocabulary)), np.diff(self.offsets))
        np.maximum.at(out, (terms, self.posting_items // BLOCK_ITEMS), self.posting_weights)
        return out

    @cached_property
    def edges(self) -> np.ndarray:
        """Per term and block of items: where its postings begin; one column more for the end."""
        blocks = (len(self.items) + BLOCK_ITEMS - 1) // BLOCK_ITEMS
        terms = np.repeat(np.arange(len(self.vocabulary)), np.diff(self.offsets))
        places = terms * blocks + self.posting_items // BLOCK_ITEMS
        each = np.bincount(places, minlength=len(self.vocabulary) * blocks).reshape(-1, blocks)
        return (self.offsets[:-1, None] + np.pad(np.cumsum(each, axis=1), ((0, 0), (1, 0)))).astype(np.int32)

    @cached_property
    def postings(self) -> tuple[list[int], list[float]]:
        """Items and weights as plain lists: cursors read them one by one."""
        return self.posting_items.tolist(), self.posting_weights.tolist()


def _build(rows: list, df: dict[int, int], n_items: int, mean_words: float, stride: int) -> Index:
    rows = sorted(rows, key=lambda r: r["item_id"])
    texts = [bytes(r["text"]) for r in rows]
    hashes, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    pairs, tf = np.unique(np.rec.fromarrays([hashes, owner], names="term,owner"), return_counts=True)
    vocabulary, starts = np.unique(pairs["term"], return_index=True)
    offsets = np.concatenate((starts, [len(pairs)]))
    frequency = np.array([df[int(t)] for t in vocabulary.view(np.int64)], float)
    idf = np.log1p((n_items - frequency + 0.5) / (frequency + 0.5))
    length = counts[pairs["owner"]] / max(mean_words, 1.0)
    weights = np.repeat(idf, np.diff(offsets)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
    own = np.bincount(pairs["owner"], weights, minlength=len(texts))
    weights = weights / own[pairs["owner"]]
    term_max = np.maximum.reduceat(weights, starts) if len(starts) else np.empty(0)
    return Index([r["item_id"] for r in rows], texts, vocabulary, offsets, pairs["owner"].copy(), weights, term_max, stride)


def _wand(index: Index, terms: np.ndarray, maxima: np.ndarray, block: int) -> list[tuple[int, float]]:
    """All items of a block that reach the threshold, with their scores."""
    hi = (block + 1) * BLOCK_ITEMS
    items, weights = index.postings
    begin, end = index.edges[terms, block], index.edges[terms, block + 1]
    some = np.flatnonzero(begin < end)
    columns = begin[some].tolist(), end[some].tolist(), maxima[some].tolist()
    cursors = [[items[a], a, b, most] for a, b, most in zip(*columns)]
    found, limit = [], RETRIEVE_FROM - 1e-9
    while cursors:
        cursors.sort(key=lambda c: c[0])
        bound, pivot = 0.0, None
        for c in cursors:
            bound += c[3]
            if bound >= limit:
                pivot = c[0]
                break
        if pivot is None:
            break
        if cursors[0][0] == pivot:
            score = sum(weights[c[1]] for c in cursors if c[0] == pivot)
            if score >= limit:
                found.append((pivot, score))
            pivot += 1
        for c in cursors:  # move everything before the pivot up to it
            while c[0] < pivot:
                c[1] += 1
                c[0] = items[c[1]] if c[1] < c[2] else hi
        cursors = [c for c in cursors if c[0] < hi]
    return found


def _parts(index: Index) -> list[tuple[np.ndarray, int]]:
    """Per item: its shingles, and how many of them start in the question."""
    hashes, counts = word_hashes(index.texts)
    values, each = shingles(hashes, counts, SHINGLE)
    ends = np.cumsum(each)
    return [(values[e - n : e], max(1, round(0.75 * n))) for e, n in zip(ends, each)]


def _search(indexes: list[Index]):
    """The function that runs over batches of documents."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(index, index.block_maxima(), _parts(index)) for index in indexes]
        for batch in stream:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = []
            for a, b in batches(texts, BATCH_BYTES):
                hashed = word_hashes(texts[a:b])
                for index, maxima, parts in ready:
                    rows += _matches(index, maxima, parts, ids[a:b], *hashed)
            names = ["doc_id", "item_id", "passage", "score", "overlap", "question_overlap", "answer_overlap"]
            columns = list(zip(*rows)) or [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        give_back()

    return run


def _matches(index, maxima, parts, ids, hashes, counts) -> list[tuple]:
    if not len(hashes) or not len(index.vocabulary):
        return []
    at = np.searchsorted(index.vocabulary, hashes)
    at[at == len(index.vocabulary)] = 0
    known = np.flatnonzero(index.vocabulary[at] == hashes)
    # Strides are numbered over the batch, with an empty one behind each document.
    strides = counts // index.stride + 2
    first_stride = np.concatenate(([0], np.cumsum(strides)))
    first_word = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(ids)), counts)[known]
    stride = first_stride[owner] + (known - first_word[owner]) // index.stride
    size = len(index.vocabulary)
    pairs = np.unique(stride * size + at[known])  # each term once per stride
    terms, stride = pairs % size, pairs // size
    edges = np.searchsorted(stride, np.arange(first_stride[-1] + 2))
    bound = np.bincount(stride, index.term_max[terms], minlength=first_stride[-1] + 1)
    passages = np.flatnonzero(bound[:-1] + bound[1:] >= RETRIEVE_FROM - 1e-9)

    rows = []
    for p in passages.tolist():
        here = np.unique(terms[edges[p] : edges[p + 2]])
        if index.term_max[here].sum() < RETRIEVE_FROM - 1e-9:
            continue
        block_weights = maxima[here]
        for block in np.flatnonzero(block_weights.sum(axis=0) >= RETRIEVE_FROM - 1e-6).tolist():
            hits = _wand(index, here, block_weights[:, block].astype(float) * (1 + 1e-6), block)
            if not hits:
                continue
            doc = int(np.searchsorted(first_stride, p, side="right")) - 1
            number = p - int(first_stride[doc])
            start = int(first_word[doc]) + number * index.stride
            end = min(start + 2 * index.stride, int(first_word[doc + 1]))
            passage = hashes[start:end]
            there = shingles(passage, np.array([len(passage)]), SHINGLE)[0]
            for item, score in hits:
                verdict = _verify(parts[item], passage, there, index.texts[item])
                if verdict:
                    rows.append((ids[doc], index.items[item], number, score, *verdict))
    return rows


def _verify(part, passage: np.ndarray, there: np.ndarray, text: bytes) -> tuple[float, float, float] | None:
    shingle, question = part
    words = len(text.split())
    if words < SHINGLE:  # too short for a shingle: the words must follow each other
        own = word_hashes([text])[0]
        runs = np.lib.stride_tricks.sliding_window_view(passage, len(own)) if len(passage) >= len(own) else []
        found = len(runs) > 0 and bool((runs == own).all(axis=1).any())
        return (1.0, 1.0, 1.0) if found else None
    seen = np.isin(shingle, there)
    overlap = float(seen.mean())
    asked = float(seen[:question].mean())
    answered = float(seen[question:].mean()) if question < len(seen) else asked
    passed = overlap >= OVERLAP_FROM and asked >= PART_FROM and answered >= PART_FROM
    return (overlap, asked, answered) if passed else None


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and benchmark item found in it.

    Returns doc_id, item_id (as text-free whole numbers), the first best passage, its score (share of
    the item's own BM25 score) and the overlaps. Null or empty texts and items match nothing; rows
    without doc_id or item_id are left aside, since a match could not be named. Repeated documents
    are matched each, repeated items count once per id and text. Only doc_id, text and item_id, text
    are read.
    """
    spark = docs.sparkSession
    items = items.where("item_id is not null").select(F.col("item_id").cast("long"), text_bytes().alias("text")).distinct()
    queries = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    size = total_bytes(items.select(F.col("text")))
    words = F.filter(F.split(F.col("text").cast("string"), GAP), lambda w: w != "")
    items = items.withColumn("n", F.size(words)).withColumn("stride", F.expr(STRIDE))
    stats = {r["stride"]: r for r in items.groupBy("stride").agg(F.count("*").alias("n"), F.avg("n").alias("mean")).collect()}
    terms = items.mapInArrow(_item_terms, "stride int, item_id long, term long")
    frequency = terms.groupBy("stride", "term").agg(F.count("*").alias("df"))
    schema = "doc_id long, item_id long, passage long, score double, overlap double, question_overlap double, answer_overlap double"
    shards = max(1, -(-size // SHARD_BYTES))
    found = spark.createDataFrame([], schema)
    for shard in range(shards):
        chosen = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard)
        rows: dict[int, list] = defaultdict(list)
        for r in chosen.select("item_id", "text", "stride").collect():  # at most about SHARD_BYTES
            rows[r["stride"]].append(r)
        own = chosen.mapInArrow(_item_terms, "stride int, item_id long, term long").select("stride", "term").distinct()
        df: dict[int, dict] = defaultdict(dict)
        for r in frequency.join(own, ["stride", "term"], "left_semi").collect():
            df[r["stride"]][r["term"]] = r["df"]
        indexes = [_build(rows[s], df[s], stats[s]["n"], stats[s]["mean"] or 0.0, s) for s in sorted(rows)]
        if indexes:
            found = found.unionByName(queries.mapInArrow(_search(indexes), schema))
    best = F.struct("overlap", "score", -F.col("passage"))
    columns = ["passage", "score", "overlap", "question_overlap", "answer_overlap"]
    return found.groupBy("doc_id", "item_id").agg(*(F.max_by(c, best).alias(c) for c in columns))


def _item_terms(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct word of each item once."""
    for batch in stream:
        hashes, counts = word_hashes(batch.column("text").to_pylist())
        owner = np.repeat(np.arange(len(counts)), counts)
        terms = np.unique(np.rec.fromarrays([hashes, owner], names="term,owner"))
        places = pa.array(terms["owner"].astype(np.int64))
        columns = [batch.column("stride").take(places), batch.column("item_id").take(places), pa.array(terms["term"].copy().view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, ["stride", "item_id", "term"])

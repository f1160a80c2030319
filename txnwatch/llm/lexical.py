"""Ranked lexical search: the best documents of each item, with norm buckets of impact vectors.

A document is a vector with one coordinate per query term it holds, the term's weight times its damped
frequency; an item is the vector with 1 at each of its terms, so a score is their product.

1. One pass over the texts counts words and query terms; the counts (not the texts) are written. The
   collection's numbers and the document frequencies are aggregated from there.
2. Tasks read the counts in slabs of at most ``SLAB_ENTRIES`` coordinates, order a slab's vectors by length
   and cut them into buckets of ``BUCKET`` vectors, longest first. For an item with the threshold t, its
   k-th best score so far:
   * a bucket whose longest vector times the item's length is below t is skipped, and with it all
     shorter ones (Cauchy-Schwarz); so is one whose largest coordinates of the item's terms add up to less;
   * inside, the coordinates on the half of the item's terms with the largest bucket maxima are added up;
     what the others can still add is bounded by their maxima and by the length that is left over
     (Cauchy-Schwarz again). Vectors that cannot reach t go;
   * the survivors are scored in 64-bit integers.
3. A first round looks at the longest bucket of every slab only, so that all tasks start the second round
   with the k-th best score of the whole collection's longest vectors.
4. Each task hands on at most k rows per item; a window keeps the best k of them.

Nothing but counts and those rows is shuffled. Items are taken in blocks of about ``ITEM_BYTES`` of text, which
bounds what is broadcast; each block is one pass over the documents.

Rows without a term score nothing. Null texts have no term. Every row of documents and items counts as one
of its own, also if repeated; a null doc_id comes last among equal scores. Empty tables give no
rows. Only ids and texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import stored, text_bytes, total_bytes

BEST = 10
BUCKET = 2048
SLAB_ENTRIES = 4 << 20
ITEM_BYTES = 16 << 20
PIECE_BYTES = 4 << 20  # of a long text that are split into words at once
ROUNDING = 1 + 1e-9  # doubles only prune, and never by less than their own error
NO_ID = (1 << 63) - 1

# Words: maximal runs of ASCII letters, digits and bytes of other characters; only A-Z is lower-cased.
_TO_WORDS = bytearray(b" " * 128 + bytes(range(128, 256)))
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _TO_WORDS[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TO_WORDS[_c] = _c + 32
COUNTS = "doc_id long, n long, terms array<int>, tfs array<int>"
FOUND = "item int, doc_id long, score long"


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


@dataclass
class Items:
    """The items of one block: terms by number, and for each item its terms."""

    ids: list[int]
    vocabulary: dict[bytes, int]
    terms: np.ndarray  # of all items, one after the other
    starts: np.ndarray  # of each item in `terms`, and the end


def best_documents(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its ``best`` highest scores above 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    kind = dict(items.dtypes)["item_id"]
    numbered = items.select("item_id", text_bytes().alias("text"), F.monotonically_increasing_id().alias("number"))
    numbered = stored(numbered, "items")
    blocks = max(1, -(-total_bytes(numbered.select(F.col("text"))) // ITEM_BYTES))
    found = []
    for block in range(blocks):
        rows = numbered.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).select("number", "text").collect()
        ranked = _block(docs, _items([(r["number"], bytes(r["text"])) for r in rows]), best)
        found.append(stored(ranked, "ranked") if blocks > 1 else ranked)
    ranked = reduce(DataFrame.unionByName, found)
    names = numbered.select(F.col("item_id").cast(kind).alias("item_id"), "number")
    return ranked.join(names, "number").select("item_id", "rank", "doc_id", "score")


def _items(rows: list[tuple[int, bytes]]) -> Items:
    vocabulary: dict[bytes, int] = {}
    terms, starts = [], [0]
    for _, text in rows:
        terms += sorted({vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)})
        starts.append(len(terms))
    return Items([n for n, _ in rows], vocabulary, np.array(terms, np.int64), np.array(starts))


def _block(docs: DataFrame, items: Items, best: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(items.vocabulary)
    counts = stored(docs.mapInArrow(_counter(vocabulary), COUNTS), "counts")
    whole = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    frequency = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # query terms only
    weights = np.zeros(len(items.vocabulary) + 1, np.int64)
    for r in frequency:
        weights[r["term"]] = math.floor(1000 * math.log((2 * whole.documents + 2) / (2 * r["count"] + 1)))
    search = spark.sparkContext.broadcast((items.terms, items.starts, weights, whole.documents, whole.words))
    holding = counts.where(F.size("terms") > 0)

    none = np.ones(len(items.ids), np.int64)  # a score of 0 is no result
    first = _kept(holding.mapInArrow(_scorer(search, best, none, True), FOUND), best).where(F.col("rank") == best)
    least = none.copy()
    for r in first.select("item", "score").collect():
        least[r["item"]] = max(1, r["score"])
    found = _kept(holding.mapInArrow(_scorer(search, best, least, False), FOUND), best)
    numbers = spark.createDataFrame(list(enumerate(items.ids)), "item int, number long")
    return found.join(numbers, "item").select("number", "rank", "doc_id", "score")


def _kept(found: DataFrame, best: int) -> DataFrame:
    rank = F.expr("row_number() over (partition by item order by score desc, doc_id asc nulls last)")
    return found.withColumn("rank", rank).where(F.col("rank") <= best)


def _counter(vocabulary):
    """Texts to counts: all words, and the query's terms with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value.get
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column("text"):
                text = text.as_buffer().to_pybytes()
                total, hits = 0, []
                for piece in _pieces(text):
                    own = words(piece)
                    total += len(own)
                    hits += filter(None, map(known, own))
                term, tf = np.unique(np.array(hits, np.int32), return_counts=True)
                n.append(total)
                terms.append(term)
                tfs.append(tf.astype(np.int32))
            ends = np.cumsum([0, *map(len, terms)], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *x]))) for x in (terms, tfs)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts, cut where no word is."""
    start = 0
    while len(text) - start > PIECE_BYTES:
        end = start + PIECE_BYTES
        while end < len(text) and _TO_WORDS[text[end]] != 32:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:]


def _scorer(search, best: int, least: np.ndarray, longest_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = Top(len(least), best, least)
        for slab in _slabs(batches):
            _score(slab, *search.value, top, longest_only)
        yield from top.batches()

    return run


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, entries = [], 0
    for batch in batches:
        for start in range(0, len(batch), 4096):
            part = batch.slice(start, 4096)
            held.append(part)
            entries += len(part.column("terms").flatten()) + len(part)
            if entries >= SLAB_ENTRIES:
                yield pa.Table.from_batches(held)
                held, entries = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Top:
    """The best rows of each item so far, and the score from which a row still matters."""

    def __init__(self, items: int, best: int, least: np.ndarray):
        self.best, self.least = best, least.copy()
        self.rows: list[tuple[np.ndarray, np.ndarray] | None] = [None] * items

    def add(self, item: int, docs: np.ndarray, scores: np.ndarray) -> None:
        if self.rows[item] is not None:
            docs, scores = np.concatenate([self.rows[item][0], docs]), np.concatenate([self.rows[item][1], scores])
        order = np.lexsort((docs, -scores))[: self.best]
        self.rows[item] = docs[order], scores[order]
        if len(order) == self.best:
            self.least[item] = max(self.least[item], scores[order[-1]])

    def batches(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.rows), 4096):
            own = [(i, *r) for i, r in enumerate(self.rows[start : start + 4096], start) if r is not None]
            if own:
                items = np.repeat(np.array([i for i, _, _ in own], np.int32), [len(d) for _, d, _ in own])
                docs, scores = np.concatenate([d for _, d, _ in own]), np.concatenate([s for _, _, s in own])
                ids = pa.array(docs, pa.int64(), mask=docs == NO_ID)
                yield pa.record_batch([pa.array(items), ids, pa.array(scores)], names=["item", "doc_id", "score"])


def _score(slab: pa.Table, item_terms, starts, weights, documents: int, all_words: int, top: Top, longest_only: bool) -> None:
    slab = slab.combine_chunks()
    ids = slab.column("doc_id").fill_null(NO_ID).to_numpy()
    n = slab.column("n").to_numpy()
    lists = slab.column("terms").combine_chunks()
    terms = lists.flatten().to_numpy().astype(np.int64)
    tfs = slab.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
    m = np.array([10 + 90 * x * documents // all_words for x in n.tolist()], np.int64)
    impacts = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 8 * m[owner]))
    lengths = np.sqrt(np.bincount(owner, impacts.astype(float) ** 2, minlength=len(ids)))
    order = np.argsort(-lengths, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    bucket = place[owner] // BUCKET
    by_bucket = np.lexsort((terms, bucket))  # entries by bucket, then by term
    terms, impacts, places, bucket = terms[by_bucket], impacts[by_bucket], place[owner[by_bucket]], bucket[by_bucket]
    edges = np.searchsorted(bucket, np.arange(-(-len(ids) // BUCKET) + 1))
    for b in range(1 if longest_only else len(edges) - 1):
        first, last = b * BUCKET, min(len(ids), (b + 1) * BUCKET)
        span = slice(edges[b], edges[b + 1])
        posted = np.searchsorted(terms[span], np.arange(len(weights) + 1))
        own = order[first:last]
        if not _bucket(ids[own], lengths[own], impacts[span], places[span] - first, posted, item_terms, starts, top):
            break


def _bucket(ids, lengths, impacts, places, posted, item_terms, starts, top: Top) -> bool:
    """Score one bucket against all items; False if not even its longest vector matters to any."""
    sizes = np.diff(starts)
    reachable = lengths[0] * np.sqrt(sizes) * ROUNDING >= top.least
    if not reachable.any():
        return False
    maxima = np.zeros(len(posted) - 1, np.int64)
    held = np.flatnonzero(np.diff(posted))
    maxima[held] = np.maximum.reduceat(impacts, posted[held])
    summed = np.concatenate(([0], np.cumsum(maxima[item_terms])))
    reachable &= summed[starts[1:]] - summed[starts[:-1]] >= top.least
    squares = impacts.astype(float) ** 2
    for item in np.flatnonzero(reachable).tolist():
        least = top.least[item]
        terms = item_terms[starts[item] : starts[item + 1]]
        terms = terms[maxima[terms] > 0]
        terms = terms[np.argsort(-maxima[terms], kind="stable")]
        focus, rest = np.split(terms, [-(-len(terms) // 2)])
        scores, used = np.zeros(len(ids), np.int64), np.zeros(len(ids))
        for t in focus.tolist():
            span = slice(posted[t], posted[t + 1])
            scores[places[span]] += impacts[span]
            used[places[span]] += squares[span]
        left = np.sqrt(len(rest) * np.maximum(lengths**2 * ROUNDING - used, 0))
        still = np.minimum(left * ROUNDING, maxima[rest].sum())
        alive = scores + still >= least
        if not alive.any():
            continue
        for t in rest.tolist():
            span = slice(posted[t], posted[t + 1])
            scores[places[span]] += impacts[span]
        chosen = np.flatnonzero(alive & (scores >= least))
        if len(chosen):
            top.add(item, ids[chosen], scores[chosen])
    return True

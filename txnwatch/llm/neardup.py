"""Near-duplicates: universal hash minima, banding, verification, connected components.

1. One pass turns every text into its set of five-word shingles (64-bit hashes), a set id, and the
   minima of ``HASHES`` universal hash functions over the set. Equal sets collapse to one id before
   anything is compared, so thousands of exact copies cost one row.
2. Band hashes are grouped. In each band bucket every set is compared with one pivot only, the one
   it shares most bands with; verified links give first components.
3. With ``BANDS`` bands of ``ROWS`` minima a pair at the threshold shares a bucket with probability
   1 - (1 - 0.75**3)**40 = 1 - 3e-10. Sets in buckets that still hold several components may have a
   link that the pivots missed. All pairs of such a bucket would be too many (thousands of texts may
   share a passage without being alike), so they take an exact way: similar sets share one of their
   first ``n - ceil(0.75 n) + 1`` shingles in any common order. The order puts frequent shingles
   last, and only pairs across components are formed.
4. A link is confirmed by the share of equal minima first (a pair at the threshold falls below
   ``SIGNATURE_MIN`` with probability under 1e-8), then on the full sets.

Every wide table is written to the shared folder before it is joined; joins on bucket, set or id are
plain shuffled joins, whose hot keys adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.components import components
from txnwatch.llm.shared import BATCH_ROWS, stored, text_bytes
from txnwatch.llm.words import batches, give_back, mixed, shingles, word_hashes

WORDS = 5
BANDS, ROWS = 40, 3
HASHES = BANDS * ROWS
SIMILARITY_PCT = 75
SIGNATURE_MIN = HASHES // 2
BATCH_BYTES = 1 << 19  # a worker keeps the memory that its largest arrays took
FREQUENT_FROM, FREQUENT_SETS, FREQUENT_MAX = 4, 20_000, 500_000

_RANDOM = np.random.default_rng(75_005)
_FACTOR = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def _sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles per text, sorted within the text, and how many."""
    values, counts = shingles(*word_hashes(texts), WORDS)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[first], np.bincount(owner[first], minlength=len(texts))


def _set_ids(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit id per set: equal for equal sets; 0 for an empty one."""
    some = np.flatnonzero(counts)
    ids = np.zeros(len(counts), np.int64)
    if len(some):
        starts = np.concatenate(([0], np.cumsum(counts)))[some]
        together = np.add.reduceat(mixed(values), starts) + mixed(counts[some].astype(np.uint64))
        ids[some] = mixed(together).view(np.int64)
    return ids


def _minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One row of 32-bit minima per non-empty set; universal hashing by multiply, add and shift."""
    out = np.empty((len(starts), HASHES), np.uint32)
    for i in range(HASHES):
        hashed = values * _FACTOR[i]
        hashed += _SHIFT[i]
        hashed >>= np.uint64(32)
        out[:, i] = np.minimum.reduceat(hashed, starts)
    return out


def _bands(minima: np.ndarray) -> np.ndarray:
    parts = minima.astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    key = np.broadcast_to(_BAND, (len(minima), BANDS))
    for r in range(ROWS):
        key = mixed(key ^ parts[:, :, r])
    return key.astype(np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
    texts = batch.column("text").to_pylist()
    for a, b in batches(texts, BATCH_BYTES):
        yield a, texts[a:b]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def _describe(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: number of shingles, set id (null for the empty set), band hashes."""
    for batch in stream:
        for at, texts in _texts(batch):
            values, counts = _sets(texts)
            starts = np.concatenate(([0], np.cumsum(counts)))[np.flatnonzero(counts)]
            ids = _set_ids(values, counts)
            bands = _bands(_minima(values, starts)) if len(starts) else np.empty((0, BANDS), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(at, len(texts)),
                    pa.array(counts.astype(np.int64)),
                    pa.array(ids, mask=counts == 0),
                    _lists(bands.ravel(), np.where(counts > 0, BANDS, 0), pa.int64()),
                ],
                ["doc_id", "n_shingles", "set_id", "bands"],
            )
    give_back()


def _full(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: the minima and the whole set."""
    for batch in stream:
        for at, texts in _texts(batch):
            values, counts = _sets(texts)
            starts = np.concatenate(([0], np.cumsum(counts)))[np.flatnonzero(counts)]
            minima = _minima(values, starts) if len(starts) else np.empty((0, HASHES), np.uint32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_set_ids(values, counts), mask=counts == 0),
                    _lists(minima.ravel().view(np.int32), np.where(counts > 0, HASHES, 0), pa.int32()),
                    _lists(values.view(np.int64), counts, pa.int64()),
                ],
                ["set_id", "minima", "shingles"],
            )
    give_back()


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set ids whose sets are similar enough."""
    left = sets.selectExpr("set_id as a", "minima as a_minima", "shingles as a_set")
    right = sets.selectExpr("set_id as b", "minima as b_minima", "shingles as b_set")
    equal = "aggregate(zip_with(a_minima, b_minima, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x)"
    shared = "size(array_intersect(a_set, b_set))"
    union = f"(size(a_set) + size(b_set) - {shared})"
    exact = f"100L * {shared} >= {SIMILARITY_PCT}L * {union}"
    sizes = f"100L * least(size(a_set), size(b_set)) >= {SIMILARITY_PCT}L * greatest(size(a_set), size(b_set))"
    joined = pairs.join(right, "b").join(left, "a")
    return joined.where(f"case when not ({sizes}) then false when {equal} < {SIGNATURE_MIN} then false else {exact} end").select("a", "b")


def _frequent(sets: DataFrame) -> np.ndarray:
    """Frequent shingles, sorted: those in at least ``FREQUENT_FROM`` of ``FREQUENT_SETS`` sets looked at.

    At most ``FREQUENT_MAX`` are sent to the tasks. What is in here affects the order in which
    shingles are taken, and so the work, but no result.
    """
    share = max(1, sets.count() // FREQUENT_SETS)
    some = sets.where(F.pmod(F.xxhash64("set_id"), F.lit(share)) == 0)
    counts = some.select(F.explode("shingles").alias("s")).groupBy("s").count().where(F.col("count") >= FREQUENT_FROM)
    rows = counts.orderBy(F.desc("count"), "s").limit(FREQUENT_MAX).select("s").toArrow()
    return np.sort(rows.column("s").to_numpy())


def _prefixes(frequent: np.ndarray):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = batch.column("shingles")
            counts = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(counts)), counts)
            late = np.zeros(len(values), bool)
            if len(frequent):
                late = frequent[np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)] == values
            order = np.lexsort((values, late, owner))
            rank = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
            taken = counts - -(-SIMILARITY_PCT * counts // 100) + 1
            first = values[order][rank < taken[owner]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_id"), batch.column("component"), pa.array(counts.astype(np.int32)), _lists(first, np.minimum(taken, counts), pa.int64())],
                ["set_id", "component", "n", "prefix"],
            )

    return run


def _across(still: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different components that can be similar: all of them, and few others."""
    members = still.join(sets.select("set_id", "shingles"), "set_id")
    prefixes = members.mapInArrow(_prefixes(_frequent(sets)), "set_id long, component long, n int, prefix array<long>")
    rows = stored(prefixes, "prefixes").selectExpr("set_id", "component", "n", "posexplode(prefix) as (at, key)")
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("m"))
    keys = parts.groupBy("key").agg(
        F.max_by("component", F.struct("m", "component")).alias("major"), F.count("*").alias("parts")
    )
    keys = stored(keys.where("parts > 1").select("key", "major"), "shared-keys")
    rows = stored(rows.join(keys, "key"), "shared-prefixes")
    # The largest component of a key is not compared with itself, however large it is.
    minor = rows.where("component <> major").selectExpr("key", "set_id as a", "component as a_component", "n as a_n", "at as a_at")
    other = rows.selectExpr("key", "set_id as b", "component as b_component", "n as b_n", "at as b_at")
    # At its first common shingle a similar pair still has enough shingles ahead on both sides.
    ahead = "least(a_n - a_at, b_n - b_at)"
    pairs = minor.join(other, "key").where(
        f"a_component <> b_component and {100 + SIMILARITY_PCT}L * {ahead} >= {SIMILARITY_PCT}L * (a_n + b_n)"
    )
    return stored(pairs.selectExpr("least(a, b) as a", "greatest(a, b) as b").distinct(), "pairs-across")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text).

    Documents are linked when 100 * shared shingles >= 75 * all shingles of the two; component_id is
    the smallest doc_id reachable over links, and the document with that id is kept. A null, empty or
    blank text has no shingle and no link. Rows that repeat an id are rows of one document: their
    links come together. A row without id stays without links: component_id is null and it is kept.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    described = stored(
        texts.mapInArrow(_describe, "doc_id long, n_shingles long, set_id long, bands array<long>"), "described", BATCH_ROWS
    )
    some = described.where("set_id is not null and doc_id is not null")
    # The least document of a set stands for it.
    sets = some.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min_by("bands", "doc_id").alias("bands"))
    sets = stored(sets, "distinct-sets")
    bands = sets.selectExpr("set_id", "explode(bands) as bucket")
    sets = sets.select("set_id", "doc_id")
    buckets = stored(bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = stored(bands.join(buckets, "bucket"), "shared-bands")

    wanted = shared.select("set_id").distinct().join(sets, "set_id").select("doc_id")
    candidates = texts.join(wanted, "doc_id", "left_semi").select("text")
    candidates = stored(
        candidates.mapInArrow(_full, "set_id long, minima array<int>, shingles array<long>"), "candidate-sets", BATCH_ROWS
    )

    # The pivot of a bucket is its member that meets most sets over all bands: the text that the
    # copies were made from, where it is there, is closer to each than they are to each other.
    weights = stored(shared.groupBy("set_id").agg(F.sum("n").alias("met")), "met")
    pivots = shared.select("bucket", "set_id").join(weights, "set_id").groupBy("bucket")
    pivots = stored(pivots.agg(F.max(F.struct("met", "set_id")).alias("top")).selectExpr("bucket", "top.set_id as pivot"), "pivots")
    stars = shared.join(pivots, "bucket").where("set_id <> pivot").groupBy("set_id", "pivot").agg(F.count("*").alias("n"))
    stars = stars.groupBy("set_id").agg(F.max_by("pivot", F.struct("n", "pivot")).alias("pivot"))
    links = stored(_confirmed(stars.selectExpr("pivot as a", "set_id as b"), candidates), "links")

    first = components(links.selectExpr("a as u", "b as v"))
    placed = shared.join(first.withColumnRenamed("node", "set_id"), "set_id", "left").selectExpr(
        "bucket", "set_id", "coalesce(component, set_id) as component"
    )
    placed = stored(placed, "placed")
    open_buckets = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_buckets = stored(open_buckets.where("lo < hi").select("bucket"), "open-buckets")
    still = placed.join(open_buckets, "bucket", "left_semi").select("set_id", "component").distinct()
    links = links.unionByName(_confirmed(_across(stored(still, "still-open"), candidates), candidates))

    ids = sets.withColumnRenamed("doc_id", "id")
    edges = links.join(ids.selectExpr("set_id as a", "id as u"), "a").join(ids.selectExpr("set_id as b", "id as v"), "b")
    copies = some.select("doc_id", "set_id").join(ids, "set_id").where("doc_id <> id").selectExpr("doc_id as u", "id as v")
    reached = components(edges.select("u", "v").unionByName(copies)).withColumnRenamed("node", "doc_id")
    return (
        described.select("doc_id", "n_shingles")
        .join(reached, "doc_id", "left")
        .selectExpr("doc_id", "n_shingles", "coalesce(component, doc_id) as component_id")
        .selectExpr("*", "coalesce(doc_id = component_id, true) as kept")
    )


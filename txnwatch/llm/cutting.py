"""Packing by cutting-stock column generation.

Documents become token ids and are cut at every ``CAPACITY`` ids; what is left over is a piece of
1 to ``CAPACITY`` - 1 ids. Pieces are stock lengths to be cut from sequences:

1. Lengths are rounded up to units of ``UNIT`` ids, which leaves at most ``CLASSES`` classes however many
   documents there are. Pieces under ``SMALL`` ids, where that would waste much, keep their exact length
   (from ``FINE`` ids on, to ``FINE_UNIT`` ids): they are first packed into blocks of ``BLOCK`` ids by a program of their own, and a block is a
   piece to the program of the sequences. The histograms, one number per class, are all that
   reaches the driver.
2. The linear program "fewest sequences that hold every class as often as demanded" runs over
   patterns (how many pieces of each class share a sequence). Starting from one-class patterns, a
   knapsack dynamic program prices new patterns with the dual values, until none has a reduced cost.
3. Pattern counts are rounded down; the few pieces left go by first fit decreasing on class counts,
   which adds at most as many patterns as there are classes.
4. Every piece gets its rank within its class, counted in buckets so that no class has to fit into
   one task, and the rank says which sequence it belongs to. Offsets come from the real lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import BATCH_ROWS, stored
from txnwatch.llm.tokens import END_ID, encode, vocabulary_path
from txnwatch.llm.words import give_back, slices

CAPACITY = 4096
UNIT = 16
CLASSES = CAPACITY // UNIT
SMALL, BLOCK = 256, 1024
FINE, FINE_UNIT = 64, 4
BLOCK_CLASS = BLOCK // UNIT
EXACT = CAPACITY  # classes of small pieces are numbered from here
BUCKET_PIECES = 1_000
BATCH_BYTES = 2 << 20
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _cut(path: str, keep_ids: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        for batch in stream:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for a, b in slices(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
                rows = []
                for doc, encoded in zip(ids[a:b], encode(texts[a:b].to_pylist(), path)):
                    encoded += end
                    n = len(encoded) // 4
                    for start in range(0, n, CAPACITY):
                        part = encoded[4 * start : 4 * (start + CAPACITY)]
                        rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, part if keep_ids else None))
                columns = list(zip(*rows))[: 6 if keep_ids else 5]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.binary() if i == 5 else pa.int64()) for i, c in enumerate(columns)], names[: len(columns)]
                )
        give_back()

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document, with their ids as little-endian 32-bit binary on request."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_cut(vocabulary or vocabulary_path(), keep_ids), _PIECE + (", ids binary" if keep_ids else ""))


class _Prices:
    """The unbounded knapsack: how often each class is cut from ``size`` units for the most value."""

    def __init__(self, widths: np.ndarray, size: int) -> None:
        self.widths, self.size = widths, size
        rest = np.arange(size + 1)[:, None] - widths
        self.rest, self.fits = np.maximum(rest, 0), rest >= 0

    def best(self, values: np.ndarray) -> np.ndarray:
        best, choice = np.zeros(self.size + 1), np.full(self.size + 1, -1)
        offered = np.where(self.fits, values, -np.inf)
        for room in range(1, self.size + 1):
            gain = best[self.rest[room]] + offered[room]
            i = gain.argmax()
            best[room] = best[room - 1]
            if gain[i] > best[room] + 1e-12:
                best[room], choice[room] = gain[i], i
        pattern, room = np.zeros(len(self.widths), np.int64), self.size
        while room > 0:
            if choice[room] < 0:
                room -= 1
            else:
                pattern[choice[room]] += 1
                room -= self.widths[choice[room]]
        return pattern


REFRESH = 64  # steps after which the basis is inverted anew


def plan_patterns(demand: np.ndarray, size: int = CLASSES, rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how many sequences use each, holding exactly ``demand[w - 1]`` pieces of w units.

    The program is solved by the simplex method with generated columns; ``rounds`` bounds its steps,
    after which the patterns found so far are used: they hold every piece too.
    """
    widths = np.flatnonzero(demand) + 1
    if not len(widths):
        return []
    need = demand[widths - 1].astype(float)
    patterns = [np.eye(len(widths), dtype=np.int64)[i] * (size // w) for i, w in enumerate(widths)]
    basis = np.array(patterns, float).T
    prices, ones = _Prices(widths, size), np.ones(len(widths))
    for step in range(rounds):
        if step % REFRESH == 0:
            inverse = np.linalg.inv(basis)
            amounts = np.maximum(inverse @ need, 0)
        duals = ones @ inverse
        new = prices.best(duals)
        if duals @ new <= 1 + 1e-9:
            break
        direction = inverse @ new
        enters = np.flatnonzero(direction > 1e-9)
        ratio = amounts[enters] / direction[enters]
        out = int(enters[ratio.argmin()])
        amount = float(ratio.min())
        amounts = np.maximum(amounts - amount * direction, 0)
        amounts[out] = amount
        patterns[out] = new
        basis[:, out] = new
        inverse[out] /= direction[out]
        others = direction.copy()
        others[out] = 0
        inverse -= others[:, None] * inverse[out]
    amounts = np.maximum(np.linalg.solve(basis, need), 0)

    plan, left = [], demand[widths - 1].copy()
    for pattern, amount in zip(patterns, np.floor(amounts + 1e-9).astype(np.int64)):
        fits = [left[i] // pattern[i] for i in np.flatnonzero(pattern)]
        amount = int(min([amount, *fits]))
        if amount > 0:
            plan.append((pattern, amount))
            left -= amount * pattern
    return [(_spread(p, widths, size), n) for p, n in plan + _first_fit(left, widths, size)]


def _first_fit(left: np.ndarray, widths: np.ndarray, size: int) -> list[tuple[np.ndarray, int]]:
    """First fit decreasing on class counts: fill one sequence, use it as often as the counts allow."""
    plan, left = [], left.copy()
    while left.any():
        pattern, room = np.zeros(len(widths), np.int64), size
        for i in range(len(widths) - 1, -1, -1):
            pattern[i] = min(left[i], room // widths[i])
            room -= pattern[i] * widths[i]
        amount = int(min(left[i] // pattern[i] for i in np.flatnonzero(pattern)))
        plan.append((pattern, amount))
        left -= amount * pattern
    return plan


def _spread(pattern: np.ndarray, widths: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    out[widths - 1] = pattern
    return out


def _slots(plan: list[tuple[np.ndarray, int]], size: int = CLASSES, base: int = 0) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, ranks per sequence, first sequence, ranks) for each class of each pattern."""
    taken, sequence, rows = np.zeros(size, np.int64), 0, []
    for pattern, amount in plan:
        for c in np.flatnonzero(pattern).tolist():
            rows.append((base + c + 1, int(taken[c]), int(pattern[c]), sequence, int(amount * pattern[c])))
            taken[c] += amount * pattern[c]
        sequence += amount
    return rows


def pack(docs: DataFrame, vocabulary: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold at most ``CAPACITY`` ids and are padded to it. A null or empty text is one piece
    with the end id alone. Repeated rows are packed each, rows without a doc_id too. Columns other
    than doc_id and text are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = stored(
        pieces(docs, vocabulary, keep_ids).selectExpr(
            "*",
            f"cast(case when length < {FINE} then {EXACT} + length "
            f"when length < {SMALL} then {EXACT} + {FINE_UNIT} * ceil(length / {FINE_UNIT}) "
            f"else ceil(length / {UNIT}) end as int) as class",
            "monotonically_increasing_id() as piece",
        ),
        "pieces",
        BATCH_ROWS,
    )
    counts = {r["class"]: r["count"] for r in cut.groupBy("class").count().collect()}  # CLASSES + SMALL rows
    small = np.array([counts.get(EXACT + n, 0) for n in range(1, BLOCK + 1)], np.int64)
    blocks = plan_patterns(small, BLOCK)
    demand = np.array([counts.get(c, 0) for c in range(1, CLASSES + 1)], np.int64)
    first_block = int(demand[BLOCK_CLASS - 1])  # blocks come after the pieces of their class
    demand[BLOCK_CLASS - 1] += sum(amount for _, amount in blocks)
    slots = _slots(plan_patterns(demand)) + _slots(blocks, BLOCK, EXACT)

    # Ranks within a class: bucket by bucket, buckets being small enough for one task's sort.
    buckets = max(1, -(-max(counts.values(), default=0) // BUCKET_PIECES))
    bucketed = cut.withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(buckets)))
    sizes = bucketed.groupBy("class", "bucket").agg(F.count("*").alias("n"))
    before = stored(
        sizes.selectExpr("class", "bucket", "sum(n) over (partition by class order by bucket) - n as before"), "rank-starts"
    )
    ranked = bucketed.selectExpr("*", "row_number() over (partition by class, bucket order by piece) - 1 as local_rank")
    ranked = ranked.join(before, ["class", "bucket"]).selectExpr("*", "before + local_rank as rank")

    # At most CLASSES patterns of the program and as many of the rest, CLASSES entries each.
    table = spark.createDataFrame(slots, "class int, first long, per long, first_sequence long, ranks long")
    by_class = table.groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("first", "per", "first_sequence", "ranks"))).alias("runs")
    )
    def number(runs: str, rank: str) -> str:
        run = f"get(filter({runs}, r -> r.first <= {rank} and {rank} < r.first + r.ranks), 0)"
        return f"get(transform(array({run}), r -> r.first_sequence + ({rank} - r.first) div r.per), 0)"

    # A small piece's number is that of its block, which has a place among the pieces of its class.
    of_blocks = by_class.where(F.col("class") == BLOCK_CLASS).select(F.lit(True).alias("in_block"), F.col("runs").alias("block_runs"))
    placed = (
        ranked.join(F.broadcast(by_class), "class")
        .selectExpr("*", f"class > {EXACT} as in_block", f"{number('runs', 'rank')} as own")
        .join(F.broadcast(of_blocks), "in_block", "left")
        .selectExpr("*", f"own + {first_block} as block_rank")
        .selectExpr("*", f"if(in_block, {number('block_runs', 'block_rank')}, own) as sequence_id")
    )
    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if keep_ids else [])]
    return placed.selectExpr(
        *kept, "sequence_id", "sum(length) over (partition by sequence_id order by class desc, rank) - length as offset"
    )

"""Token-id output: best-fit-decreasing packing with a segment tree over free capacity.

Documents become token ids plus an end id; documents longer than a sequence are cut at every
``CAPACITY`` ids, so nothing is lost. Pieces are dealt by hash into groups of about ``GROUP_BYTES``
of text, each packed by one task: longest first, into the open sequence with the least free room
that still takes it. The segment tree has a leaf per free capacity, so finding that room takes
log2(capacity) steps however many sequences are open. Groups are small against the data and large
against a sequence: only the last sequences of a group stay partly empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.cutting import CAPACITY, pieces
from txnwatch.llm.shared import total_bytes

GROUP_BYTES = 2 << 20
PAD_ID = 0
SCHEMA = (
    "sequence_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, starts array<long>"
)


class FreeRoom:
    """Open sequences by free capacity; finds the least capacity that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << (capacity + 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, change: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += change
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The open sequence with the least room of at least ``need``: (room, sequence)."""
        node = need + self.leaves
        while not self.count[node]:
            while node & 1:  # a right child: its subtree and all left of it are done
                node >>= 1
                if not node:
                    return None
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of this level
                return None
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Positions of ``lengths`` per sequence; lengths of 1 to ``capacity``, ties in given order."""
    free, sequences = FreeRoom(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = free.take(lengths[i])
        if found is None:
            found = capacity, len(sequences)
            sequences.append([])
        room, s = found
        sequences[s].append(i)
        if room > lengths[i]:
            free.put(room - lengths[i], s)
    return sequences


def _pack(key: tuple, stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    group = key[0].as_py()
    table = pa.Table.from_batches(list(stream)).sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    lengths, ids = table.column("length").to_pylist(), table.column("ids").to_pylist()
    docs, starts = table.column("doc_id").to_pylist(), table.column("start").to_pylist()
    sequences = best_fit(lengths)
    for a in range(0, len(sequences), 64):
        rows = []
        for number, members in enumerate(sequences[a : a + 64], a):
            ends = np.cumsum([lengths[i] for i in members])
            position = np.concatenate([np.arange(lengths[i], dtype="<u4") for i in members] + [np.zeros(CAPACITY - ends[-1], "<u4")])
            row = b"".join(ids[i] for i in members) + np.full(CAPACITY - ends[-1], PAD_ID, "<u4").tobytes()
            rows.append(
                ((group << 24) | number, int(ends[-1]), row, [0, *ends.tolist()], position.tobytes(),
                 [docs[i] for i in members], [starts[i] for i in members])
            )
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["sequence_id", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "starts"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def packed_ids(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row per sequence: a row of the packed id matrix and how it is divided.

    input_ids and position_ids are rows of ``CAPACITY`` little-endian unsigned 32-bit integers, padded
    with ``PAD_ID``; position_ids restart at 0 with each segment; cu_seqlens are the cumulative segment
    lengths from 0 to n_tokens; doc_ids and starts say which ids of which document a segment holds.
    A null or empty text is one segment with the end id. Repeated rows are packed each. An empty table
    gives no rows. Other columns are not read.
    """
    groups = max(1, -(-total_bytes(docs.select("text")) // GROUP_BYTES))
    cut = pieces(docs, vocabulary, keep_ids=True)
    grouped = cut.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return grouped.groupBy("pack_group").applyInArrow(_pack, SCHEMA)


def write_matrices(packed: DataFrame, path: str) -> None:
    """Write the rows as Parquet: fixed-width binary rows, ready to be read as matrices."""
    packed.write.parquet(path)

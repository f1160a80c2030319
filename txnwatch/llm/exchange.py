"""Hash-partitioned exchange of sorted key arrays between chunks of documents.

A chunk is a group of documents of bounded size, dealt by hash. Each chunk sends the distinct 64-bit
keys it holds, sorted, as one compressed array per key bucket; the owner of a bucket sees each key
once per chunk, however often it occurs there, and answers each chunk in the order of its array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import text_bytes, total_bytes

CHUNK_BYTES = 2 << 20
SENT = "chunk int, bucket int, keys binary, extra binary"
# Bits of a key that are sent behind the bucket's own: with some millions of keys a bucket, two keys
# of a bucket are mistaken for each other with probability under 1e-5.
KEY_BITS = 40


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text as bytes), and the bytes of all texts."""
    size = total_bytes(docs.select("text"))
    chunks = max(1, -(-size // chunk_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "*"), size


def bucket_bits(keys: int, keys_a_bucket: int = 2_000_000) -> int:
    """How many leading bits of a key name its bucket."""
    return max(0, int(np.ceil(np.log2(max(1, keys) / keys_a_bucket)))) if keys > keys_a_bucket else 0


def packed(array: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), -1).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def send(chunk: int, keys: np.ndarray, extra: np.ndarray, bits: int) -> pa.Table:
    """One row per bucket: the chunk's sorted distinct keys and what goes with them."""
    own = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    edges = np.searchsorted(own, np.arange((1 << bits) + 1, dtype=np.uint64))
    rows = []
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[bucket], edges[bucket + 1]
        rest = (keys[a:b] << np.uint64(bits)) >> np.uint64(64 - KEY_BITS)
        rows.append((chunk, bucket, packed(np.diff(rest, prepend=np.uint64(0))), packed(extra[a:b])))
    columns = list(zip(*rows)) or [[]] * 4
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["chunk", "bucket", "keys", "extra"])


def received(table: pa.Table, kind) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's rows: the chunks, in order; lengths; per entry the number of its key; and the extras."""
    table = table.sort_by("chunk")
    keys = [np.cumsum(unpacked(k, np.uint64), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    lengths = np.array([len(k) for k in keys])
    _, number = np.unique(np.concatenate(keys), return_inverse=True)
    extra = np.concatenate([unpacked(e, kind) for e in table.column("extra").to_pylist()])
    return table.column("chunk").to_pylist(), lengths, number, extra


def reply(table: pa.Table, chunks: list[int], lengths: np.ndarray, answers: np.ndarray, note: int = 0) -> pa.Table:
    """One row per chunk, answers in the order in which the chunk sent its keys."""
    bucket = table.column("bucket")[0].as_py()
    parts = np.split(answers, np.cumsum(lengths)[:-1])
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.int32()),
            "bucket": pa.array([bucket] * len(chunks), pa.int32()),
            "answers": pa.array([packed(p) for p in parts], pa.binary()),
            "note": pa.array([note] * len(chunks), pa.int64()),
        }
    )


REPLY = "chunk int, bucket int, answers binary, note long"


def answered(replies: pa.Table, kind) -> np.ndarray:
    """All answers of a chunk, in the order of its sorted keys."""
    replies = replies.sort_by("bucket")
    parts = [unpacked(a, kind) for a in replies.column("answers").to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind)

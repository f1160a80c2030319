"""WARC archives, index first.

Writing: the digest of every payload is computed, equal payloads are found by aggregation, and each
record is written as response or revisit into archives of one gzip member per record. The writer
returns an index row per record: archive, offset, length, URL and digest.

Reading: the wanted index rows are dealt by archive and stretch of it, sorted by offset, and
neighbouring byte ranges are read at once (up to ``RANGE_BYTES``), so a selection costs few reads and
no archive is read whole unless all of it is wanted.

Archives lie in the shared folder and are opened through ``pyarrow.fs``, which takes local paths and
URIs of common stores. A file appears under its name only when it is complete, and a task that runs
again writes the same bytes, so lost executors do no harm.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import new_path, stored

ARCHIVE_BYTES = 32 << 20
RANGE_BYTES, GAP_BYTES = 4 << 20, 64 << 10
STRETCH_BYTES = 1 << 20
MIN_REVISIT_BYTES = 0
INDEX = (
    "page_id long, url string, archive string, offset long, length long, payload_digest string, "
    "payload_bytes long, record_type string, refers_to long"
)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def _record(page_id, url, digest: str, refers_to, payload: bytes) -> bytes:
    """One WARC record. A revisit has no payload; its length and digest are those of the full one."""
    clean = "".join(c for c in url or "" if c > " ")  # a header is one line
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _write(folder: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _open(folder)
        body, rows = bytearray(), []
        names = ["page_id", "url", "archive", "offset", "length", "payload_digest", "payload_bytes", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def flush():
            # Named by what it holds: a repeated task gives the same name and bytes.
            name = hashlib.sha1(body).hexdigest() + ".warc.gz"
            part = f"{root}/{name}.{uuid.uuid4().hex}"
            with filesystem.open_output_stream(part, compression=None) as out:
                out.write(bytes(body))
            filesystem.move(part, f"{root}/{name}")
            columns = [pa.array(c, k) for c, k in zip(zip(*[(r[0], r[1], name, *r[2:]) for r in rows]), kinds)]
            body.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in stream:
            for page in batch.to_pylist():
                payload, refers_to = page["payload"], page["refers_to"]
                digest = _digest(payload)
                member = gzip.compress(_record(page["page_id"], page["url"], digest, refers_to, payload), 4, mtime=0)
                kind = "response" if refers_to is None else "revisit"
                rows.append((page["page_id"], page["url"], len(body), len(member), digest, len(payload), kind, refers_to))
                body += member
                if len(body) >= ARCHIVE_BYTES:
                    yield flush()
        if rows:
            yield flush()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> tuple[DataFrame, str]:
    """Write every row of ``pages`` (page_id, url, html) as a WARC record; returns (index, folder).

    Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one with the largest
    page_id is the response and the others revisit it; shorter ones are all responses. A null html is
    an empty payload, a null url an empty one. Rows that repeat the largest page_id are responses too;
    rows without page_id revisit an equal record that has one, and are responses where none has.
    Other columns are not read.
    """
    spark = pages.sparkSession
    folder = _uri(folder or new_path(spark, "archives"))
    filesystem, root = _open(folder)
    filesystem.create_dir(root, recursive=True)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumn("sha", F.sha2("payload", 256))
    long_enough = rows.where(F.octet_length("payload") >= min_revisit_bytes)
    groups = long_enough.groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    groups = stored(groups.select("sha", "last"), "equal-payloads")
    decided = rows.join(groups, "sha", "left").selectExpr(
        "page_id", "url", "payload", "case when last is not null and not page_id <=> last then last end as refers_to"
    )
    return stored(decided.mapInArrow(_write(folder), INDEX), "warc-index"), folder


def _read(folder: str):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = _open(folder)
        for batch in stream:
            wanted = batch.to_pylist()  # sorted by archive and offset
            at = 0
            while at < len(wanted):
                first, last = wanted[at], at
                end = first["offset"] + first["length"]
                while last + 1 < len(wanted):
                    after = wanted[last + 1]
                    if after["archive"] != first["archive"] or after["offset"] > end + GAP_BYTES or after["offset"] + after["length"] > first["offset"] + RANGE_BYTES:
                        break
                    last, end = last + 1, max(end, after["offset"] + after["length"])
                with filesystem.open_input_file(f"{root}/{first['archive']}") as source:
                    data = source.read_at(end - first["offset"], first["offset"])
                yield _parsed(wanted[at : last + 1], data, first["offset"])
                at = last + 1

    return run


def _parsed(rows: list[dict], data: bytes, start: int) -> pa.RecordBatch:
    out = []
    for row in rows:
        member = data[row["offset"] - start : row["offset"] - start + row["length"]]
        fields, payload = parse_record(zlib.decompress(member, wbits=31))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if fields["WARC-Type"] == "response" and _digest(payload) != digest:
            raise ValueError(f"damaged record at {row['archive']}:{row['offset']}")
        page, refers = (fields.get(k, "<urn:page:>")[10:-1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
        out.append((int(page) if page else None, fields["WARC-Target-URI"], payload, int(fields["X-Payload-Length"]), digest, fields["WARC-Type"], int(refers) if refers else None))
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` rows point to, as they stand in the archives.

    The payload of a revisit is empty; payload_bytes and payload_digest are those of the full payload.
    A record whose payload does not fit its digest raises. A selection of no rows gives no rows.
    """
    columns = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    wanted = index.selectExpr("archive", "offset", "length", f"offset div {STRETCH_BYTES} as stretch")
    dealt = wanted.repartition("archive", "stretch").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read(folder), columns)

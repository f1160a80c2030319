"""Repeated passages by a distributed merge sort of suffixes that knows common prefixes.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts in a document with a smaller
id. Sorting all suffixes of all documents would move every byte ``LENGTH`` times, so, as in prefix-
doubling string sorting, suffixes that cannot have a partner are told by hashes and never exchanged:

1. In every window of ``LENGTH`` bytes the gram of ``GRAM`` bytes with the least hash is the window's
   anchor. Equal windows have equal anchors. Gram hashes go to their owners, who answer which occur
   in several documents; all other windows are free of partners.
2. Consecutive windows with the same anchor form a block. Its suffix string is the text from the
   anchor on, followed by the text before it backwards. Equal blocks in a row (a periodic text) are one
   entry with a reach. Each chunk sorts its blocks into runs; of equal strings only those of the
   smallest document stay, the others are covered at once.
3. Runs are front-coded (length of the prefix shared with the predecessor, rest), cut at splitters
   into ranges and exchanged. Each range is merged by a loser tree: entries whose known common prefix
   with the last winner differs are ordered by that length alone, others are compared from there on.
4. In the merged order equal blocks stand together, smallest document first: all later ones are
   covered. A block that is smallest may still share some of its windows with a neighbour whose
   block has other ends. The merge yields how long a prefix it shares with its neighbours at most, so
   only windows within that length can be shared. All blocks of an anchor stand in one range, but for
   the first and last anchor of a range; so of the other windows those without an equal hash in the
   range have no partner. The rest go into a second sort of the same kind, window by window.
5. Covered stretches meet their texts chunk by chunk.

A string that a third of all documents share is one entry per chunk, and a range never holds more
than its share of entries: splitters are taken from the runs. A run has at most ``RUN_ENTRIES``
entries, so memory follows the texts of a chunk and not what they hold.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.exchange import REPLY, SENT, answered, bucket_bits, chunked, packed, received, reply, send, unpacked
from txnwatch.llm.shared import stored
from txnwatch.llm.words import BYTE_CODE, _power, give_back, mixed

LENGTH, GRAM = 50, 24
_SPAN = LENGTH - GRAM + 1  # grams in a window
SEGMENT_BYTES = 1 << 19
GROUP_BYTES = 1 << 17  # short texts that are handled at once: their arrays fit a core's cache
CHUNK_BYTES = 8 << 20
RUN_ENTRIES = 1 << 17
RUN_BLOCK = 4096
RANGE_ENTRIES = 100_000
SPLITTER_SAMPLE = 100_000
SLICE = 8192  # strings that are laid out at once
_BASE, _INVERSE = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
NO_ID = np.iinfo(np.int64).max  # rows without id come last: they have no smaller partner role

# One table holds all that the first step finds: run blocks, covered stretches, texts, finished rows.
RUN, COVER, TEXT, DONE = range(4)
_STEP = (
    "kind int, chunk int, run int, doc_id long, row long, first binary, last binary, known int, n int, data binary, "
    "n_bytes long, sha string"
)
_KINDS = [
    pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(),
    pa.int64(), pa.string(),
]
_NAMES = [c.split()[0] for c in _STEP.split(", ")]


def _rows(rows: list[dict]) -> pa.Table:
    return pa.table([pa.array([r.get(n) for r in rows], k) for n, k in zip(_NAMES, _KINDS)], names=_NAMES)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """Per stretch of at most ``SEGMENT_BYTES`` window starts, or per ``GROUP_BYTES`` of short texts: the
    bytes, and for its blocks the text number, the stretch's place in the text, first and last window,
    anchor, anchor hash, and how far equal blocks follow one after another."""
    group, size = [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), SEGMENT_BYTES):
            piece = text[at : at + SEGMENT_BYTES + LENGTH - 1]
            if group and size + len(piece) > GROUP_BYTES:
                yield _blocks(group)
                group, size = [], 0
            group.append((number, at, piece))
            size += len(piece)
    if group:
        yield _blocks(group)


def _blocks(group: list[tuple[int, int, bytes]]):
    lengths = np.array([len(p) for _, _, p in group])
    buffer = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    codes = BYTE_CODE[buffer] * _power("suffix base", _BASE, len(buffer))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes, dtype=np.uint64)))
    n = len(buffer) - GRAM + 1
    grams = mixed((sums[GRAM:] - sums[:-GRAM]) * _power("suffix inverse", _INVERSE, n))
    low = np.uint64(28)
    least = _least((grams >> low << low) | np.arange(n, dtype=np.uint64), _SPAN)
    anchor = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    piece = np.repeat(np.arange(len(group)), lengths - LENGTH + 1)
    window = np.arange(len(piece)) + np.repeat(begin - (np.cumsum(lengths - LENGTH + 1) - (lengths - LENGTH + 1)), lengths - LENGTH + 1)
    anchor = anchor[window]
    change = np.ones(len(window), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(window)) - 1
    number = np.array([g[0] for g in group])[piece[first]]
    place = (np.array([g[1] for g in group]) - begin)[piece[first]]
    own, first, last, anchor = piece[first], window[first], window[last], anchor[first]
    head, reach = _repeats(buffer, own, first, last, anchor, grams[anchor])
    first, last, anchor = first[head], last[head], anchor[head]
    return buffer, (number[head], place[head], first, last, anchor, grams[anchor], reach)


def _repeats(buffer, piece, first, last, anchor, grams) -> tuple[np.ndarray, np.ndarray]:
    """The blocks that do not repeat the one before, and how far the repeats of each begin behind it.

    A text of a short period has equal blocks in a row, each as many places on as a block has windows.
    """
    step = last - first + 1
    again = np.zeros(len(first), bool)
    maybe = (grams[1:] == grams[:-1]) & (piece[1:] == piece[:-1]) & (step[1:] == step[:-1]) & ((anchor - first)[1:] == (anchor - first)[:-1])
    for s in np.unique(step[1:][maybe]).tolist():
        differs = np.concatenate(([0], np.cumsum(buffer[s:] != buffer[:-s], dtype=np.int32)))
        at = np.flatnonzero(maybe & (step[1:] == s))
        again[at + 1] = differs[last[at] + LENGTH] == differs[first[at]]
    head = np.flatnonzero(~again)
    return head, first[np.append(head[1:], len(first)) - 1] - first[head]


def _ordered(table: pa.Table) -> tuple[list[int], list[bytes]]:
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return [NO_ID if i is None else i for i in table.column("doc_id").to_pylist()], table.column("text").to_pylist()


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``keys``, and where in it each distinct one begins. Faster than hashing or looking up millions."""
    order = np.argsort(keys)
    keys = keys[order]
    return order, np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, int)


def _anchors(bits: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        give_back()
        ids, texts = _ordered(table)
        keys, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        ids = np.array(ids)
        for _, (number, _, _, _, _, grams, _) in blocks(texts):
            keys.append(grams)
            owners.append(ids[number])
        keys, owners = np.concatenate(keys), np.concatenate(owners)
        order, starts = _groups(keys)
        keys, owners = keys[order], owners[order]
        several = np.empty(0, np.uint8)
        if len(keys):
            several = (np.minimum.reduceat(owners, starts) != np.maximum.reduceat(owners, starts)).astype(np.uint8)
        return send(key[0].as_py(), keys[starts], several, bits)

    return run


def _shared(key: tuple, table: pa.Table) -> pa.Table:
    chunks, lengths, number, several = received(table, np.uint8)
    shared = np.bincount(number, 1 + several) > 1
    return reply(table, chunks, lengths, shared[number].astype(np.uint8))


# --- runs -------------------------------------------------------------------------------------------


def _suffix_strings(buffer, first, last, anchor) -> np.ndarray:
    """Text from the anchor on, text before it backwards, length of the former: fixed-width rows."""
    ahead, behind = last - anchor + LENGTH, anchor - first
    column = np.arange(LENGTH + _SPAN)
    from_end = column - ahead[:, None]
    at = np.where(from_end < 0, anchor[:, None] + column, anchor[:, None] - 1 - from_end)
    rows = buffer[np.clip(at, 0, len(buffer) - 1)]
    rows[from_end >= behind[:, None]] = 0
    rows[np.arange(len(rows)), ahead + behind] = ahead
    return rows.view(f"S{LENGTH + _SPAN}").ravel()


def _sorted_run(strings, docs, rows, starts, reaches, lengths):
    """Sort entries; of equal strings keep those of the smallest document, return the rest as covered."""
    by_doc = np.argsort(docs, kind="stable")
    order = by_doc[np.argsort(strings[by_doc], kind="stable")]
    strings, docs, rows, starts, reaches, lengths = (x[order] for x in (strings, docs, rows, starts, reaches, lengths))
    group = np.cumsum(np.concatenate(([0], strings[1:] != strings[:-1]))) if len(strings) else np.empty(0, int)
    least = docs[np.searchsorted(group, np.arange(group[-1] + 1))][group] if len(group) else docs
    stays = docs == least
    covered = (rows[~stays], starts[~stays], (starts + reaches + lengths)[~stays])
    return tuple(x[stays] for x in (strings, docs, rows, starts, reaches)), covered


def _matrix(strings: np.ndarray) -> np.ndarray:
    return np.frombuffer(strings.tobytes(), np.uint8).reshape(len(strings), strings.dtype.itemsize)


def _coded(strings, *fields, known: int = 0) -> Iterator[dict]:
    """Front-coded blocks of a sorted run; ``known`` is what the first string shares with the one before."""
    for a in range(0, len(strings), RUN_BLOCK):
        part = strings[max(a - 1, 0) : a + RUN_BLOCK]
        matrix = _matrix(part)
        length = np.char.str_len(part).astype(np.int64)
        differs = matrix[1:] != matrix[:-1]
        prefix = np.append(known, np.where(differs.any(axis=1), differs.argmax(axis=1), length[1:]))
        if a:
            matrix, length, prefix = matrix[1:], length[1:], prefix[1:]
        shared, prefix = int(prefix[0]), np.append(0, prefix[1:])
        column = np.arange(matrix.shape[1])
        rest = matrix[(column >= prefix[:, None]) & (column < length[:, None])]
        parts = [prefix.astype(np.uint8), length.astype(np.uint8), *(f[a : a + RUN_BLOCK] for f in fields)]
        parts = [*map(packed, parts), zstandard.ZstdCompressor(level=1).compress(rest.tobytes())]
        data = np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)
        yield {"first": bytes(strings[a]), "last": bytes(part[-1]), "known": shared, "row": a, "n": len(length), "data": data}


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Strings, prefixes shared with the string before, and (document, row, start, reach) of a block.

    A byte within a string's shared prefix is that of the last string before that spells it out.
    """
    sizes = np.frombuffer(data[:28], "<u4").tolist()
    parts, at = [], 28
    for size in sizes:
        parts.append(data[at : at + size])
        at += size
    prefix, length = (unpacked(p, np.uint8).astype(np.int64) for p in parts[:2])
    column = np.arange(int(length.max()))
    own = (column >= prefix[:, None]) & (column < length[:, None])
    spelt = np.zeros(own.shape, np.uint8)
    spelt[own] = np.frombuffer(zstandard.ZstdDecompressor().decompress(parts[6]), np.uint8)
    source = np.maximum.accumulate(np.where(column >= prefix[:, None], np.arange(len(prefix))[:, None], 0), axis=0)
    matrix = np.take_along_axis(spelt, source, axis=0)
    matrix[column >= length[:, None]] = 0
    return matrix.view(f"S{len(column)}").ravel(), prefix, [unpacked(p, np.int64) for p in parts[2:6]]


# --- merging ----------------------------------------------------------------------------------------


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes; only what follows is looked at."""
    a, b = a[known:], b[known:]
    if a == b:
        return known + len(a)
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return known + n - (differ.bit_length() + 7) // 8


class LoserTree:
    """Merges sorted streams of (string, prefix shared with the stream's previous entry, doc, ...).

    Every loser keeps the length of the prefix that it shares with the entry that beat it. Of two
    candidates the one that shares more with the last winner is smaller; only at equal lengths are
    bytes compared, from that length on. Equal strings come by document.
    """

    def __init__(self, streams: list[Iterator[tuple]]) -> None:
        self.streams = streams
        self.entry = [next(s, None) for s in streams]
        self.known = [-1 if e is None else 0 for e in self.entry]  # a stream that has ended loses to all

    def _less(self, a: int, b: int) -> bool:
        """Whether ``a`` comes first, of two that share equally much with the last winner; notes what they share."""
        known = self.known
        h = known[a]
        if h < 0:
            return True
        entry = self.entry
        x, y = entry[a][0][h:], entry[b][0][h:]
        if x == y:
            less = (entry[a][2], a) < (entry[b][2], b)
            known[b if less else a] = h + len(x)
        else:
            less = x < y
            known[b if less else a] = h + _common(x, y, 0)
        return less

    def __iter__(self) -> Iterator[tuple[tuple, int]]:
        """Entries in order, each with the prefix it shares with the one before."""
        k, known, entry, streams, less = len(self.streams), self.known, self.entry, self.streams, self._less
        if not k:
            return
        losers = [0] * k  # inner nodes 1..k-1; the leaf of stream i is node k + i
        winners = [0] * k + list(range(k))
        for node in range(k - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            first = known[a] > known[b] or (known[a] == known[b] and less(a, b))
            winners[node], losers[node] = (a, b) if first else (b, a)
        best = winners[1] if k > 1 else 0
        while entry[best] is not None:
            yield entry[best], known[best]
            entry[best] = following = next(streams[best], None)
            known[best] = h = following[1] if following else -1
            node = (k + best) >> 1
            while node:
                other = losers[node]
                o = known[other]
                if o > h or (o == h and not less(best, other)):
                    losers[node] = best
                    best, h = other, o
                node >>= 1


def _chain(blobs: list[tuple[int, bytes]]) -> Iterator[tuple]:
    """(string, prefix shared with the one before, document, row, start, reach) of a run, from its blocks in order."""
    for i, (shared, data) in enumerate(blobs):
        strings, prefix, fields = _decoded(data)
        prefix[0] = shared if i else 0  # the first of a run in a range has no predecessor here
        yield from zip(strings.tolist(), prefix.tolist(), *(f.tolist() for f in fields))


def _cut(splitters: list[bytes]):
    """Which range a run block belongs to; a block that lies in several is divided."""
    bounds = np.array(splitters, f"S{LENGTH + _SPAN}")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for block in batch.to_pylist():
                of = (block["chunk"], block["run"])
                a, b = bisect_right(splitters, block["first"]), bisect_right(splitters, block["last"])
                if a == b:
                    out.append((a, *of, block["row"], block["known"], block["data"]))
                    continue
                strings, prefix, fields = _decoded(block["data"])
                prefix[0] = block["known"]
                edges = np.searchsorted(strings, bounds[a:b])
                for r, (i, j) in enumerate(zip(np.append(0, edges).tolist(), np.append(edges, len(strings)).tolist()), a):
                    if i < j:
                        for coded in _coded(strings[i:j], *(f[i:j] for f in fields), known=int(prefix[i])):
                            out.append((r, *of, block["row"] + i + coded["row"], coded["known"], coded["data"]))
            names = [c.split()[0] for c in _DEALT.split(", ")]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 6, kinds)], names)

    return run


_DEALT = "range int, chunk int, run int, row long, known int, data binary"  # row: place in the run


def _joined(rows, starts, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of rows in order, joined where they touch."""
    order = np.lexsort((ends, starts, rows))
    rows, starts, ends = rows[order], starts[order], ends[order]
    new = np.ones(len(rows), bool)
    if len(rows):
        other = rows[1:] != rows[:-1]
        base = np.cumsum(np.append(0, other)) << 40  # a row's places follow those of all rows before
        reach = np.maximum.accumulate(base + ends)
        new[1:] = (base + starts)[1:] > reach[:-1]
        ends = reach - base
    last = np.append(np.flatnonzero(new)[1:], len(rows)) - 1 if len(rows) else np.empty(0, int)
    return rows[new], starts[new], ends[last]


def _covers(rows, starts, ends) -> list[dict]:
    """One message per chunk with its covered stretches."""
    rows, starts, ends = _joined(*(np.asarray(x, np.int64) for x in (rows, starts, ends)))
    chunks, first = np.unique(rows >> 32, return_index=True)
    out = []
    for chunk, a, b in zip(chunks.tolist(), first.tolist(), np.append(first[1:], len(rows)).tolist()):
        parts = [packed(x[a:b]) for x in (rows, starts, ends)]
        data = np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)
        out.append({"kind": COVER, "chunk": chunk, "n": b - a, "data": data})
    return out


def _uncovers(data: bytes) -> list[np.ndarray]:
    a, b, c = np.frombuffer(data[:12], "<u4").tolist()
    return [unpacked(p, np.int64) for p in (data[12 : 12 + a], data[12 + a : 12 + a + b], data[12 + a + b : 12 + a + b + c])]


def _merged(windows: bool):
    """Merge a range. ``windows``: of blocks, which sends on single windows; else of windows."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        give_back()
        number = key[0].as_py()
        runs: dict[tuple, list[tuple[int, bytes]]] = {}
        for row in table.sort_by([("chunk", "ascending"), ("run", "ascending"), ("row", "ascending")]).to_pylist():
            runs.setdefault((row["chunk"], row["run"]), []).append((row["known"], row["data"]))
        gone = ([], [], [])
        strings, shares, doc_of, spans = [], [], [], []  # least blocks that may share windows, with their occurrences
        string, size, shared_before = None, 0, LENGTH  # the neighbour of the first string may be in another range
        least, owner, edge, gram = [], None, None, None

        def close(shared: int) -> None:
            # windows reach from the anchor at most as far as a neighbour agrees
            if min(shared, string[-1]) + size - 1 - string[-1] >= LENGTH:
                strings.append(string)
                shares.append(shared)
                doc_of.append(owner)
                spans.append(least)

        for (now, _, doc, row, start, reach), known in LoserTree([_chain(blobs) for blobs in runs.values()]):
            if known == size == len(now) and string is not None:
                if doc == owner:
                    least.append((row, start, reach))
                else:
                    gone[0].append(row)
                    gone[1].append(start)
                    gone[2].append(start + reach + (size - 1 if windows else LENGTH))
                continue
            if string is None:
                edge = now[:GRAM]
            else:
                if windows:
                    close(max(shared_before, known))
                shared_before = known
            string, size, owner, least = now, len(now), doc, [(row, start, reach)]
        out = []
        if windows and string is not None:
            close(LENGTH)
            edges = [edge, string[:GRAM]]
            entries = _windows(np.array(strings, f"S{LENGTH + _SPAN}"), np.array(shares, np.int64), np.array(doc_of, np.int64), spans, edges)
            for i, slice_ in enumerate(entries):
                kept, covered = _sorted_run(*slice_, np.full(len(slice_[0]), LENGTH))
                out += [{"kind": RUN, "chunk": number, "run": i, **block} for block in _coded(*kept)]
                for have, more in zip(gone, covered):
                    have += more.tolist()
        return _rows(out + _covers(*gone))

    return run


def _windows(strings, shares, docs, spans, edges) -> Iterator[tuple[np.ndarray, ...]]:
    """Entries (string, document, row, start, reach) for windows of blocks that may have a partner.

    Blocks with the anchor of an edge of the range may have one in another range. Others must have one
    here, in another document, with an equal hash.
    """
    laid, hashes, fits = [], [], []
    column, place = np.arange(LENGTH + _SPAN - 1), np.arange(_SPAN)
    for a in range(0, len(strings), SLICE):
        matrix = _matrix(strings[a : a + SLICE])
        size = np.char.str_len(strings[a : a + SLICE]).astype(np.int64) - 1
        ahead = matrix[np.arange(len(matrix)), size].astype(np.int64)
        behind = size - ahead
        at = np.where(column < behind[:, None], size[:, None] - 1 - column, column - behind[:, None])
        text = np.take_along_axis(matrix, np.clip(at, 0, matrix.shape[1] - 1), axis=1)
        codes = BYTE_CODE[text] * _power("suffix base", _BASE, text.shape[1])
        sums = np.concatenate((np.zeros((len(text), 1), np.uint64), np.cumsum(codes, axis=1, dtype=np.uint64)), axis=1)
        fit = place <= (behind + np.minimum(shares[a : a + SLICE], ahead) - LENGTH)[:, None]
        hashed = mixed((sums[:, LENGTH:] - sums[:, : text.shape[1] + 1 - LENGTH]) * _power("suffix inverse", _INVERSE, _SPAN))
        hashes.append(hashed[fit])
        fits.append(fit)
        laid.append(text)
    if not laid:
        return
    laid, fits = np.concatenate(laid), np.concatenate(fits)
    entry, at = np.nonzero(fits)
    found = np.concatenate(hashes)
    order = np.argsort(found, kind="stable")
    starts = np.flatnonzero(np.append(True, found[order][1:] != found[order][:-1]))
    owner = docs[entry][order]
    several = np.minimum.reduceat(owner, starts) != np.maximum.reduceat(owner, starts)
    use = np.empty(len(found), bool)
    use[order] = np.repeat(several, np.diff(np.append(starts, len(found))))
    grams = strings.astype(f"S{GRAM}")
    use |= np.isin(grams, np.array(edges, f"S{GRAM}"))[entry]
    entry, at = entry[use], at[use]
    count = np.array([len(s) for s in spans])
    flat = np.array([x for s in spans for x in s], np.int64)
    begin = np.cumsum(count) - count
    before = np.append(0, np.cumsum(count[entry]))
    a = 0
    while a < len(entry):
        b = max(a + 1, int(np.searchsorted(before, before[a] + RUN_ENTRIES, "right")) - 1)
        own, places, each = entry[a:b], at[a:b], count[entry[a:b]]
        rows = np.empty((b - a, LENGTH + 1), np.uint8)
        rows[:, :LENGTH] = laid[own[:, None], places[:, None] + np.arange(LENGTH)]
        rows[:, LENGTH] = 1
        which = np.repeat(begin[own] - (before[a:b] - before[a]), each) + np.arange(before[b] - before[a])
        row, start, reach = flat[which].T
        yield np.repeat(rows.view(f"S{LENGTH + 1}").ravel(), each), np.repeat(docs[own], each), row, start + np.repeat(places, each), reach
        a = b


def _sort_distributed(runs: DataFrame, windows: bool, name: str) -> DataFrame:
    """Exchange the blocks of sorted runs by range and merge each range."""
    runs = runs.select("chunk", "run", "row", "first", "last", "known", "n", "data")
    total = runs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    ranges = -(-total // RANGE_ENTRIES)
    splitters = []
    if ranges > 1:  # a sample of bounded size: it balances the ranges and changes no result
        sample = runs.orderBy(F.xxhash64("first", "chunk", "run")).select("first").limit(SPLITTER_SAMPLE).collect()
        found = sorted(bytes(r["first"]) for r in sample)
        splitters = sorted({found[i * len(found) // ranges] for i in range(1, min(ranges, len(found)))})
    dealt = runs.mapInArrow(_cut(splitters), _DEALT)
    return stored(dealt.groupBy("range").applyInArrow(_merged(windows), _STEP), name)


# --- chunks -----------------------------------------------------------------------------------------


def _first_runs(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
    give_back()
    chunk = key[0].as_py()
    ids, texts = _ordered(docs)
    found = list(blocks(texts))
    keys = np.concatenate([b[1][5] for b in found] + [np.empty(0, np.uint64)])
    order, starts = _groups(keys)
    shared = np.empty(len(keys), bool)  # answers come in the order of the distinct keys
    shared[order] = np.repeat(answered(replies, np.uint8).astype(bool), np.diff(np.append(starts, len(keys))))
    del keys, order, starts
    ends = np.cumsum([len(b[1][5]) for b in found])
    has = np.zeros(len(texts), bool)
    ids = np.array(ids, np.int64)
    out, gone, waiting, runs = [], ([], [], []), [], 0

    def sort() -> None:
        nonlocal runs
        entries, covered = _sorted_run(*(np.concatenate(c) for c in zip(*waiting)))
        out.extend({"kind": RUN, "chunk": chunk, "run": runs, **block} for block in _coded(*entries))
        for have, more in zip(gone, covered):
            have.append(more)
        waiting.clear()
        runs += 1

    for end, (buffer, (number, place, first, last, anchor, _, reach)) in zip(ends.tolist(), found):
        use = np.flatnonzero(shared[end - len(number) : end] & (ids[number] != NO_ID))
        has[number[use]] = True
        for a in range(0, len(use), SLICE):
            u = use[a : a + SLICE]
            strings = _suffix_strings(buffer, first[u], last[u], anchor[u])
            row = (chunk << 32) + number[u]
            waiting.append((strings, ids[number[u]], row, first[u] + place[u], reach[u], last[u] - first[u] + LENGTH))
            if sum(len(w[0]) for w in waiting) >= RUN_ENTRIES:
                sort()
    if waiting:
        sort()
    if runs:
        out += _covers(*map(np.concatenate, gone))
    press = zstandard.ZstdCompressor(level=1).compress
    for i, text in enumerate(texts):
        doc = None if ids[i] == NO_ID else int(ids[i])
        if has[i]:
            out.append({"kind": TEXT, "chunk": chunk, "doc_id": doc, "row": (chunk << 32) + i, "data": press(text)})
        else:
            out.append({"kind": DONE, "doc_id": doc, "n_bytes": len(text), "sha": hashlib.sha256(text).hexdigest()})
    return _rows(out)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _kept(key: tuple, texts: pa.Table, covers: pa.Table) -> pa.Table:
    give_back()
    found = [_uncovers(d) for d in covers.column("cover").to_pylist()]
    rows, starts, ends = _joined(*(np.concatenate(c) for c in zip(*found))) if found else [np.empty(0, np.int64)] * 3
    out = []
    for row in texts.select(["doc_id", "row", "data"]).to_pylist():
        text = zstandard.ZstdDecompressor().decompress(row["data"])
        a, b = np.searchsorted(rows, [row["row"], row["row"] + 1]).tolist()
        kept, at, removed = hashlib.sha256(), 0, 0
        for start, end in zip(starts[a:b].tolist(), ends[a:b].tolist()):
            kept.update(text[at:start])
            removed, at = removed + end - start, end
        kept.update(text[at:])
        out.append((row["doc_id"], len(text), removed, b - a, kept.hexdigest()))
    kinds = [pa.int64()] * 4 + [pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return pa.table([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 5, kinds)], names=names)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of ``docs``.

    Texts are UTF-8 bytes, null being empty; matches never cross documents and are judged on the
    input. Rows that repeat an id are one document to each other: neither removes from the other. Rows
    without id neither lose bytes nor make others lose any. Only doc_id and text are read.
    """
    rows, size = chunked(docs, CHUNK_BYTES)
    bits = bucket_bits(size // 13)
    sent = rows.groupBy("chunk").applyInArrow(_anchors(bits), SENT)
    replies = sent.groupBy("bucket").applyInArrow(_shared, REPLY)
    step = stored(rows.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_first_runs, _STEP), "suffix-runs")
    merged = _sort_distributed(step.where(f"kind = {RUN}"), True, "merged-blocks")
    again = _sort_distributed(merged.where(f"kind = {RUN}"), False, "merged-windows")
    covers = step.unionByName(merged).unionByName(again).where(f"kind = {COVER}")
    covers = covers.selectExpr("chunk as of_chunk", "data as cover")  # columns of their own: both sides come from one table
    texts = step.where(f"kind = {TEXT}").select("chunk", "doc_id", "row", "data")
    touched = texts.groupBy("chunk").cogroup(covers.groupBy("of_chunk")).applyInArrow(_kept, RESULT)
    done = step.where(f"kind = {DONE}").selectExpr("doc_id", "n_bytes", "0L as n_removed", "0L as n_spans", "sha as kept_sha256")
    return touched.unionByName(done)

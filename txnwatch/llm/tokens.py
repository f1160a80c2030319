"""Token ids of whole texts, fast and equal to the tokenizer's own."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa

# The vocabulary, by the name under which the installed package of public tokenizers finds it.
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
CACHE_PIECES = 300_000
# Stands between unknown pieces that are encoded as one text; a token of its own.
MARK = "|"
TOGETHER = 200
# Line feeds become blanks, A to Z lower case.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("\n")] = ord(" ")
_LOWER = _PLAIN.copy()
_LOWER[ord("A") : ord("Z") + 1] += 32
_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = True
# ASCII signs and digits; an apostrophe may belong to the letters after it ('s, 're).
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x7F] = ~_LETTER[0x21:0x7F]
_OPENER = _SIGN.copy()
_OPENER[ord("'")] = False


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Encoder:
    """A tokenizer and the ids of pieces that it has seen, in two generations.

    When the young generation is full it becomes the old one; a piece found there moves back to the
    young one. Pieces that keep coming are so never encoded twice.
    """

    def __init__(self, path: str) -> None:
        # A task has one core: threads of the tokenizer's own only wait for each other there.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        mark = self._ids([MARK])[0]
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        """Make sure that the young generation knows ``pieces``, each given once."""
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = [p for p in pieces if p not in young]
        young.update((p, old[p]) for p in new if p in old)
        new = [p for p in new if p not in old]
        alone = [p for p in new if self.mark is None or MARK in p]
        for piece, ids in zip(alone, self._ids(alone)):
            young[piece] = np.array(ids, "<u4").tobytes()
        if self.mark is None:
            return
        new = [p for p in new if MARK not in p]
        for a in range(0, len(new), 100 * TOGETHER):
            some = new[a : a + 100 * TOGETHER]
            marked = [f" {MARK} ".join(some[i : i + TOGETHER]) + f" {MARK}" for i in range(0, len(some), TOGETHER)]
            ids = np.concatenate([np.array(x, "<u4") for x in self._ids(marked)])
            ends = 4 * np.flatnonzero(ids == self.mark)
            data, starts = ids.tobytes(), [0, *(ends[:-1] + 4).tolist()]
            young.update((p, data[s:e]) for p, s, e in zip(some, starts, ends.tolist(), strict=True))


_encoder = lru_cache(maxsize=2)(_Encoder)


def _pieces(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Pieces that are encoded apart, of all texts in order, and how many there are up to each text's end.

    They are brought together where the tokenizer sees no difference: it lower-cases, so A to Z are
    lowered here, and signs stand apart from letters. A text that may name a special token keeps its
    letters and is divided at blanks and line feeds only.
    """
    raw = [text.encode() for text in texts]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    given = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    data = _LOWER[given]
    kept = data != ord(" ")
    after_blank = np.concatenate(([True], ~kept[:-1]))
    letter = _LETTER[data]
    first = after_blank.copy()
    first[1:] |= letter[:-1] & _SIGN[data[1:]]
    first[1:] |= _OPENER[data[:-1]] & letter[1:]
    for i, r in enumerate(raw):
        if b"<|" in r:
            whole = slice(ends[i] - 1 - len(r), ends[i])
            data[whole], first[whole] = _PLAIN[given[whole]], after_blank[whole]
    first &= kept
    counts = np.searchsorted(np.flatnonzero(first), ends)
    data = data[kept]
    offsets = np.append(np.flatnonzero(first[kept]), len(data))
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, buffers), counts


def encode(texts: list[str], path: str) -> list[bytes]:
    """Token ids of each text as little-endian unsigned 32-bit integers, without special tokens.

    The tokenizer drops white space and never joins what stands on two sides of it, nor a letter
    and a sign (but for an apostrophe before letters), so the ids of a text are those of its pieces
    between, in order. A piece that was seen before is looked up, once for all its places in
    ``texts``. The others are encoded many at a time, as one text with a mark between
    them: the mark's id tells where each ends. Pieces that hold the mark are encoded alone.
    """
    encoder = _encoder(path)
    pieces, counts = _pieces(texts)
    places = pieces.dictionary_encode()
    distinct = places.dictionary.to_numpy(zero_copy_only=False).tolist()
    encoder.learn(distinct)
    ids = pa.array(map(encoder.young.__getitem__, distinct), pa.large_binary()).take(places.indices)
    _, offsets, data = ids.buffers()
    ends = np.frombuffer(offsets, np.int64)[counts].tolist()
    return [data[a:b].to_pybytes() if b > a else b"" for a, b in zip([0, *ends], ends)]

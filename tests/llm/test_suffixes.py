"""Repeated passages: periodic texts, ranges that cut an anchor's blocks, results of which few columns are read."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from txnwatch.llm import suffixes
from txnwatch.llm.suffixes import LENGTH


def expected(rows):
    first, out = {}, set()
    texts = [(i, t.encode()) for i, t in rows]
    for i, b in texts:
        for a in range(len(b) - LENGTH + 1):
            first[b[a : a + LENGTH]] = min(i, first.get(b[a : a + LENGTH], i))
    for i, b in texts:
        gone = bytearray(len(b) + 1)
        for a in range(len(b) - LENGTH + 1):
            if first[b[a : a + LENGTH]] < i:
                gone[a : a + LENGTH] = b"\1" * LENGTH
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.add((i, len(b), sum(gone), sum(gone[j] > gone[j - 1] for j in range(len(b))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("range_entries", [7, 60, 100_000])
def test_any_ranges_give_the_rows_of_brute_force(spark, monkeypatch, range_entries):
    monkeypatch.setattr(suffixes, "RANGE_ENTRIES", range_entries)
    rng = random.Random(range_entries)
    common = "a passage of forty bytes that is common "
    texts = []
    for _ in range(60):  # few letters: shared windows of blocks with other ends, periods, one hot anchor
        parts = [rng.choice((common, "xy" * rng.randint(1, 60), "q" * rng.randint(1, 90), "abcabd" * rng.randint(1, 20))) for _ in range(4)]
        texts.append("".join(p + "".join(rng.choice("uvw") for _ in range(rng.randint(0, 12))) for p in parts))
    rows = list(enumerate(texts))
    got = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(map(tuple, got.collect())) == expected(rows)


def test_equal_blocks_in_a_row_are_one_entry():
    for text in (b"q" * 200_000, b"ab" * 100_000, b"0123456789" * 20_000):
        found = list(suffixes.blocks([text]))
        assert sum(len(numbers[0]) for _, numbers in found) <= 6
        seen = np.zeros(len(text), bool)
        for _, (_, place, first, last, _, _, reach) in found:
            for a, b in zip(first + place, last + place + reach + LENGTH):
                seen[a:b] = True
        assert seen.all()


def test_short_texts_are_handled_in_small_groups():
    texts = [bytes([i % 251 + 1]) * 2000 for i in range(400)]
    found = list(suffixes.blocks(texts))
    assert max(len(buffer) for buffer, _ in found) <= 1 << 17
    assert sorted(set(np.concatenate([numbers[0] for _, numbers in found]).tolist())) == list(range(400))


def test_tasks_give_free_memory_back():
    from txnwatch.llm import words

    def resident():
        return next(int(line.split()[1]) for line in open("/proc/self/status") if line.startswith("RssAnon"))

    words.give_back()
    before = resident()
    kept = [bytes(50_000) for _ in range(2_000)]  # 100 MB in small parts, which a process keeps when freed
    last = bytearray(50_000)
    del kept
    words.give_back()
    assert resident() < before + 20_000 and len(last) == 50_000


def test_keys_are_grouped_by_one_sort():
    keys = np.array([5, 2**63, 5, 0, 2**63, 7], np.uint64)
    order, starts = suffixes._groups(keys)
    assert keys[order][starts].tolist() == [0, 5, 7, 2**63] and starts.tolist() == [0, 1, 3, 4]
    order, starts = suffixes._groups(keys[:0])
    assert len(order) == len(starts) == 0


def test_blocks_come_back_from_their_code():
    rng = np.random.default_rng(3)
    strings = np.sort(np.array([bytes(rng.choice([0, 97, 98], rng.integers(1, 9)).astype(np.uint8)) + b"\x1e" for _ in range(500)], "S77"))
    fields = [np.arange(500, dtype=np.int64) * k for k in (1, 2, 3, 4)]
    at = 0
    for block in suffixes._coded(strings, *fields):
        back, _, others = suffixes._decoded(block["data"])
        assert back.tolist() == strings[at : at + len(back)].tolist() and block["row"] == at
        assert all((o == f[at : at + len(back)]).all() for o, f in zip(others, fields))
        at += len(back)
    assert at == 500


def test_few_columns_can_be_read(spark):
    """Both sides of the last step come from one table; a pruned column must not be taken for the other side's."""
    docs = spark.createDataFrame([(1, "k" * 80), (2, "k" * 80), (3, None)], "doc_id long, text string")
    assert suffixes.repeated_passages(docs).selectExpr("sum(n_removed) as n").first()["n"] == 80

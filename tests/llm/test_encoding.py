"""Token ids by pieces: equal to the tokenizer's, each distinct word encoded once, apart from the signs around it."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("txnwatch.llm")

from txnwatch.llm import cutting, tokens
from txnwatch.llm.tokens import vocabulary_path


def _expected(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path())
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_words_are_apart_from_signs_and_asked_for_once(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    encoder = tokens._Encoder(vocabulary_path())
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    learned, learn = [], encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda pieces: (learned.append(sorted(pieces)), learn(pieces)))
    monkeypatch.setattr(tokens, "_encoder", lambda path: encoder)
    texts = ['The cat (the CAT)! "cat", the:cat\nx1', "cat's;", "", " "] * 3
    assert tokens.encode(texts, vocabulary_path()) == _expected(texts)
    assert learned == [sorted(["the", "cat", "(", ")!", '"', '",', ":", "x", "1", "'s", ";"])]


def test_random_signs():
    rng = random.Random(20)
    some = [*"aabestrvmdlAZST  \n.,'''!?(;<>|$#-=`01\t\r\x0b\x00\x7f"]
    some += ["é", "É", "́", "̸", "İ", "K", ";", "ﬁ", "中", "²", " ", "‍", "Σ"]
    some += ["'S", "'re", "<|", "|>", "<|endoftext|>"]
    texts = ["".join(rng.choices(some, k=rng.randint(0, 40))) for _ in range(5000)]
    assert tokens.encode(texts, vocabulary_path()) == _expected(texts)


def test_texts_are_dealt_by_bytes(monkeypatch):
    texts = ["é" * 6, "ab", "", "é" * 4, "é" * 40]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2, 3, None, 5], pa.int64()), "text": texts})
    sizes = []
    monkeypatch.setattr(cutting, "encode", lambda texts, path: [sizes.append([len(t.encode()) for t in texts])] and [b""] * len(texts))
    monkeypatch.setattr(cutting, "BATCH_BYTES", 14)
    got = pa.Table.from_batches(cutting._cut("", True)(iter([batch, batch.slice(0, 0)])))
    assert sizes == [[12, 2, 0], [8], [80]] and got.column("doc_id").to_pylist() == [1, 2, 3, None, 5]

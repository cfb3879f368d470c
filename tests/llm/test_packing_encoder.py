"""What the encoder of packing keeps, what it runs the tokenizer on, and that its ids are the tokenizer's."""

import random
import tracemalloc

import numpy as np
import pytest

from quaymaster.llm import packing
from quaymaster.llm.queries import tokenizer_path


@pytest.fixture(autouse=True)
def fresh():
    packing._forget()
    yield
    packing._forget()


def encoded(texts):
    return list(packing.encode_texts([t.encode() for t in texts], tokenizer_path()))


def kept(texts):
    encoded(["warm"])
    tracemalloc.start()
    encoded(texts)
    found = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    return found


def test_a_worker_keeps_no_more_words_than_its_bound(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 1000, raising=False)
    monkeypatch.setattr(packing, "CACHED_WORDS", 1000, raising=False)
    assert kept([" ".join(f"w{chr(97 + i % 26)}{i}" for i in range(30_000))]) < 1e6
    assert kept([" ".join(f"ш{i}" for i in range(30_000))]) < 1e6


def test_a_worker_keeps_no_long_words():
    assert kept(["x" * (20_000 + i) for i in range(40)]) < 1e6
    assert kept(["ш" * (20_000 + i) for i in range(40)]) < 1e6


def test_parts_that_words_share_are_tokenised_once(monkeypatch):
    seen = []

    class Counted:
        def __init__(self, real):
            self.real = real

        @property
        def model(self):
            return Counted(self.real.model)

        def tokenize(self, chars):
            seen.append(chars)
            return self.real.tokenize(chars)

        def encode(self, text, **more):
            seen.append(text)
            return self.real.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            seen.extend(texts)
            return self.real.encode_batch_fast(texts, **more)

    real = packing._tokenizer(tokenizer_path())
    monkeypatch.setattr(packing, "_tokenizer", lambda path: Counted(real))
    encoded(["Alpha, alpha. (alpha) beta, ALPHA!", "(Beta) alpha,alpha. élan, Élan"])
    assert sorted(map(len, seen)) == sorted(map(len, ["alpha", "beta", "Ã©lan", ",", ".", "(", ")", "!", ]))


def test_ids_are_those_of_the_tokenizer(monkeypatch):
    monkeypatch.setattr(packing, "SPLIT_BYTES", 5, raising=False)
    r = random.Random(8)
    plain = ["a", "B", "the", " ", "\n", "'s", "'S", "'", "''re", "'ll", "don't", "9", "12", ".", ",", "...", "é", "É", "ß", "Þ", "ÿ", "œuvre"[1:], "<|", "|>", "\x0b", "\x0c", "_", "~", "x" * 70, "!" * 70]
    other = ["×", "÷", "²", "½", "ª", "µ", "º", "\xa0", "\xad", "\x7f", "\x80", "\x1c", "é", "́", "Σ", "İ", "ш", "中", "🙂", "<|endoftext|>", "<|startoftext|>", "\x00"]
    texts = [chr(i) for i in range(0x250)] + [f"a{chr(i)}b" for i in range(0x250)]
    texts += ["".join(r.choice(plain) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(r.choice(plain + other) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    whole = packing._tokenizer(tokenizer_path())
    for text, ids in zip(texts, encoded(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text

"""Encoding word by word equals encoding whole texts, whatever the letters."""

import sys

import numpy as np
import pyarrow as pa
import pytest

from placelake.llm import tokens

P = pytest.importorskip("public_tokenizers")


def both(texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    whole = [np.array(e.ids, "<u2").tobytes() for e in Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)]
    end = np.array([2], "<u2").tobytes()
    return [w + end for w in whole], list(tokens._encoded(pa.array(texts), path, True, 2, "<u2"))


def test_every_letter_before_a_mark():
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha()]
    for form in ("{}.", "Ab{},", "{}{}.", "{}a,", "{}"):
        whole, own = both([form.format(c, c) for c in letters])
        assert [c for c, a, b in zip(letters, whole, own, strict=True) if a != b] == []


def test_words_that_marks_join():
    texts = ["HAYRİ.", "şehri İ, ve", "ढ़.", "ཛྷ,", "שּׁ. גּ, שּ.", "ΣΊΣΥΦΟΣ. Σ,", "각. 각.", "ab.. cd., e.f. .", "don't. 's. 'LL,", "é́. ́.", "<|endoftext|>. a<|startoftext|>,", "ǅ. ẞ, ŉ.", " a. b, c."]
    whole, own = both(texts)
    assert whole == own


def test_random_text():
    rng = np.random.default_rng(11)
    pools = ["abcXYZ.,'  ", "ÀÉÎõüßŒ.,̧́ ", "ΑΣσςάΊ., ", "ІЇЙйжЩ.,̆ ", "हिन्दीक़य़., ", "각가각., ", "שׁוּשּׁשּ., ", "\t\n\x0b\x0c\r\x1c\x85 　a., ", "1²Ⅳ٣x.,"]
    texts = ["".join(rng.choice(list(pools[k % len(pools)] + (pools[(k * 7) % len(pools)] if k % 3 else "")), 60)) for k in range(6000)]
    whole, own = both(texts)
    assert [t for t, a, b in zip(texts, whole, own, strict=True) if a != b] == []


class Counting:
    """A tokenizer that counts the texts that it is given."""

    def __init__(self, own):
        self.own, self.met = own, 0

    def __getattr__(self, name):
        return getattr(self.own, name)

    def encode_batch_fast(self, texts, **k):
        self.met += len(texts)
        return self.own.encode_batch_fast(texts, **k)


def test_words_of_letters_are_encoded_many_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeéñжщǅ"), 9)) for _ in range(5000)]
    texts = [" ".join(words[k : k + 50]) + "." for k in range(0, 5000, 50)] + ["ab Σ ΑΣ İX ढ़ cd", "ab12 a-b don't x"]
    kept = tokens._load(P.path("word_bpe_49k.json"), "<u2")
    kept.words.clear()
    monkeypatch.setattr(kept, "tokenizer", Counting(kept.tokenizer))
    whole, own = both(texts)
    assert whole == own
    assert kept.tokenizer.met < 500


def test_parts_by_column_are_those_of_each_word():
    words = ["ab", "Ab.", "AB,", "ab..", "a.b", ".", ",", "", "É.", "İ.", "x1", "'s", "Ab.,", "q\n"]
    kept = tokens._load(P.path("word_bpe_49k.json"), "<u2")
    kept.words.clear()
    want = [np.array(kept.ids(w), "<u2").tobytes() for w in words]
    assert tokens._word_ids(pa.array(words), P.path("word_bpe_49k.json"), "<u2").to_pylist() == want

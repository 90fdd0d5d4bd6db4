"""Language ID by multilingual mixture inference.

A language is a distribution over hashed letter trigrams (word ends included) learned from labelled rows. A document is a
mixture: every word is drawn from one language of a set, with proportions that expectation-maximisation estimates. Sets
grow along the languages' order in the full mixture for as long as the likelihood less a penalty for each language rises.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm.common import flat_words, text_slices

UNKNOWN = "und"
BUCKETS = 1 << 15
#: Rows that a model is fitted on at most, drawn by a hash of doc_id; predictions and all else cover every row.
TRAIN_ROWS = 20_000
#: Bytes of text predicted at once: several arrays of its words by languages are held beside it.
SLICE = 2 << 20


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages


def word_trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words, the word each belongs to, and which words have a letter. Letters count as lower case, all else as a word end."""
    points = np.frombuffer(("\n" + "\n".join(w.replace("\n", " ") for w in words) + "\n").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    word = np.cumsum(points == 10) - 1
    kinds, back = np.unique(points, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds])[back]
    c = np.where(letter, points, 0).astype(np.uint64)
    at = np.flatnonzero(letter[1:-1]) + 1
    h = c[at - 1] * np.uint64(0x9E3779B97F4A7C15) + c[at] * np.uint64(0xC2B2AE3D27D4EB4F) + c[at + 1] * np.uint64(0x165667B19E3779F9)
    has = np.zeros(len(words), dtype=bool)
    has[word[at]] = True
    return (h >> np.uint64(49)).astype(np.int64), word[at], has


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in text_slices(batches):
        codes, words, offsets = flat_words(batch.column("text"))
        grams, word, _ = word_trigrams(words)
        langs = batch.column("lang").to_pylist()
        of_doc = np.array([sorted(set(langs)).index(x) for x in langs])
        of_word = np.repeat(of_doc, np.diff(offsets))
        for k, lang in enumerate(sorted(set(langs))):
            n = np.bincount(codes[of_word == k], minlength=len(words))
            counts[lang] = counts.get(lang, 0) + np.bincount(grams, weights=n[word], minlength=BUCKETS)
    for lang, n in counts.items():
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(n[full].astype(np.int64))], names=["lang", "bucket", "n"])


def fit(docs: DataFrame, most_rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows (doc_id, text, lang) with a lang whose crc32(doc_id as text) mod 3 is not 1, `most_rows` of them about."""
    rows = docs.where("lang is not null and text is not null and crc32(cast(doc_id as string)) % 3 != 1")
    total = rows.count()
    share = 1 << 20 if total <= most_rows else max(1, (most_rows << 20) // total)
    drawn = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("text", "lang")
    found = drawn.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())  # languages times buckets: bounded, whatever the table's size
    counts = np.full((BUCKETS, len(languages)), 0.05)
    for k, lang in enumerate(languages):
        own = found[found["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return Model(languages, np.log(counts / counts.sum(axis=0)) if languages else counts)


def mixtures(p: np.ndarray, starts: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for many documents at once. p: words x languages, up to a factor for each word; starts: where documents start;
    allowed: documents x languages. Returns proportions and log-likelihoods, the latter up to what all sets have in common."""
    sizes = np.diff(np.append(starts, len(p)))
    doc = np.repeat(np.arange(len(starts)), sizes)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = p * share[doc]
        r /= r.sum(axis=1, keepdims=True)
        share = np.add.reduceat(r, starts, axis=0) / sizes[:, None]
    return share, np.add.reduceat(np.log((p * share[doc]).sum(axis=1)), starts)


def best_mixtures(p: np.ndarray, starts: np.ndarray, rounds: int = 6, penalty: float = 1.0) -> np.ndarray:
    """Proportions of each document over its set of languages. A language more costs `penalty` times log(words) + log(languages)."""
    n_docs, n_langs = len(starts), p.shape[1]
    sizes = np.diff(np.append(starts, len(p)))
    first, _ = mixtures(p, starts, np.ones((n_docs, n_langs)), rounds)
    order = np.argsort(-first, axis=1, kind="stable")
    best, score, open_ = np.zeros((n_docs, n_langs)), np.full(n_docs, -np.inf), np.arange(n_docs)
    doc = np.repeat(np.arange(n_docs), sizes)
    for k in range(1, n_langs + 1):
        allowed = np.zeros((len(open_), n_langs))
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        use = np.isin(doc, open_) if len(open_) < n_docs else slice(None)
        own = sizes[open_]
        share, ll = mixtures(p[use], np.cumsum(own) - own, allowed, 1 if k == 1 else rounds)
        ll = ll - penalty * (k - 1) * (np.log(own) + math.log(n_langs))
        up = ll > score[open_]
        open_ = open_[up]
        best[open_], score[open_] = share[up], ll[up]
        if not len(open_):
            break
    return best


def _predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, list[str]]:
    codes, words, offsets = flat_words(texts)
    n = len(texts)
    langs, score, sets = [UNKNOWN] * n, np.zeros(n), [""] * n
    if not model.languages or not words:
        return langs, score, sets
    grams, word, has = word_trigrams(words)
    by_word = np.zeros((len(words), len(model.languages)))
    if len(grams):
        cut = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        by_word[word[cut]] = np.add.reduceat(model.log_p[grams], cut, axis=0)
    by_word = np.exp(np.maximum(by_word - by_word.max(axis=1, keepdims=True), -40.0))
    doc = np.repeat(np.arange(n), np.diff(offsets))
    lettered = has[codes]
    doc, codes = doc[lettered], codes[lettered]
    if not len(doc):
        return langs, score, sets
    docs, starts = np.unique(doc, return_index=True)
    share = best_mixtures(by_word[codes], starts)
    top = share.argmax(axis=1)
    for d, k, s in zip(docs.tolist(), top.tolist(), share, strict=True):
        langs[d], score[d] = model.languages[k], min(1.0, float(s[k]))
        sets[d] = ",".join(f"{model.languages[i]}:{s[i]:.3f}" for i in np.argsort(-s, kind="stable") if s[i] > 0)
    return langs, score, sets


def _predictor(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=SLICE):
            langs, score, sets = _predict(batch.column("text"), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(sets, pa.string())], names=["doc_id", "lang_pred", "score", "languages"])

    return run


def _languages(model: Model) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for whole in texts:
            batch = pa.RecordBatch.from_arrays([whole], names=["text"])
            langs = [x for part in text_slices([batch], most=SLICE) for x in _predict(part.column(0), model)[0]]
            yield pa.array(langs, pa.string())

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages for each row of `docs` (doc_id, text), read whole.

    lang_pred is the language of the largest proportion and score that proportion; null texts, texts without a letter and
    a model without languages give `und` and 0. `languages` lists the chosen set with proportions. Ties go to the
    language first in order. Repeated rows come back repeated; other columns play no part.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double, languages string")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs`, with all columns, whose text has a language; nothing is shuffled, and texts don't come back from Python."""
    named = F.arrow_udf(_languages(model), "string", F.ArrowUDFType.SCALAR_ITER)
    return docs.where(named(F.col("text")) != UNKNOWN)

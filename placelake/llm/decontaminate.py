"""Benchmark decontamination: rare seeds, then Smith-Waterman alignment of words.

Seeds are pairs of an item's words, next to each other or with one word between them, and so they are in the text. They miss
nothing: an alignment of share s with an item of n words has m matches and at most 2m - 2sn errors, so that of its m - 1
pairs of neighbouring matches sn - 1 or more have one error at most between them, and these are seeds. A first pass over the
corpus counts seeds. Of each item's, the most frequent ones are left out, half as many as an alignment needs; a second pass
finds the others, and where enough different ones of an item come together, a passage is cut out around them, as codes of the
items' words, and aligned with the item, word by word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm.common import checkpoint, coded_words, plain_words, text_slices

MATCH, MISMATCH, GAP = 2, -1, -1
#: Bytes of test items that are taken at once; more items mean more passes, not more memory.
BLOCK_BYTES = 8 << 20
#: How far apart the words of a seed may lie.
REACH = 2
FOUND = "doc_id long, item long, at long, words array<int>"


def seeds_needed(n: int, least: float) -> int:
    """Of an item of n words, the seeds that any alignment of share `least` holds; `least` times n is over 1, or else it is only one that holds some."""
    return max(1, ceil(least * n - 1 - 1e-9))


def gaps_allowed(n: int, least: float) -> int:
    """Errors that an alignment of share `least` with an item of n words has at most."""
    return int(2 * n * (1 - least) + 1e-9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def pair_codes(codes: np.ndarray, gap: int) -> np.ndarray:
    """A 64-bit code for each word and the one `gap` after it, whatever the gap, or for the word alone; codes are nonnegative."""
    return _joined(codes[: max(0, len(codes) - gap)], codes[gap:], gap)


def _joined(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    return _mix((a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1 if gap else 1 << 63))


@dataclass
class Items:
    """A block of test items, coded: words by number, and the distinct seeds (sorted codes) with their places, by seed."""

    ids: list[int | None]
    vocabulary: pa.Array
    words: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray  # for each seed, where its places start
    place_item: np.ndarray
    place_at: np.ndarray
    sizes: np.ndarray  # words of each item
    need: np.ndarray  # different seeds of each item that must come together
    least: float

    def rarest(self, counts: np.ndarray) -> Items:
        """Without the most frequent places of each item, half as many as an alignment holds less one, so that it still holds the rest."""
        seed = np.repeat(np.arange(len(self.seeds)), np.diff(self.first))
        spare = (self.need - 1) // 2
        cost = counts[seed] * np.diff(self.first)[seed]
        order = np.lexsort((seed, -cost, self.place_item))
        item = self.place_item[order]
        rank = np.arange(len(order)) - np.searchsorted(item, item)
        keep = np.ones(len(order), dtype=bool)
        keep[order] = rank >= spare[item]
        n = np.bincount(seed[keep], minlength=len(self.seeds))
        full = n > 0
        first = np.concatenate([[0], np.cumsum(n[full])])
        return Items(self.ids, self.vocabulary, self.words, self.seeds[full], first, self.place_item[keep], self.place_at[keep], self.sizes, self.need - spare, self.least)


def code_items(rows: list[tuple[int | None, str | None]], least: float) -> Items:
    """Items without a word are left out; one of a single word has that word as its seed."""
    codes, words, offsets = coded_words(pa.array([t for _, t in rows], pa.large_string()))
    plain = plain_words(words)
    full = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False).astype(bool)
    named = plain.dictionary_encode()
    number = named.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    own = [number[c[full[c]]] for c in np.split(codes, offsets[1:-1])] if len(words) else [np.zeros(0, np.int32)] * len(rows)
    ids, kept = [r[0] for r, w in zip(rows, own, strict=True) if len(w)], [w for w in own if len(w)]
    seeds, item, at = [], [], []
    for k, w in enumerate(kept):
        for gap in range(1, REACH + 1) if len(w) > 1 else [0]:
            code = pair_codes(w, gap)
            seeds.append(code)
            item.append(np.full(len(code), k))
            at.append(np.arange(len(code)))
    flat, item, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (seeds, item, at))
    order = np.argsort(flat, kind="stable")
    distinct, first = np.unique(flat[order], return_index=True)
    sizes = np.array([len(w) for w in kept], dtype=np.int64)
    need = np.array([seeds_needed(n, least) for n in sizes], dtype=np.int64)
    return Items(ids, named.dictionary, kept, distinct, np.append(first, len(flat)), item[order], at[order], sizes, need, least)


def _known(items: Items, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts' words, -1 where no item has the word, and where each text's words start."""
    codes, words, offsets = coded_words(texts)
    plain = plain_words(words)
    full = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False).astype(bool)[codes]
    known = pc.fill_null(pc.index_in(plain, value_set=items.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32)[codes]
    return known[full], np.concatenate([[0], np.cumsum(full)])[offsets]


def _hits(items: Items, known: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Position, seed and text of all seeds found."""
    here = np.flatnonzero(known >= 0)  # few words, mostly
    doc = np.searchsorted(starts, here, side="right") - 1
    out = []
    for gap in range(REACH + 1):
        if gap and not len(here):
            break
        ok = here + gap < starts[doc + 1]
        p, d = here[ok], doc[ok]
        ok = known[p + gap] >= 0
        p, d = p[ok], d[ok]
        code = _joined(known[p], known[p + gap], gap)
        k = np.minimum(np.searchsorted(items.seeds, code), len(items.seeds) - 1)
        found = items.seeds[k] == code
        out.append(np.stack([p[found], k[found], d[found]]))
    pos, seed, doc = np.concatenate(out, axis=1)
    return pos, seed, doc


def _counted(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(items.seeds), dtype=np.int64)
        for batch in batches:
            for part in text_slices([batch]):
                _, seed, _ = _hits(items, *_known(items, part.column("text")))
                counts += np.bincount(seed, minlength=len(counts))
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], names=["seed", "n"])

    return run


def _passages(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    allowed = np.array([gaps_allowed(n, items.least) for n in items.sizes], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            known, starts = _known(items, batch.column("text"))
            pos, seed, doc = _hits(items, known, starts)
            if not len(pos):
                continue
            times = items.first[seed + 1] - items.first[seed]
            pos, doc = np.repeat(pos, times), np.repeat(doc, times)
            place = np.arange(len(pos)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(items.first[seed], times)
            item = items.place_item[place]
            order = np.lexsort((pos, item, doc))
            pos, doc, item, place = (x[order] for x in (pos, doc, item, place))
            new = np.ones(len(pos), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - pos[:-1] > (items.sizes + allowed)[item[1:]])
            group = np.cumsum(new) - 1
            order = np.lexsort((place, group))
            fresh = np.ones(len(order), dtype=bool)
            fresh[1:] = (group[order][1:] != group[order][:-1]) | (place[order][1:] != place[order][:-1])
            cut = np.flatnonzero(new)
            enough = np.bincount(group[order][fresh], minlength=len(cut)) >= items.need[item[cut]]
            if not enough.any():
                continue
            at, room = items.place_at[place], allowed[item]
            low = np.maximum(np.minimum.reduceat(pos - at - room, cut), starts[doc[cut]])[enough]
            high = np.minimum(np.maximum.reduceat(pos - at + items.sizes[item] + room, cut), starts[doc[cut] + 1])[enough]
            cut = cut[enough]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(doc[cut])), pa.array(item[cut].astype(np.int64)),
                pa.array(low - starts[doc[cut]]), pa.array([known[a:b] for a, b in zip(low, high, strict=True)], pa.list_(pa.int32())),
            ], names=["doc_id", "item", "at", "words"])

    return run


def align(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of one item with many passages: best score, and where in the passage that alignment starts and ends.

    Cells hold score and start in one number, so that the better score wins and, of equal ones, the later start. Gaps
    along the passage are a running maximum.
    """
    width = max(map(len, passages))
    text = np.full((len(passages), width), -2, dtype=np.int64)
    for k, p in enumerate(passages):
        text[k, : len(p)] = p
    unit, cols = np.int64(1 << 32), np.arange(width, dtype=np.int64)
    slope = -GAP * unit * cols
    prev, zero = np.tile(cols + 1, (len(passages), 1)), cols + 1
    best, end = np.zeros(len(passages), dtype=np.int64), np.zeros(len(passages), dtype=np.int64)
    for w in item:
        diagonal = np.concatenate([np.zeros((len(passages), 1), np.int64), prev[:, :-1]], axis=1)
        diagonal += np.where(text == w, MATCH, MISMATCH) * unit
        row = np.maximum(np.maximum(diagonal, prev + GAP * unit), zero)
        row = np.maximum.accumulate(row + slope, axis=1) - slope
        row = np.where(row < unit, zero, row)
        k = row.argmax(axis=1)
        top = row[np.arange(len(passages)), k]
        up = top >> 32 > best >> 32
        best, end = np.where(up, top, best), np.where(up, k + 1, end)
        prev = row
    return best >> 32, best & (unit - 1), end


def reachable(item: np.ndarray, passage: np.ndarray) -> float:
    """The score, as a share of a full copy's, that no alignment of the passage exceeds: each word that both hold matches at most as often as in the one that has fewer of it."""
    words, n = np.unique(item, return_counts=True)
    k = np.minimum(np.searchsorted(words, passage), len(words) - 1)
    own = np.bincount(k[words[k] == passage], minlength=len(words))
    return MATCH * np.minimum(own, n).sum() / (MATCH * len(item))


def _aligner(items: list[np.ndarray], least: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            near = frame[[reachable(items[i], w) >= least for i, w in zip(frame["item"], frame["words"], strict=True)]]
            for item, own in near.groupby("item"):
                words = items[item]
                own = own.iloc[np.argsort([len(w) for w in own["words"]], kind="stable")]
                step = max(1, 2_000_000 // max(1, len(own["words"].iloc[-1])))
                for a in range(0, len(own), step):
                    part = own.iloc[a : a + step]
                    score, low, high = align(words, list(part["words"]))
                    share = score / (MATCH * len(words))
                    ok = share >= least
                    at = part["at"].to_numpy()[ok]
                    yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64")[ok], "item": item, "score": share[ok], "start_word": at + low[ok], "end_word": at + high[ok]})

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: each pair of a document and a test item whose best alignment scores
    `least` or more, as a share of the score of a full copy; words are counted from 0, without those that have no letter,
    digit or underscore. No such pair is missed where `least` times an item's words is over 1 (three words or more, by default).

    docs: doc_id, text, read whole; benchmark: item_id, text, in blocks of at most about BLOCK_BYTES. Null and wordless
    texts and items match nothing. Repeated rows count once for each pair of ids; null ids group together.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null")
    blocks = -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK_BYTES)
    found, texts = None, docs.select(F.col("doc_id").cast("long"), "text")
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        coded = code_items([tuple(r) for r in rows], least)
        if not coded.words:
            continue
        met = texts.select("text").mapInArrow(_counted(coded), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toPandas()  # a block's seeds
        counts = np.zeros(len(coded.seeds), dtype=np.int64)
        counts[met["seed"].to_numpy()] = met["n"].to_numpy()
        cut = checkpoint(texts.mapInArrow(_passages(coded.rarest(counts)), FOUND))
        names = spark.createDataFrame(list(enumerate(coded.ids)), "of int, item_id long")
        hits = cut.mapInPandas(_aligner(coded.words, least), "doc_id long, item long, score double, start_word long, end_word long")
        best = hits.groupBy("doc_id", "item").agg(F.max(F.struct("score", "start_word", "end_word")).alias("best"))
        best = best.join(F.broadcast(names), best["item"] == names["of"]).select("doc_id", "item_id", "best.*")  # names: the block's items
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "doc_id long, item_id long, score double, start_word long, end_word long")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "start_word", "end_word")).alias("best")).select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose doc_id has no match; rows without doc_id stay."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["bad_id"], "left_anti")

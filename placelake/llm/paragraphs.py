"""Substring dedup by paragraph MinHash banding.

A paragraph is a run of whole sentences: it ends at the first sentence end (or line end) after which its last sentence has
eight words or more, so that a passage is cut alike wherever it stands, also in the middle of a line. Paragraphs are sets
of five-word shingles. MinHash bands bring near-equal ones together, exact Jaccard verifies them, components cluster them,
and of each cluster all but the first paragraph (by doc_id and place) is a removal. Equal paragraphs share a content hash
and meet without any pair.

Verbatim passages are found by content too, wherever sentences end: blocks of BLOCK words are picked by winnowing, so that
any WINDOW + BLOCK - 1 words hold one that is picked in every other place of them. Blocks that several rows hold are
extended word by word against the first of them. Passages are runs of clustered paragraphs and such blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placelake.llm.common import OTHER, apart, checkpoint, coded_words, hashed_words, mixed, plain_words, shared_dir, text_slices
from placelake.llm.components import components
from placelake.llm.tokens import _move, _open, local_path

SHINGLE, LEAST_SENTENCE = 5, 8
#: Words of a block, and positions of which one is picked at least; together any 50 words hold a picked block.
BLOCK, WINDOW = 20, 31
#: Bits of the filter that a second scan is sieved with: least, for each content, and most. Joins after it are exact.
FILTER_BITS, BITS_EACH, MOST_BITS = 1 << 24, 16, 1 << 29
#: Pieces that a filter is written in.
PIECES = 64
NEWLINE = "\x1e"
#: Bytes of text cut at once: some fifteen arrays of its words and shingles are held beside it.
SLICE = 1 << 19


def tune_bands(similarity: float, recall: float, apart: float = 0.3, at_most: float = 0.2) -> tuple[int, int]:
    """(bands, rows): the fewest keys that bring pairs of that similarity together with probability `recall`, and pairs that are alike by `apart` with `at_most`."""
    rows = 1
    while True:
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if 1 - (1 - apart**rows) ** bands <= at_most:
            return bands, rows
        rows += 1


def _each(flags: pa.Array) -> np.ndarray:
    return flags.to_numpy(zero_copy_only=False).astype(bool)


class Cut:
    """Paragraphs of a slice of texts. Arrays: shingle (codes of all shingles), first (each paragraph's first shingle), doc, place, size (words), content; hashes (of all words), starts (each text's first word)."""

    def __init__(self, texts: pa.Array, words_only: bool = False):
        marked = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", f" {NEWLINE} ")
        codes, words, offsets = coded_words(marked)
        plain = plain_words(words)
        full = _each(pc.greater(pc.binary_length(plain), 0))[codes]
        ends = _each(pc.match_substring_regex(words, f"^{NEWLINE}$|[.!?。]{OTHER}*$"))[codes]
        hashes = hashed_words(plain)[codes][full] if len(words) else np.zeros(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(full)])
        starts = before[offsets]
        n = len(hashes)
        self.doc = self.place = self.size = np.zeros(0, np.int64)
        self.shingle = self.content = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.hashes, self.starts = hashes, starts
        if not n or words_only:
            return
        last = np.zeros(n, dtype=bool)  # whether a word ends a sentence; marks without a word end the word before them
        at = before[1:][ends] - 1
        last[at[at >= 0]] = True
        last[starts[1:][starts[1:] > 0] - 1] = True
        stop = np.flatnonzero(last) + 1
        length = np.diff(np.concatenate([[0], stop]))
        closing = (length >= LEAST_SENTENCE) | np.isin(stop, starts[1:])
        stop = stop[closing]
        begin = np.concatenate([[0], stop[:-1]])
        self.size = stop - begin
        self.doc = np.searchsorted(starts, begin, side="right") - 1
        self.place = begin - starts[self.doc]
        short = self.size < SHINGLE
        count = np.where(short, 1, self.size - SHINGLE + 1)
        self.first = np.cumsum(count) - count
        rolled = np.zeros(n, dtype=np.uint64)
        padded = np.concatenate([hashes, np.zeros(SHINGLE, np.uint64)])
        for k in range(SHINGLE):
            rolled = mixed(rolled + padded[k : k + n])
        index = np.repeat(begin - self.first, count) + np.arange(count.sum())
        self.shingle = rolled[index]
        for k in np.flatnonzero(short):  # all words of a paragraph too short for a shingle
            x = np.zeros(1, np.uint64)
            for h in hashes[begin[k] : stop[k]]:
                x = mixed(x + h + np.uint64(1))
            self.shingle[self.first[k]] = x[0]
        place = np.arange(len(self.shingle)) - np.repeat(self.first, count)
        spread = mixed(self.shingle + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.content = mixed(np.add.reduceat(spread, self.first) + self.size.astype(np.uint64))


def _slide(x: np.ndarray, f: np.ufunc, back: bool = False) -> np.ndarray:
    """f over the WINDOW values from each one on, or up to each one."""
    x, n = x[::-1] if back else x, len(x)
    edge = np.uint64(0) if f is np.maximum else ~np.uint64(0)
    x, wide = np.append(x, np.full(WINDOW, edge)), 1
    while wide < WINDOW:
        step = min(wide, WINDOW - wide)
        x[: len(x) - step] = f(x[: len(x) - step], x[step:])
        wide += step
    return x[:n][::-1] if back else x[:n]


def blocks(cut: Cut) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (among the words of all texts), text and content of the picked blocks, in order.

    A block is picked if it has the least content of any WINDOW positions. Of equal ones that overlap, as in text that
    repeats a few words, one in BLOCK positions is kept, and the first.
    """
    h, starts = cut.hashes, cut.starts
    if len(h) < BLOCK:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    wide, x = 1, mixed(h + np.uint64(7))
    four = x
    while wide < 16:
        x = mixed(x[:-wide] * np.uint64(0x9E3779B97F4A7C15) + x[wide:])
        wide *= 2
        four = x if wide == 4 else four
    x = mixed(x[: len(h) - BLOCK + 1] * np.uint64(0x9E3779B97F4A7C15) + four[16 : 16 + len(h) - BLOCK + 1])
    for b in starts[1:-1]:  # those that reach over the end of a text
        x[max(0, b - BLOCK + 1) : b] = ~np.uint64(0)
    at = np.flatnonzero((_slide(_slide(x, np.minimum), np.maximum, back=True) == x) & (x != ~np.uint64(0)))
    order = np.lexsort((at, x[at]))
    p, v = at[order], x[at][order]
    fresh = np.ones(len(p), dtype=bool)
    fresh[1:] = (v[1:] != v[:-1]) | (p[1:] - p[:-1] >= BLOCK)
    if len(p):
        turn = (p - p[np.maximum.accumulate(np.where(fresh, np.arange(len(p)), 0))]) // BLOCK
        fresh[1:] |= turn[1:] != turn[:-1]
    at = np.sort(p[fresh])
    return at, np.searchsorted(starts, at, side="right") - 1, x[at]


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each content of a slice's blocks once, with the first and the last row that has it."""
    for batch in text_slices(batches, most=SLICE):
        _, doc, content = blocks(Cut(batch.column("text"), words_only=True))
        if len(doc):
            at = batch.column("at").to_numpy()[doc]
            order = np.lexsort((at, content))
            at, content = at[order], content[order]
            new = np.append(True, content[1:] != content[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(content[new].view(np.int64)), pa.array(at[new]), pa.array(at[np.append(new[1:], True)])], names=["content", "low", "high"])


def _held(wanted: Bits, content: np.ndarray) -> np.ndarray:
    """Whether a filter's bit is set for each content."""
    bits = wanted.array()
    spot = (content & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1


def _around(wanted: Bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of wanted contents, with the hashes of the words before and after that no wanted block beside them holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=SLICE):
            cut = Cut(batch.column("text"), words_only=True)
            at, doc, content = blocks(cut)
            k = np.flatnonzero(_held(wanted, content))
            if not len(k):
                continue
            at, doc, content = at[k], doc[k], content[k]
            start, end = cut.starts[doc], cut.starts[doc + 1]
            low, high = np.maximum(at - WINDOW, start), np.minimum(at + BLOCK + WINDOW, end)
            same = doc[1:] == doc[:-1]
            low[1:] = np.where(same, np.clip(at[:-1] + BLOCK, low[1:], at[1:]), low[1:])
            high[:-1] = np.where(same, np.clip(at[1:], at[:-1] + BLOCK, high[:-1]), high[:-1])
            h = (cut.hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)  # half of each is enough to compare neighbours by
            of = pa.array(doc)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(of), batch.column("row_id").take(of), pa.array(at - start), pa.array(content.view(np.int64)),
                pa.array([h[a:b][::-1] for a, b in zip(low, at, strict=True)], pa.list_(pa.int32())), pa.array([h[a:b] for a, b in zip(at + BLOCK, high, strict=True)], pa.list_(pa.int32())),
            ], names=["doc_id", "row_id", "place", "content", "before", "after"])

    return run


def band_keys(cut: Cut, bands: int, rows: int) -> np.ndarray:
    """Bands x paragraphs keys."""
    out = []
    for band in range(bands):
        key = np.full(len(cut.first), band + 1, dtype=np.uint64)
        for row in range(rows):
            seed = mixed(np.array([band * rows + row + 1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            key = mixed(key ^ np.minimum.reduceat(mixed(cut.shingle ^ seed), cut.first))
        out.append(key)
    return np.array(out)


def _keyed(bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=SLICE):
            cut = Cut(batch.column("text"))
            if not len(cut.first):
                continue
            content, where, n = np.unique(cut.content, return_index=True, return_counts=True)
            where = np.append(where, where[n > 1])  # twice, if it is there more than once
            for key in band_keys(cut, bands, rows):
                yield pa.RecordBatch.from_arrays([pa.array(key[where].view(np.int64)), pa.array(cut.content[where].view(np.int64))], names=["key", "content"])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: (key, content) once each, for keys that more than one paragraph has; `many`: of several contents."""
    held = [np.zeros(0, np.int64)] * 2

    def met(key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((content, key))
        key, content = key[order], content[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
        cut = np.flatnonzero(new)
        return key[cut], content[cut], np.diff(np.append(cut, len(key)))

    def out(key: np.ndarray, content: np.ndarray) -> pa.RecordBatch:
        key, content, n = met(key, content)
        _, back, contents = np.unique(key, return_inverse=True, return_counts=True)
        total = np.bincount(back, weights=n) if len(key) else np.zeros(0)
        keep, many = total[back] > 1, contents[back] > 1
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(content[keep]), pa.array(many[keep])], names=["key", "content", "many"])

    for batch in batches:
        cols = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0  # the last key may go on
        yield out(*(c[:cut] for c in cols))
        key, content, n = met(*(c[cut:] for c in cols))  # of a hot key, only what differs is held
        twice = np.minimum(n, 2)
        held = [np.repeat(key, twice), np.repeat(content, twice)]
    yield out(*held)


def _sieved(wanted: Bits, compared: Bits) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, most=SLICE):
            cut = Cut(batch.column("text"))
            k = np.flatnonzero(_held(wanted, cut.content))
            if not len(k):
                continue
            high, full = np.append(cut.first[1:], len(cut.shingle)), _held(compared, cut.content)
            sets = [np.unique(cut.shingle[cut.first[x] : high[x]].view(np.int64)) if full[x] else None for x in k]
            number = np.arange(len(cut.doc)) - np.searchsorted(cut.doc, cut.doc)
            of = pa.array(cut.doc[k])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(of), batch.column("row_id").take(of), pa.array(number[k]), pa.array(cut.place[k]), pa.array(cut.size[k]), pa.array(cut.content[k].view(np.int64)), pa.array(sets, pa.list_(pa.int64())),
            ], names=["doc_id", "row_id", "number", "place", "size", "content", "shingles"])

    return run


def _near(own: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: float) -> np.ndarray:
    """Which of the sets, side by side in `values`, each sorted, have a Jaccard similarity of `least` with the sorted set `own`."""
    index = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    values = values[index]
    same = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
    both = np.add.reduceat(same.astype(np.int64), np.cumsum(sizes) - sizes)
    return both >= least * (len(own) + sizes - both)


def bucket_links(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one bucket: each set that is reached is searched from once, against those not reached yet."""
    left, right = [], []
    todo = np.arange(len(starts))
    while len(todo) > 1:
        queue, todo = [int(todo[0])], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            k = np.flatnonzero((sizes[todo] >= least * sizes[x]) & (least * sizes[todo] <= sizes[x]))  # sets of other sizes can't be alike
            if not len(k):
                continue
            near = k[_near(values[starts[x] : starts[x] + sizes[x]], values, starts[todo[k]], sizes[todo[k]], least)]
            left += [x] * len(near)
            right += todo[near].tolist()
            queue += todo[near].tolist()
            todo = np.delete(todo, near)
    return left, right


def _links(table: pa.Table, least: float) -> pa.RecordBatch:
    """Links within buckets, whose rows (key, content, shingles) lie side by side."""
    key, content = table.column("key").to_numpy(), table.column("content").to_numpy()
    lists = table.column("shingles").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = np.asarray(lists.offsets).astype(np.int64)
    values, starts, sizes = lists.values.to_numpy(), offsets[:-1], np.diff(offsets)
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    left, right = [], []
    pairs = cut[np.diff(np.append(cut, len(key))) == 2]  # most buckets
    own = np.flatnonzero((sizes[pairs] >= least * sizes[pairs + 1]) & (sizes[pairs + 1] >= least * sizes[pairs]))
    for a in pairs[own].tolist():
        x, y = values[starts[a] : starts[a] + sizes[a]], values[starts[a + 1] : starts[a + 1] + sizes[a + 1]]
        both = len(set(x.tolist()).intersection(y.tolist()))
        if both >= least * (len(x) + len(y) - both):
            left.append(a)
            right.append(a + 1)
    for a, b in zip(cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=True):
        if b - a > 2:
            x, y = bucket_links(values, starts[a:b], sizes[a:b], least)
            left += [a + k for k in x]
            right += [a + k for k in y]
    return pa.RecordBatch.from_arrays([pa.array(content[np.array(left, dtype=np.int64)]), pa.array(content[np.array(right, dtype=np.int64)])], names=["a", "b"])


def _alike(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come sorted by key; a bucket is gathered as columns of numbers, whatever the batches it comes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            if held and key[0] != last:
                yield _links(pa.Table.from_batches(held), least)
                held = []
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield _links(pa.Table.from_batches([*held, batch.slice(0, cut)]), least)
                held = []
            held.append(batch.slice(cut))
            last = key[-1]
        if held:
            yield _links(pa.Table.from_batches(held), least)

    return run


def _pieces(folder: str, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the pieces of a filter whose bits come (all of a piece in one task), a file each; gives their numbers."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, width = {}, bits // PIECES
        for batch in batches:
            spot = np.sort(batch.column("spot").to_numpy())
            first = np.arange(PIECES + 1) * width
            cuts = np.searchsorted(spot, first)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                at = spot[cuts[k] : cuts[k + 1]] - first[k]
                np.bitwise_or.at(held.setdefault(k, np.zeros(width >> 3, np.uint8)), at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for k, piece in held.items():
            tried = f"{folder}/{k}.{TaskContext.get().taskAttemptId()}.tmp"
            with _open(tried, "wb") as file:
                file.write(piece.tobytes())
            _move(tried, f"{folder}/{k}")  # a task that runs again writes the same bytes
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32())], names=["piece"])

    return write


class Bits:
    """A filter's bits in a file of the shared folder, which workers map; where it can't be mapped, each task reads it."""

    def __init__(self, uri: str):
        self.uri, self.loaded = uri, None

    def __reduce__(self):
        return Bits, (self.uri,)

    def array(self) -> np.ndarray:
        if self.loaded is None:
            if path := local_path(self.uri):
                self.loaded = np.memmap(path, dtype=np.uint8, mode="r")
            else:
                with _open(self.uri, "rb") as file:
                    self.loaded = np.frombuffer(file.read(), dtype=np.uint8)
        return self.loaded


def _filter_bits(contents: DataFrame) -> Bits:
    """A bit set for each content. Executors write it by pieces, which the driver joins one by one; beyond MOST_BITS the filter lets more through."""
    n = max(FILTER_BITS, min(MOST_BITS, 1 << (BITS_EACH * contents.count()).bit_length()))
    folder = f"{shared_dir(contents.sparkSession)}/filter-{uuid.uuid4().hex}"
    spots = contents.select(F.col("content").bitwiseAND(F.lit(n - 1).cast("long")).alias("spot"))
    dealt = spots.repartition(F.expr(f"spot div {n // PIECES}"))
    there = {r.piece for r in dealt.mapInArrow(_pieces(folder, n), "piece int").collect()}
    with _open(f"{folder}/bits", "wb") as out:
        for k in range(PIECES):
            if k in there:
                with _open(f"{folder}/{k}", "rb") as file:
                    out.write(file.read())
            else:
                out.write(bytes(n // PIECES // 8))
    return Bits(f"{folder}/bits")


#: What orders the places of a cluster or block: rows without a doc_id come last.
PLACE = ["none", "doc_id", "row_id", "copy", "place"]


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("row_id"))


def _numbered(found: DataFrame) -> DataFrame:
    """Adds `copy`, which tells equal rows apart: their records are equal, so that the n-th of each make up the n-th row; and `none`."""
    of = Window.partitionBy("doc_id", "row_id", "place", "content").orderBy("doc_id")
    return found.withColumn("copy", F.row_number().over(of) - 1).withColumn("none", F.col("doc_id").isNull())


def clustered(docs: DataFrame, similarity: float = 0.8, recall: float = 0.98) -> DataFrame:
    """Paragraphs that have a near-equal one elsewhere: doc_id, row_id, copy, number, place, size, cluster, kept.

    number and place count paragraphs and words of a row from 0, size counts words; cluster is the same for all paragraphs
    reachable by links; kept marks the first of each cluster by (doc_id, row_id, copy, place), rows without a doc_id last.
    row_id tells rows of one doc_id apart, and copy equal rows. Null, empty and wordless texts have no paragraphs.
    """
    rows = _rows(docs)
    bands, deep = tune_bands(similarity, recall)
    keyed = rows.mapInArrow(_keyed(bands, deep), "key long, content long")
    met = checkpoint(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "key long, content long, many boolean"))
    near = met.where("many").select("key", "content")
    sieve = _sieved(_filter_bits(met.select("content")), _filter_bits(near.select("content")))
    found = checkpoint(rows.mapInArrow(sieve, "doc_id long, row_id long, number long, place long, size long, content long, shingles array<long>"))
    sets = found.where("shingles is not null").groupBy("content").agg(F.first("shingles").alias("shingles"))
    compared = near.join(sets.select(F.col("content").alias("c"), "shingles"), near["content"] == F.col("c")).select("key", "content", "shingles")
    links = compared.repartition("key").sortWithinPartitions("key").mapInArrow(_alike(similarity), "a long, b long")
    roots = components(links)
    repeated = found.groupBy("content").agg(F.count("*").alias("times")).withColumnRenamed("content", "c")
    clusters = repeated.join(roots, repeated["c"] == roots["node"], "left").where("times > 1 or root is not null").select(apart(F.col("c")).alias("c"), F.coalesce("root", "c").alias("cluster"))
    members = found.drop("shingles").join(clusters, found["content"] == clusters["c"]).drop("c")
    members = checkpoint(_numbered(members).drop("content"))
    first = members.groupBy("cluster").agg(F.min(F.struct(*PLACE)).alias("first")).select(apart(F.col("cluster")).alias("of"), "first")
    kept = F.struct(*PLACE).eqNullSafe(F.col("first"))
    return members.join(first, members["cluster"] == first["of"]).select("doc_id", "row_id", "copy", "number", "place", "size", "cluster", kept.alias("kept"), F.col("first.doc_id").alias("first_doc_id"))


def repeated_blocks(docs: DataFrame) -> DataFrame:
    """Blocks that several rows hold word by word, extended: doc_id, row_id, copy, place, size, cluster, kept, first_doc_id.

    A block's first place by (doc_id, row_id, copy, place), rows without a doc_id last, is kept and extended as far as the
    others are that are compared with it.
    """
    rows = _rows(docs)
    held = rows.withColumn("at", F.monotonically_increasing_id()).mapInArrow(_picked, "content long, low long, high long").groupBy("content").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    wanted = checkpoint(held.where("low != high").select(F.col("content").alias("c")))
    around = _around(_filter_bits(wanted.withColumnRenamed("c", "content")))
    found = rows.mapInArrow(around, "doc_id long, row_id long, place long, content long, before array<int>, after array<int>")
    found = checkpoint(_numbered(found.join(wanted, found["content"] == wanted["c"], "left_semi")))
    first = found.groupBy("content").agg(F.min(F.struct(*PLACE, "before", "after")).alias("first")).select(apart(F.col("content")).alias("of"), "first")

    def alike(side: str) -> Column:
        other = F.array_position(F.zip_with(side, f"first.{side}", lambda x, y: ~x.eqNullSafe(y)), True)
        return F.when(other == 0, F.size(side)).otherwise(other - 1).cast("long")

    at = F.struct(*(F.col(f"first.{c}") for c in PLACE))
    met = found.join(first, found["content"] == first["of"]).where(~F.struct(*PLACE).eqNullSafe(at))
    met = checkpoint(met.select(*PLACE, "content", alike("before").alias("l"), alike("after").alias("r"), at.alias("first")))
    kept = met.groupBy("content", "first").agg(F.max("l").alias("l"), F.max("r").alias("r")).select("first.*", "content", "l", "r", F.lit(True).alias("kept"), F.col("first.doc_id").alias("first_doc_id"))
    gone = met.select(*PLACE, "content", "l", "r", F.lit(False).alias("kept"), F.col("first.doc_id").alias("first_doc_id"))
    return kept.unionByName(gone).select("doc_id", "row_id", "copy", (F.col("place") - F.col("l")).alias("place"), (F.col("l") + F.col("r") + BLOCK).alias("size"), F.col("content").alias("cluster"), "kept", "first_doc_id")


def repeated_passages(docs: DataFrame, least_words: int = 20, similarity: float = 0.8, recall: float = 0.98) -> DataFrame:
    """One row per passage: doc_id, row_id, copy, start_word, end_word, n_words, removed_words, first_doc_ids, clusters, kept.

    A passage is a run of clustered paragraphs and repeated blocks, side by side or overlapping, of `least_words` words or
    more. kept: none of them is a removal; removed_words counts the words of those that are. first_doc_ids are the documents that keep them. Equal rows, and rows of one
    doc_id, are documents of their own: each copy but the first is removed. Rows without a doc_id keep a passage only if no other has it.
    """
    found = clustered(docs, similarity, recall).drop("number")
    found = found.unionByName(repeated_blocks(docs).select(*found.columns))
    per_row = found.groupBy("doc_id", "row_id", "copy").agg(F.array_sort(F.collect_set(F.struct("place", "size", "cluster", "kept", "first_doc_id"))).alias("all"))
    joined = F.aggregate(
        "all", F.expr("cast(array() as array<struct<start:bigint,end:bigint,gone:bigint,removed:bigint,firsts:array<bigint>,clusters:array<bigint>>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["place"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(_grown(F.element_at(acc, -1), x))),
        ).otherwise(F.concat(acc, F.array(_grown(None, x)))),
    )
    runs = per_row.select("doc_id", "row_id", "copy", F.explode(joined).alias("r")).where(F.expr(f"r.end - r.start >= {least_words}"))
    return runs.select("doc_id", "row_id", "copy", F.col("r.start").alias("start_word"), F.col("r.end").alias("end_word"), F.expr("r.end - r.start").alias("n_words"), F.col("r.removed").alias("removed_words"),
                       F.array_sort(F.array_distinct("r.firsts")).alias("first_doc_ids"), F.array_sort(F.array_distinct("r.clusters")).alias("clusters"), F.expr("r.removed = 0").alias("kept"))


def _grown(run, x):
    end, gone = x["place"] + x["size"], F.lit(0).cast("long") if run is None else run["gone"]  # gone: where the removed words end so far
    removed = F.when(x["kept"], F.lit(0)).otherwise(F.greatest(F.lit(0), end - F.greatest(x["place"], gone))).cast("long")
    first, cluster = F.array(x["first_doc_id"]), F.array(x["cluster"])
    return F.struct(
        (x["place"] if run is None else run["start"]).alias("start"), (end if run is None else F.greatest(run["end"], end)).alias("end"), F.when(x["kept"], gone).otherwise(F.greatest(gone, end)).alias("gone"),
        (removed if run is None else run["removed"] + removed).alias("removed"), (first if run is None else F.concat(run["firsts"], first)).alias("firsts"), (cluster if run is None else F.concat(run["clusters"], cluster)).alias("clusters"),
    )

"""Token-ID output: flat unsigned integer files with 64-bit document offsets, to be memory-mapped.

A partition is a range of doc_id and writes three files: `.bin` (ids, little-endian, 16 bits where the vocabulary allows,
else 32), `.idx` (64-bit offsets of documents within the file, one more than documents) and `.doc` (64-bit doc_ids). The
manifest, a Parquet table, holds each partition's counts and its base, the prefix sum of the counts before it. Rows without
doc_id come first and are counted there, so that any 64-bit number can be a doc_id.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelake.llm.common import coded_words, shared_dir, text_slices

#: Words whose ids a worker remembers.
REMEMBERED = 1_000_000
#: Marks that are cut off the ends of words and encoded alone, where that changes nothing.
MARKS = (".", ",")
#: Words of letters that are encoded at once.
JOINED = 100


def _kept() -> types.ModuleType:
    """Lives as long as the Python worker: the loaded tokenizer and the words seen."""
    return sys.modules.setdefault("_placelake_kept", types.ModuleType("_placelake_kept"))


def _load(path: str, dtype: str) -> types.ModuleType:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
    kept = _kept()
    if getattr(kept, "path", None) != (path, dtype):
        from tokenizers import Tokenizer

        kept.path, kept.tokenizer, kept.words = (path, dtype), Tokenizer.from_file(path), {}
        ids = lambda t: kept.tokenizer.encode(t, add_special_tokens=False).ids
        kept.ids = ids
        kept.cuts = all(ids(f"ab{m}") == ids("ab") + ids(m) for m in MARKS)
        kept.folds = ids("AbC") == ids("abc")
        kept.closes = _closes(kept)
        kept.fold, kept.last = {}, {}  # of letters outside ASCII: whether lower case, and a cut after them, change nothing
    return kept


def _closes(kept: types.ModuleType) -> np.ndarray | None:
    """Which ids end a piece between white space; None where a vocabulary doesn't tell."""
    from tokenizers.pre_tokenizers import ByteLevel

    suffix, vocabulary = getattr(kept.tokenizer.model, "end_of_word_suffix", None), kept.tokenizer.get_vocab()
    if not suffix or kept.ids("ab cd") != kept.ids("ab") + kept.ids("cd") or any(c + suffix not in vocabulary for c in ByteLevel.alphabet()):
        return None
    out = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
    out[[k for w, k in vocabulary.items() if w.endswith(suffix)]] = True
    return out


def _folds(kept: types.ModuleType, c: str) -> bool:
    """Whether the tokenizer's own normalizer takes a letter and its lower case for the same. A capital sigma's depends on what stands beside it."""
    if c == "Σ":
        return False
    if (ok := kept.fold.get(c)) is None:
        same = kept.tokenizer.normalizer.normalize_str
        ok = kept.fold[c] = same(c) == same(c.lower())
    return ok


def _ends(kept: types.ModuleType, c: str) -> bool:
    """Whether marks after a letter are cut off: not where it is normalized to a letter with marks of its own, which would join them."""
    if (ok := kept.last.get(c)) is None:
        ok = kept.last[c] = all(kept.ids(c + m) == kept.ids(c) + kept.ids(m) for m in MARKS)
    return ok


def _parts(word: str, kept: types.ModuleType) -> tuple[str, str]:
    """A word as what is encoded, and the mark after it: letters and a last stop or comma, where the tokenizer cuts there, in lower case, where it folds."""
    end, own = "", word
    if kept.cuts and word.endswith(MARKS) and word[:-1].isalpha():
        own, end = word[:-1], word[-1]
    elif not word.isalpha():
        return word, ""
    if own.isascii():
        return (own.lower() if kept.folds else own), end
    if end and not _ends(kept, own[-1]):
        return word, ""
    return (own.lower() if kept.folds and all(_folds(kept, c) for c in set(own)) else own), end


def _encode_each(some: list[str], kept: types.ModuleType, dtype: str) -> list[bytes]:
    """Ids of words, each on its own."""
    found = [e.ids for e in kept.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    stops = np.cumsum([len(x) for x in found]) * np.dtype(dtype).itemsize
    raw = np.fromiter(chain.from_iterable(found), dtype=dtype, count=-1).tobytes()
    return [raw[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def _encode_letters(some: list[str], kept: types.ModuleType, dtype: str) -> list[bytes]:
    """Ids of words of letters, many to a call: each gives one piece at least, so that as many ends as words mean one piece each."""
    if kept.closes is None:
        return _encode_each(some, kept, dtype)
    out = []
    groups = [some[k : k + JOINED] for k in range(0, len(some), JOINED)]
    for words, e in zip(groups, kept.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, dtype=dtype)
        stops = ((np.flatnonzero(kept.closes[ids]) + 1) * ids.itemsize).tolist()
        if len(stops) == len(words):
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]
        else:
            out += _encode_each(words, kept, dtype)
    return out


def _encode_new(new: list[str], kept: types.ModuleType, dtype: str) -> None:
    """Adds words to those remembered, and the parts of them that are encoded."""
    parts = [_parts(w, kept) for w in new]
    ends = {m: np.array(kept.ids(m), dtype=dtype).tobytes() for m in MARKS} | {"": b""}
    todo = {w for w, _ in parts if w not in kept.words}
    letters = [w for w in todo if w.isalpha()]
    todo.difference_update(letters)
    for words, encode in ((letters, _encode_letters), (list(todo), _encode_each)):
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            kept.words.update(zip(some, encode(some, kept, dtype), strict=True))
    kept.words.update((w, kept.words[own] + ends[m]) for w, (own, m) in zip(new, parts, strict=True) if w != own)


def _word_ids(words: pa.Array, path: str, dtype: str) -> pa.Array:
    """Ids of each word, as bytes; what was seen before is remembered. Words of ASCII letters are folded and cut by column, as _parts does."""
    kept = _load(path, dtype)
    if len(kept.words) > REMEMBERED:
        kept.words.clear()
    words = words.cast(pa.large_string())
    plain = pc.match_substring_regex(words, "^[A-Za-z]+[.,]?$" if kept.cuts else "^[A-Za-z]+$")
    own = pc.utf8_rtrim(words, "".join(MARKS))
    coded = pc.if_else(plain, pc.ascii_lower(own) if kept.folds else own, words).dictionary_encode()
    names = coded.dictionary.to_pylist()
    ids = list(map(kept.words.get, names))
    at = [k for k, x in enumerate(ids) if x is None]
    if at:
        new = [names[k] for k in at]
        _encode_new(new, kept, dtype)
        for k, w in zip(at, new, strict=True):
            ids[k] = kept.words[w]
    raw = lambda x: pa.scalar(x, pa.large_binary())
    mark = raw(b"")
    for m in MARKS:
        mark = pc.if_else(pc.and_(plain, pc.ends_with(words, m)), raw(np.array(kept.ids(m), dtype=dtype).tobytes()), mark)
    return pc.binary_join_element_wise(pa.array(ids, pa.large_binary()).take(coded.indices), mark, raw(b""))


def _encoded(texts: pa.Array, path: str, by_word: bool, end_id: int, dtype: str) -> Iterator[bytes]:
    end = np.array([end_id], dtype=dtype).tobytes()
    if not by_word:
        for t in texts.to_pylist():
            yield np.array(_load(path, dtype).tokenizer.encode(t or "", add_special_tokens=False).ids, dtype=dtype).tobytes() + end
        return
    codes, words, offsets = coded_words(texts)
    flat = _word_ids(words, path, dtype).take(pa.array(codes))
    _, stops, data = flat.buffers()
    stops = np.frombuffer(stops, np.int64)[flat.offset : flat.offset + len(flat) + 1][offsets].tolist() if len(flat) else [0] * len(offsets)
    data = memoryview(data) if data else memoryview(b"")
    for a, b in zip(stops[:-1], stops[1:], strict=True):
        yield bytes(data[a:b]) + end


def local_path(uri: str) -> str | None:
    """The path where `uri` is of the local file system, shared or not; else None."""
    url = urlparse(uri)
    return url.path if url.scheme in ("", "file") else None


def _open(uri: str, mode: str):
    if path := local_path(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path) if "w" in mode else system.open_input_file(path)


def _move(old: str, new: str) -> None:
    if local_path(old):
        os.replace(local_path(old), local_path(new))
    else:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(old)
        system.move(path, fs.FileSystem.from_uri(new)[1])


class _Stored:
    """A file's numbers by slices: of a store that isn't the local file system, only the bytes asked for are read."""

    def __init__(self, uri: str, dtype: str):
        self.file, self.dtype = _open(uri, "rb"), np.dtype(dtype)

    def __getitem__(self, at: slice) -> np.ndarray:
        first, width = int(at.start), self.dtype.itemsize
        return np.frombuffer(self.file.read_at((int(at.stop) - first) * width, first * width), dtype=self.dtype)


def _mapped(uri: str, dtype: str) -> np.ndarray | _Stored:
    if path := local_path(uri):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.zeros(0, dtype)
    return _Stored(uri, dtype)


def _writer(out: str, path: str, by_word: bool, end_id: int, dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, width = task.partitionId(), np.dtype(dtype).itemsize
        name, tried = f"{out}/part-{part:06d}", f".{task.taskAttemptId()}.tmp"
        docs, at, nulls = 0, 0, 0
        files = {}
        for batch in text_slices(batches):
            if not batch.num_rows:
                continue
            if not files:
                files = {x: _open(f"{name}.{x}{tried}", "wb") for x in ("bin", "idx", "doc")}
                files["idx"].write(np.zeros(1, "<i8").tobytes())
            ends = []
            for raw in _encoded(batch.column("text"), path, by_word, end_id, dtype):
                files["bin"].write(raw)
                at += len(raw) // width
                ends.append(at)
            files["idx"].write(np.array(ends, dtype="<i8").tobytes())
            files["doc"].write(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            docs, nulls = docs + batch.num_rows, nulls + batch.column("doc_id").null_count
        for x, f in files.items():
            f.close()
            _move(f"{name}.{x}{tried}", f"{name}.{x}")  # a task that runs again writes the same bytes
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs], pa.int64()), pa.array([at], pa.int64()), pa.array([nulls], pa.int64())], names=["part", "docs", "tokens", "nulls"])

    return write


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 2, by_word: bool = True) -> str:
    """Encode every whole text of `docs` (doc_id, text), append `end_id`, write in ascending order of doc_id; returns the folder.

    `tokenizer` is a file of the tokenizers library. `by_word` encodes distinct words between ASCII white space once; it
    is exact for tokenizers that drop white space, and must be False for others. Null text counts as empty: the end id alone. Rows without doc_id come first; equal
    doc_ids follow by a hash of their text. An empty table gives a manifest without rows.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    dtype = "<u2" if max(end_id + 1, Tokenizer.from_file(tokenizer).get_vocab_size()) <= 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    met = rows.mapInArrow(_writer(out, tokenizer, by_word, end_id, dtype), "part int, docs long, tokens long, nulls long").collect()
    manifest, base = [], 0
    for m in sorted(met):  # a row for each partition
        manifest.append((m.part, m.docs, m.tokens, m.nulls, base, dtype))
        base += m.tokens
    spark.createDataFrame(manifest, "part int, docs long, tokens long, nulls long, base long, dtype string").coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest")
    return out


def _reader(out: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for m in frame.itertuples():
                name = f"{out}/part-{m.part:06d}"
                ids, ends, docs = _mapped(f"{name}.bin", m.dtype), _mapped(f"{name}.idx", "<i8"), _mapped(f"{name}.doc", "<i8")
                for at in range(0, m.docs, 10_000):
                    to = min(m.docs, at + 10_000)
                    stops = ends[at : to + 1]
                    own = ids[stops[0] : stops[-1]] if stops[-1] > stops[0] else np.zeros(0, m.dtype)
                    crc = [zlib.crc32(own[a:b].astype("<u4").tobytes()) for a, b in zip(stops[:-1] - stops[0], stops[1:] - stops[0], strict=True)]
                    doc = pd.Series(docs[at:to], dtype="Int64").mask(np.arange(at, to) < m.nulls)
                    yield pd.DataFrame({"doc_id": doc, "start": m.base + stops[:-1], "n_tokens": np.diff(stops), "ids_crc32": crc})

    return read


def read_tokens(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids as 32-bit integers), from the files."""
    manifest = spark.read.parquet(f"{out}/manifest")
    # by number, as adaptive execution would put the manifest's few bytes, and so all files, into one task
    return manifest.repartition(max(1, manifest.count()), "part").mapInPandas(_reader(out), "doc_id long, start long, n_tokens long, ids_crc32 long")

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once in a Python worker, whatever the size of the Arrow batch that arrives.
SLICE_BYTES = 8 << 20
#: What words are compared without, beside case: all but letters, digits and underscores.
OTHER = r"[^\p{L}\p{N}_]"


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: spark.checkpoint.dir, or, on a local master alone, a temporary one where that is unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="placelake-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; survives lost executors, unlike a local checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def apart(key: Column) -> Column:
    """A long key as a value that the planner doesn't know to be partitioned, so that a join on it deals both sides anew and may split a hot key."""
    return key.bitwiseXOR(F.lit(0).cast("long"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of text (one row at least)."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, n = 0, batch.num_rows
        while at < n:
            done = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()  # or else a worker keeps what its largest batch took


def coded_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words (split at ASCII white space) of all texts: code of each, the distinct words, and where each text's words start.

    Null texts count as empty. A batch's words are coded once, so that work by word is done on distinct words only.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.asarray(lists.offsets).astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets -= offsets[0]
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:  # at the ends of texts
        full = codes != empty
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        codes = codes[full]
    return codes, words, offsets


def plain_words(words: pa.Array) -> pa.Array:
    """Lower case, letters, digits and underscores only."""
    return pc.replace_substring_regex(pc.utf8_lower(words), f"{OTHER}+", "")


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers (unsigned) spread over all bits."""
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def hashed_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word, by column: bytes as mixed numbers, times powers by their place, added up."""
    words = words.cast(pa.large_string())
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    out = mixed(sizes.astype(np.uint64) + np.uint64(1))
    if len(full):
        raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
        starts = offsets[:-1] - offsets[0]
        powers = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
        values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))[raw] * powers[np.arange(len(raw)) - np.repeat(starts, sizes)]
        out[full] = mixed(out[full] + np.add.reduceat(values, starts[full]))
    return out


def flat_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """As coded_words, the distinct words as a list."""
    codes, words, offsets = coded_words(texts)
    return codes, words.to_pylist(), offsets

"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint of 64 bits has four blocks of 16. Of two fingerprints that differ in three bits or fewer, one block at
least is equal (pigeonhole), and of the 48 bits outside it, cut into two halves, one half has one error at most. The
perfect binary Golay code [23,12,7] decodes every word of 23 bits to one codeword at a distance of three or less: a
fingerprint's *own* key is (block, half, codeword index), and its *several* keys are the indices that any word within one
bit of the half decodes to, one or six of them. If a half of u and of v differ in one bit at most, then v's own index is
among u's. Keys meet in a join, and every pair that meets is verified by its true distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm.common import checkpoint, text_slices
from placelake.llm.components import components

BITS, NEAR, BLOCK = 64, 3, 16
#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _syndrome(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> np.uint32(bit) & np.uint32(1), rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
    return rest


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error pattern; and for each of the 23 bits its syndrome."""
    bits = [_syndrome(np.array([1 << k], dtype=np.uint32))[0] for k in range(23)]
    errors = np.zeros(2048, dtype=np.uint32)
    for n in range(1, 4):
        for which in combinations(range(23), n):
            s, e = 0, 0
            for k in which:
                s, e = s ^ int(bits[k]), e | 1 << k
            errors[s] = e
    return errors, np.array(bits, dtype=np.uint32)


def near_codewords(words: np.ndarray, errors: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords that each word decodes to, and that it decodes to after any one flip: n x 24."""
    s = _syndrome(words)
    out = np.empty((len(words), 24), dtype=np.uint32)
    out[:, 0] = (words ^ errors[s]) >> np.uint32(11)
    for k in range(23):
        out[:, k + 1] = (words ^ np.uint32(1 << k) ^ errors[s ^ bits[k]]) >> np.uint32(11)
    return out


def fingerprint(text: bytes) -> int:
    """Contract: words split at ASCII white space, A-Z lowered, shingles of three words, bit set in over half the hashes."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else [b" ".join(t) for t in zip(words, words[1:], words[2:])]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(shingles), 50_000):
        h = np.array([xxh64_intdigest(s, 42) for s in shingles[at : at + 50_000]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(shingles), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        prints = np.array([fingerprint(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print): the fingerprint of each row's whole text as a signed long; null or empty text: 0."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, print long")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    errors, bits = golay_tables()
    for whole in batches:
        for at in range(0, whole.num_rows, 20_000):
            signed = whole.column(0).slice(at, 20_000).to_numpy()
            prints = signed.view(np.uint64)
            low = np.uint64((1 << BLOCK) - 1)
            for block in range(4):
                exact = prints >> np.uint64(BLOCK * block) & low
                rest = [prints >> np.uint64(BLOCK * k) & low for k in range(4) if k != block]
                joined = rest[0] | rest[1] << np.uint64(16) | rest[2] << np.uint64(32)
                for half in range(2):
                    words = (joined >> np.uint64(24 * half) & np.uint64((1 << 23) - 1)).astype(np.uint32)
                    near = np.sort(near_codewords(words, errors, bits), axis=1)
                    fresh = np.ones(near.shape, dtype=bool)
                    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
                    row, col = np.nonzero(fresh)
                    key = (np.int64(2 * block + half) << np.int64(28)) | exact[row].astype(np.int64) << np.int64(12) | near[row, col].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(signed[row])], names=["key", "print"])


def bucket_links(prints: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one bucket: each print that is reached is searched from once, against those not reached yet."""
    left, right = [], []
    todo = prints
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            near = np.bitwise_count(todo ^ x) <= NEAR
            if near.any():
                hit = todo[near]
                left += [int(x)] * len(hit)
                right += hit.tolist()
                queue += list(hit)
                todo = todo[~near]
    return left, right


def sorted_links(key: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows of equal keys, which lie side by side: small buckets in step, large ones as spanning forests."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    left, right = [], []
    for k in np.flatnonzero(sizes > 32):
        a, b = bucket_links(prints[starts[k] : starts[k] + sizes[k]])
        left.append(np.array(a, dtype=np.uint64))
        right.append(np.array(b, dtype=np.uint64))
    ok = np.repeat((sizes > 1) & (sizes <= 32), sizes)
    k, p = key[ok], prints[ok]
    for step in range(1, 32):
        same = np.flatnonzero(k[step:] == k[:-step]) if len(k) > step else []
        if not len(same):
            break
        same = same[np.bitwise_count(p[same] ^ p[same + step]) <= NEAR]
        left.append(p[same])
        right.append(p[same + step])
    if not left:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1)
    return pairs[0], pairs[1]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept_key, kept_print = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        a, b = sorted_links(key, prints) if len(key) else (prints, prints)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        key = np.concatenate([kept_key, batch.column(0).to_numpy()])
        prints = np.concatenate([kept_print, batch.column(1).to_numpy().view(np.uint64)])
        cut = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last bucket may go on
        yield links(key[:cut], prints[:cut])
        kept_key, kept_print = key[cut:], prints[cut:]
    yield links(kept_key, kept_print)


def near_groups(prints: DataFrame) -> DataFrame:
    """(print, component_id) for each distinct fingerprint of (doc_id, print): the smallest doc_id reachable by links."""
    classes = checkpoint(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    keys = classes.select("print").mapInArrow(_keys, "key long, print long")
    links = keys.repartition("key").sortWithinPartitions("key").mapInArrow(_verified, "a long, b long")
    roots = components(links)
    joined = classes.join(roots, classes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.join(least, "root").select("print", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): doc_id, print, component_id.

    Exact copies share a fingerprint and are grouped before keys are made. Empty and null texts share fingerprint 0. Rows
    without a doc_id are kept and never name a component unless all of its rows lack one. Repeated rows come back repeated.
    """
    prints = checkpoint(fingerprints(docs))
    groups = near_groups(prints).withColumnRenamed("print", "of")
    return prints.join(groups, prints["print"] == groups["of"]).select("doc_id", "print", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its component; rows without doc_id stay."""
    gone = near_duplicates(docs).where("doc_id != component_id").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")

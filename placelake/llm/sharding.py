"""Sharding on a consistent-hash ring with virtual nodes and bounded loads; DataFrame operations only."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm.common import checkpoint

#: The ring's positions are looked up by their first so many bits.
PREFIX = 12


def virtual_nodes(n_shards: int, per_shard: int) -> list[tuple[int, int]]:
    """(position, shard) in ring order; positions are signed 64-bit numbers drawn from a hash of shard and number."""
    at = lambda s, v: int.from_bytes(hashlib.sha256(f"shard {s} node {v}".encode()).digest()[:8], "big", signed=True)
    return sorted((at(s, v), s) for s in range(n_shards) for v in range(per_shard))


def capacities(n: int, n_shards: int, slack: float | None) -> list[int]:
    """Rows that each shard may take: even, at most one apart, or (1 + slack) times the mean, rounded up."""
    if slack is None:
        return [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    return [-int(-(1 + slack) * n // n_shards)] * n_shards


def spill_clockwise(counts: list[int], owners: list[int], room: list[int]) -> list[tuple[int, int, int, int]]:
    """(arc, from, to, shard): which ranks of each arc go to which shard.

    Each arc's rows first fill its own shard; what finds it full walks clockwise to the next virtual node with room.
    """
    room, out, over = list(room), [], []
    for arc, n in enumerate(counts):
        took = min(n, room[owners[arc]])
        room[owners[arc]] -= took
        if took:
            out.append((arc, 0, took, owners[arc]))
        if took < n:
            over.append((arc, took, n))
    for arc, low, high in over:
        node = arc
        while low < high:
            node = (node + 1) % len(owners)
            took = min(high - low, room[owners[node]])
            if took:
                room[owners[node]] -= took
                out.append((arc, low, low + took, owners[node]))
                low += took
    return out


def ring_shards(docs: DataFrame, n_shards: int = 16, per_shard: int = 64, slack: float | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id, size (UTF-8 bytes of text, plus 1), text_crc32, home_shard, shard, slot.

    A row's place on the ring is a hash of its doc_id; its home is the shard of the next virtual node clockwise. Without
    `slack` the shards' counts are at most one apart; with it a shard takes (1 + slack) times the mean at most. Ranks
    within an arc follow (hash, doc_id, crc32, size) and slots are gapless from 0 in each shard. The driver sees one row
    for each arc and partition that meet, never rows of the table. Null texts have size 1 and crc32 0; null ids share one
    place; equal rows get slots of their own; an empty table gives an empty result.
    """
    spark, ring = docs.sparkSession, virtual_nodes(n_shards, per_shard)
    places, owners = [p for p, _ in ring], [s for _, s in ring]
    width = 1 << (64 - PREFIX)
    table = []
    for k in range(1 << PREFIX):
        low = -(1 << 63) + k * width
        first, end = bisect_left(places, low), bisect_left(places, low + width)
        table.append((k, first, places[first:end]))
    lookup = F.broadcast(spark.createDataFrame(table, "prefix int, first int, inside array<long>"))  # 4096 rows, always
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.xxhash64("doc_id").alias("place"),
    )
    rows = rows.withColumn("prefix", (F.shiftright("place", 64 - PREFIX) + (1 << (PREFIX - 1))).cast("int")).join(lookup, "prefix")
    arc = F.col("first") + F.size(F.filter("inside", lambda x: x < F.col("place")))
    order = ["arc", "place", "doc_id", "text_crc32", "size"]
    rows = rows.select("doc_id", "size", "text_crc32", "place", (arc % len(ring)).alias("arc"))
    rows = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id()))
    met = rows.groupBy(F.shiftright("id", 33).alias("part"), "arc").agg(F.count("*").alias("n"), F.min("id").alias("id")).orderBy("arc", "id").collect()
    counts = [0] * len(ring)
    for m in met:
        counts[m.arc] += m.n
    total = sum(counts)
    split = spill_clockwise(counts, owners, capacities(total, n_shards, slack))
    by_arc: dict[int, list[tuple[int, int, int, int]]] = {}
    filled = [0] * n_shards
    for a, low, high, shard in split:
        by_arc.setdefault(a, []).append((low, high, shard, filled[shard]))
        filled[shard] += high - low
    pieces, rank, last = [], 0, None
    for m in met:
        rank = 0 if m.arc != last else rank
        last = m.arc
        for low, high, shard, slot in by_arc.get(m.arc, ()):
            a, b = max(low, rank), min(high, rank + m.n)
            if a < b:
                pieces.append((m.part, m.arc, m.id + a - rank, m.id + b - rank, owners[m.arc], shard, slot + a - low))
        rank += m.n
    deal = spark.createDataFrame(pieces, "part long, at int, from_id long, to_id long, home_shard int, shard int, slot0 long")
    on = (F.shiftright(rows["id"], 33) == deal["part"]) & (rows["arc"] == deal["at"]) & (rows["id"] >= deal["from_id"]) & (rows["id"] < deal["to_id"])
    # pieces: arcs, partitions and shards bound their number, rows don't
    return rows.join(F.broadcast(deal), on).select("doc_id", "size", "text_crc32", "home_shard", "shard", (rows["id"] - deal["from_id"] + deal["slot0"]).alias("slot"))

"""Ordered change feeds with Structured Streaming: each micro-batch is merged into a table of elements by sequence."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table as of the last merge."""
    pointer = Path(folder, "CURRENT")
    return spark.read.parquet(f"{folder}/{pointer.read_text()}") if pointer.exists() else None


def merge_batch(folder: str, keys: list[str]):
    """A foreachBatch function: of old rows and new ones the highest `seq` wins by key, tombstones (`deleted`) included, so that
    a batch that comes again, or late, changes nothing. The new table is written beside the old and a pointer is swapped."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = current(spark, folder)
        rows = batch if old is None else old.unionByName(batch)
        rest = [c for c in rows.columns if c not in keys]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("v")).select(*keys, *(F.col("v")[c].alias(c) for c in rest))
        name = f"v-{batch_id}-{uuid.uuid4().hex}"
        best.write.parquet(f"{folder}/{name}")
        tmp = Path(folder, "CURRENT.tmp")
        tmp.write_text(name)
        tmp.replace(Path(folder, "CURRENT"))

    return run


def follow(source: DataFrame, folder: str, keys: list[str], checkpoint: str):
    """Merge what a stream has now and stop; call again for more."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    return source.writeStream.foreachBatch(merge_batch(folder, keys)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(table: DataFrame) -> DataFrame:
    return table.where("not deleted")


def gap(sequences: DataFrame, most: int = 90) -> DataFrame:
    """first, last, missing, too_far: whether a run of sequence numbers (column seq) is whole, and short enough to apply one by one."""
    row = sequences.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_distinct("seq").alias("n"))
    return row.select("first", "last", (F.col("last") - F.col("first") + 1 - F.col("n")).alias("missing"), (F.col("last") - F.col("first") > most).alias("too_far"))

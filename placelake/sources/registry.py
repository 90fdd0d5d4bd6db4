"""Sources of data, their versions, data folders: generation, lock, stale partitions, writers and readers of partitions."""

from __future__ import annotations

import fcntl
import json
import os
import re
import shutil
import uuid
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placelake.functions import geo
from placelake.schema import LAYERS

FORMAT = 8


def detect_format(location: str) -> str:
    name = location.split("?")[0].lower()
    for end, kind in ((".osm.pbf", "pbf"), (".pbf", "pbf"), (".json", "dump"), (".jsonl", "dump"), (".json.gz", "dump"), (".jsonl.gz", "dump")):
        if name.endswith(end):
            return kind
    raise ValueError(f"neither a .pbf nor a dump: {location}")


def default_name(location: str) -> str:
    base = location.split("?")[0].rstrip("/").rsplit("/", 1)[-1]
    return re.sub(r"(-latest)?(\.osm)?\.(pbf|jsonl?)(\.gz)?$", "", base, flags=re.I).lower() or "source"


def expand_location(location: str) -> str:
    """`geofabrik:europe/austria` is an address of its own."""
    return f"https://download.geofabrik.de/{location.removeprefix('geofabrik:')}-latest.osm.pbf" if location.startswith("geofabrik:") else location


@dataclass
class Version:
    sequence: int | None = None
    md5: str | None = None
    etag: str | None = None
    last_modified: str | None = None
    size: int | None = None
    mtime: int | None = None

    def differs(self, other: Version) -> bool:
        """By the first mark that both have: sequence, md5, etag, last_modified with size, mtime with size; unknown is changed."""
        for names in (("sequence",), ("md5",), ("etag",), ("last_modified", "size"), ("mtime", "size")):
            a, b = ([getattr(v, n) for n in names] for v in (self, other))
            if a[0] is not None and b[0] is not None:
                return a != b
        return True


def version_changed(a: Column, b: Column) -> Column:
    """The same over two struct columns."""
    one = lambda *n: F.when(a[n[0]].isNotNull() & b[n[0]].isNotNull(), ~F.array(*(a[x].cast("string") for x in n)).eqNullSafe(F.array(*(b[x].cast("string") for x in n))))
    return F.coalesce(one("sequence"), one("md5"), one("etag"), one("last_modified", "size"), one("mtime", "size"), F.lit(True))


@dataclass
class Source:
    name: str
    location: str
    format: str
    countries: list[str] = field(default_factory=list)
    partitions: list[str] = field(default_factory=list)
    version: Version = field(default_factory=Version)


class Registry:
    """sources.json of a data folder."""

    def __init__(self, folder: str):
        self.path = Path(folder, "sources.json")
        rows = json.loads(self.path.read_text()) if self.path.exists() else []
        self.sources = {r["name"]: Source(**{**r, "version": Version(**r["version"])}) for r in rows}

    def save(self) -> None:
        tmp = self.path.with_suffix(".tmp")
        tmp.write_text(json.dumps([asdict(s) for s in self.sources.values()], indent=1))
        tmp.replace(self.path)

    def upsert(self, source: Source) -> None:
        self.sources[source.name] = source
        self.save()

    def remove(self, name: str) -> bool:
        gone = self.sources.pop(name, None)
        if gone:
            self.save()
        return gone is not None


@contextmanager
def lock(folder: str):
    """One import at a time."""
    os.makedirs(folder, exist_ok=True)
    with open(Path(folder, ".lock"), "w") as f:
        try:
            fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            raise RuntimeError(f"{folder} is in use by another import") from None
        yield


def read_generation(folder: str) -> str | None:
    path = Path(folder, "GENERATION")
    return path.read_text().strip() if path.exists() else None


def bump_generation(folder: str) -> str:
    new = uuid.uuid4().hex
    tmp = Path(folder, "GENERATION.tmp")
    tmp.write_text(new)
    tmp.replace(Path(folder, "GENERATION"))
    return new


def write_partitions(places: DataFrame, folder: str, source: str) -> DataFrame:
    """Places by country, along the Z-order curve, each country's folder swapped in whole; returns their metadata.

    Rows go to files by (country, curve), so that a file covers a small box and row groups can be skipped.
    """
    tmp = f"{folder}/.new-{uuid.uuid4().hex}"
    rows = places.withColumn("country", F.lower("country_code")).withColumn("morton", geo.morton("lon", "lat")).persist()
    rows.repartitionByRange("country", "morton", "osm_type", "osm_id").sortWithinPartitions("country", "morton", "osm_type", "osm_id").write.partitionBy("country").parquet(tmp)
    done = []
    for new in sorted(Path(tmp).glob("country=*")):
        code = new.name.removeprefix("country=")
        final = Path(folder, "places", code)
        final.parent.mkdir(parents=True, exist_ok=True)
        if final.exists():
            final.rename(old := Path(folder, f".old-{uuid.uuid4().hex}"))
            new.rename(final)
            shutil.rmtree(old)
        else:
            new.rename(final)
        done.append(code)
    shutil.rmtree(tmp)
    meta = partition_meta(rows.withColumn("partition", F.col("country"))).withColumn("source", F.lit(source)).withColumn("format", F.lit(FORMAT))
    found = meta.collect()  # a row for each country
    for r in found:
        Path(folder, "places", r.partition, "_meta.json").write_text(json.dumps(r.asDict(recursive=True)))
    rows.unpersist()
    bump_generation(folder)
    return places.sparkSession.createDataFrame(found, meta.schema)


def drop_partition(folder: str, code: str) -> None:
    shutil.rmtree(Path(folder, "places", code), ignore_errors=True)


def partition_meta(places: DataFrame) -> DataFrame:
    """partition, num_places, box and a count for each layer."""
    layers = [F.sum(F.when(F.col("layer_id") == k, 1).otherwise(0)).cast("long").alias(f"n_{name}") for k, name in enumerate(LAYERS)]
    return places.groupBy("partition").agg(F.count("*").alias("num_places"), F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"), *layers)


def list_partitions(folder: str) -> list[dict]:
    return [json.loads(p.read_text()) for p in sorted(Path(folder, "places").glob("*/_meta.json"))]


def read_partitions(spark: SparkSession, folder: str, countries: list[str] | None = None) -> DataFrame:
    """Places of a data folder. A country that isn't there, an older format, or a count that differs from the metadata is an error."""
    there = {m["partition"]: m for m in list_partitions(folder)}
    wanted = [c.lower() for c in countries] if countries else list(there)
    if missing := [c for c in wanted if c not in there]:
        raise LookupError(f"countries not loaded: {', '.join(missing)}")
    for c in wanted:
        if there[c]["format"] != FORMAT:
            raise ValueError(f"partition {c} has format {there[c]['format']}, not {FORMAT}")
    rows = spark.read.option("pathGlobFilter", "*.parquet").parquet(*(str(Path(folder, "places", c)) for c in wanted))
    met = {r.c: r.n for r in rows.groupBy(F.lower("country_code").alias("c")).agg(F.count("*").alias("n")).collect()}  # a row for each country
    if wrong := [c for c in wanted if met.get(c, 0) != there[c]["num_places"]]:
        raise ValueError(f"partitions whose count differs from their metadata: {', '.join(wrong)}")
    return rows


def stale_partitions(previous: DataFrame, produced: DataFrame, others: DataFrame) -> DataFrame:
    """What a source made before and neither it nor another makes now (column partition)."""
    return previous.select("partition").exceptAll(produced.select("partition")).distinct().join(others.select("partition"), "partition", "left_anti")


def owner_rule(ours: int, theirs: int | None) -> str:
    """Who keeps a country that another source has: `own` where none has, `take` where we have ten times as much, `skip` where they have, else `split`."""
    if theirs is None:
        return "own"
    return "take" if ours >= 10 * theirs else "skip" if theirs >= 10 * ours else "split"

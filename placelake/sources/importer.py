"""Imports of files into a data folder: read, make places, write partitions, keep the registry and drop what went stale."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelake.operators import elements, ingest
from placelake.sources import dump, pbf, registry

FORMATS = ("pbf", "dump")
#: Units of durations.
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}


class ImportFailed(RuntimeError):
    """An import that made no place, or that can't be read."""


@dataclass
class Report:
    """What an import did: places by partition, partitions removed, countries asked for and not found, relations with open rings."""

    source: str
    partitions: dict[str, int]
    removed: list[str] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    broken: int = 0


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """qid, importance from a TSV file (gzipped or not) with a header that names `importance` and `wikidata_id`; other columns are left out."""
    rows = spark.read.csv(path, sep="\t", header=True, quote="")
    if lost := {"importance", "wikidata_id"} - set(rows.columns):
        raise ImportFailed(f"{path} has no column {', '.join(sorted(lost))}")
    return ingest.article_importance(rows.select("wikidata_id", "importance"))


def cached_articles(spark: SparkSession, path: str, cache: str) -> DataFrame:
    """The same from a Parquet copy in the folder `cache`, made anew where the file's size or time has changed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    status = file.getFileSystem(conf).getFileStatus(file)
    kept = f"{cache}/articles-{status.getLen()}-{status.getModificationTime()}"
    at = jvm.org.apache.hadoop.fs.Path(f"{kept}/_SUCCESS")
    if not at.getFileSystem(conf).exists(at):
        read_articles(spark, path).write.mode("overwrite").parquet(kept)
    return spark.read.parquet(kept)


def parse_duration(text: str) -> int:
    """Seconds of `90s`, `15m`, `6h`, `1d` or `2w`; a number alone counts seconds. Zero and all else are errors."""
    found = re.fullmatch(r"\s*(\d+)\s*([smhdw]?)\s*", text.lower())
    if not found or not int(found[1]):
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * SECONDS[found[2] or "s"]


def dump_places(spark: SparkSession, path: str, country: str | None = None) -> DataFrame:
    """Places of a dump, in the columns that partitions have."""
    rows = dump.places(dump.read_dump(spark, path), country)
    return rows.withColumn("place_id", F.coalesce("nominatim_id", F.xxhash64("dump_id"))).drop("seq", "addresslines")


def import_file(spark: SparkSession, path: str, folder: str, kind: str | None = None, name: str | None = None, articles: DataFrame | None = None, country: str | None = None, countries: list[str] | None = None, min_share: float = 0.0, version: registry.Version | None = None) -> Report:
    """Bring a file's places into `folder`, one import at a time; a country's partition is swapped whole, and partitions of this source that it no longer has go, unless another source has them.

    kind: pbf or dump, by the name where it isn't given. countries: those wanted; others are left out. An import without
    any place changes nothing and is an error.
    """
    kind, name = kind or registry.detect_format(path), name or registry.default_name(path)
    if kind not in FORMATS:
        raise ImportFailed(f"unknown format of {path}")
    with registry.lock(folder):
        broken, kept = 0, None
        if kind == "pbf":
            pbf.register(spark)
            made = elements.make_places(spark.read.format("osm_pbf").load(path), articles, country, min_share)
            places, broken, kept = made.places, made.broken.count(), made.kept
        else:
            places = dump_places(spark, path, country)
        places = places.where("country_code is not null")
        if countries:
            places = places.where(F.upper("country_code").isin([c.upper() for c in countries]))
        if places.isEmpty():
            raise ImportFailed(f"{path} has no place in a country")
        known = registry.Registry(folder)
        before = set(known.sources[name].partitions) if name in known.sources else set()
        written = {r.partition: r.num_places for r in registry.write_partitions(places, folder, name).collect()}  # a row for each country
        others = {p for s in known.sources.values() if s.name != name for p in s.partitions}
        stale = sorted(before - set(written) - others)
        for code in stale:
            registry.drop_partition(folder, code)
        known.upsert(registry.Source(name, os.path.abspath(path) if "://" not in path else path, kind, sorted(c.lower() for c in countries or []), sorted(written), version or registry.Version()))
        missing = sorted({c.lower() for c in countries or []} - set(written))
        if stale:
            registry.bump_generation(folder)
    return Report(name, written, stale, missing, broken)


def remove_source(folder: str, name: str) -> list[str]:
    """Forget a source; its partitions go where no other source has them."""
    with registry.lock(folder):
        known = registry.Registry(folder)
        if name not in known.sources:
            raise LookupError(f"no source {name}")
        own = set(known.sources[name].partitions)
        known.remove(name)
        gone = sorted(own - {p for s in known.sources.values() for p in s.partitions})
        for code in gone:
            registry.drop_partition(folder, code)
        registry.bump_generation(folder)
    return gone


def update_all(spark: SparkSession, folder: str, **options) -> dict[str, Report | str]:
    """Import every registered file again whose size or time has changed; one that fails leaves the others alone and is told by its message."""
    out: dict[str, Report | str] = {}
    for source in list(registry.Registry(folder).sources.values()):
        try:
            stat = os.stat(source.location)
            now = registry.Version(size=stat.st_size, mtime=int(stat.st_mtime))
            if (source.version.size, source.version.mtime) == (now.size, now.mtime):
                continue
            out[source.name] = import_file(spark, source.location, folder, source.format, source.name, countries=source.countries or None, version=now, **options)
        except Exception as e:  # noqa: BLE001  a source's failure is its own
            out[source.name] = f"{type(e).__name__}: {e}"
    return out

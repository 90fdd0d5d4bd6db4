"""Command line: imports, updates, questions and rules, each a thin call into the library."""

from __future__ import annotations

import argparse
import json
import sys
import tomllib
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from placelake.api import Engine, Search
from placelake.operators.textsearch import Rules
from placelake.sources import importer, registry

#: Sections and keys that a configuration file may have.
CONFIG = {"import": {"country", "min_share", "articles"}, "synonyms": {"dir", "languages", "everywhere", "words", "suffixes"}}


class ConfigError(ValueError):
    pass


def read_config(path: str | None) -> dict:
    """A TOML file; sections or keys that nobody knows are errors."""
    found = tomllib.loads(Path(path).read_text()) if path else {}
    for section, own in found.items():
        if section not in CONFIG:
            raise ConfigError(f"unknown section {section}")
        if unknown := set(own) - CONFIG[section]:
            raise ConfigError(f"unknown in {section}: {', '.join(sorted(unknown))}")
    return found


def rules_of(config: dict) -> Rules:
    own = config.get("synonyms", {})
    inline = {k: own[k] for k in ("words", "suffixes") if k in own}
    return Rules.load(own.get("dir"), inline, own.get("languages"), own.get("everywhere", False))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="placelake")
    top.add_argument("--data", default="data", help="data folder")
    top.add_argument("--config", help="TOML file")
    sub = top.add_subparsers(dest="command", required=True)
    add = sub.add_parser("import", help="import a file")
    add.add_argument("path")
    add.add_argument("--name")
    add.add_argument("--format", choices=importer.FORMATS)
    add.add_argument("--country", action="append", default=[])
    sub.add_parser("update", help="import files again that have changed")
    sub.add_parser("list", help="partitions")
    sub.add_parser("remove", help="forget a source").add_argument("name")
    ask = sub.add_parser("search", help="search for a text")
    ask.add_argument("q")
    ask.add_argument("--lang")
    ask.add_argument("--limit", type=int, default=10)
    near = sub.add_parser("reverse", help="what is at a point")
    near.add_argument("lon", type=float)
    near.add_argument("lat", type=float)
    words = sub.add_parser("synonyms", help="what words may stand for")
    words.add_argument("words", nargs="+")
    words.add_argument("--country", action="append")
    return top


def run(argv: list[str], spark: SparkSession) -> list[str]:
    """Lines that a command prints."""
    a = parser().parse_args(argv)
    config = read_config(a.config)
    own = config.get("import", {})
    if a.command == "import":
        articles = importer.cached_articles(spark, own["articles"], f"{a.data}/cache") if "articles" in own else None
        report = importer.import_file(spark, a.path, a.data, a.format, a.name, articles, own.get("country"), a.country or None, own.get("min_share", 0.0))
        return [f"{report.source}: {n} places in {code}" for code, n in sorted(report.partitions.items())] + [f"not found: {c}" for c in report.missing] + [f"removed: {c}" for c in report.removed]
    if a.command == "update":
        return [f"{name}: {r if isinstance(r, str) else sum(r.partitions.values())}" for name, r in importer.update_all(spark, a.data).items()]
    if a.command == "list":
        return [f"{m['partition']} {m['num_places']} {m['source']}" for m in registry.list_partitions(a.data)]
    if a.command == "remove":
        return [f"removed: {c}" for c in importer.remove_source(a.data, a.name)]
    if a.command == "synonyms":
        words = spark.createDataFrame([(w,) for w in a.words], "term string")
        return sorted(f"{r.term} -> {r.alt}" for r in rules_of(config).expand(spark, words, a.country).collect())
    engine = Engine(registry.read_partitions(spark, a.data), rules=rules_of(config))
    if a.command == "search":
        hits = engine.search(Search(q=a.q, limit=a.limit))
        return [r.collection for r in engine.present(hits, a.lang).collect()]
    one = spark.createDataFrame([(0, a.lon, a.lat)], "qid int, lon double, lat double")
    return [json.dumps(r.asDict()) for r in engine.reverse(one).join(engine.places.select("place_id", F.col("name")), "place_id").collect()]


def main() -> int:
    try:
        print("\n".join(run(sys.argv[1:], SparkSession.builder.appName("placelake").getOrCreate())))
    except (ValueError, LookupError, RuntimeError) as e:
        print(f"placelake: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

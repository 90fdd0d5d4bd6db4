"""Dump source: JSON lines `{type, content}` of a geocoder's export, gzip or not, as places, units and countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelake.functions import geo, tags, text

_PLACE = (
    "place_id string, object_type string, object_id long, osm_key string, osm_value string, address_type string, rank_address int, importance double, "
    "name map<string,string>, housenumber string, address map<string,string>, postcode string, country_code string, centroid array<double>, bbox array<double>, "
    "geometry string, addresslines array<struct<place_id:string,isaddress:boolean>>"
)
MAGIC, VERSION = "NominatimDumpFile", "0.1"


class DumpError(ValueError):
    pass


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """seq, type, content (JSON text) of each line, in file order within a file. The header must name the format."""
    lines = spark.read.schema("type string, content string").json(path).select(F.monotonically_increasing_id().alias("seq"), "type", "content")
    head = lines.where(F.col("type") == MAGIC).select(F.get_json_object("content", "$.version").alias("v")).first()
    if head is None:
        raise DumpError(f"{path} has no {MAGIC} header")
    if not (head.v or "").startswith(VERSION):
        import warnings

        warnings.warn(f"dump version {head.v}, not {VERSION}.x", stacklevel=2)
    return lines


def countries(lines: DataFrame) -> DataFrame:
    """code, name, names from CountryInfo lines."""
    info = lines.where("type = 'CountryInfo'").select(F.explode(F.from_json("content", "array<struct<country_code:string,name:map<string,string>>>")).alias("c"))
    own = text.split_names(F.col("c.name"), "name")
    return info.select(tags.country_code(F.col("c.country_code")).alias("code"), own["name"].alias("name"), own["names"].alias("names")).where("code is not null")


def places(lines: DataFrame, default_country: str | None = None) -> DataFrame:
    """Rows of Place lines; those without a valid position, element type or country are left out (count them with `skipped`)."""
    return _parsed(lines, default_country).where("ok").drop("ok")


def skipped(lines: DataFrame, default_country: str | None = None) -> int:
    return _parsed(lines, default_country).where("not ok").count()


def _parsed(lines: DataFrame, default_country: str | None) -> DataFrame:
    rows = lines.where("type = 'Place'").select("seq", F.posexplode(F.from_json("content", f"array<struct<{','.join(x.strip().replace(' ', ':', 1) for x in _PLACE.split(', '))}>>")).alias("n", "p"))
    own = text.split_names(F.col("p.name"), "name")
    layer = tags.dump_layer(F.col("p.address_type"), F.col("p.rank_address"), F.col("p.housenumber"), own["name"])
    code = F.upper(F.coalesce(tags.country_code(F.col("p.country_code")), F.lit(default_country)))
    lon, lat = F.get("p.centroid", F.lit(0)), F.get("p.centroid", F.lit(1))
    kind = F.upper(F.substring("p.object_type", 1, 1))
    base = tags.base_importance(layer)
    return rows.select(
        F.struct("seq", "n").alias("seq"), F.col("p.place_id").alias("dump_id"), kind.alias("osm_type"), F.col("p.object_id").alias("osm_id"), F.col("p.osm_key").alias("osm_key"), F.col("p.osm_value").alias("osm_value"),
        layer.alias("layer_id"), own["name"].alias("name"), own["names"].alias("names"), F.col("p.housenumber").alias("housenumber"), F.coalesce(F.element_at("p.address", "street"), F.element_at("p.address", "place")).alias("street"),
        F.col("p.postcode").alias("postcode"), F.element_at("p.address", "city").alias("city"), code.alias("country_code"), lon.alias("lon"), lat.alias("lat"),
        F.greatest(F.coalesce(F.least(F.greatest(F.col("p.importance"), F.lit(0.0)), F.lit(1.0)), base), base).alias("importance"), F.col("p.addresslines").alias("addresslines"),
        F.col("p.place_id").try_cast("long").alias("nominatim_id"), (F.coalesce(geo.valid(lon, lat) & kind.isin("N", "W", "R"), F.lit(False)) & code.isNotNull()).alias("ok"),
    )


def units(rows: DataFrame) -> DataFrame:
    """Admin units, one for each layer, name (in lower case) and country: layer_id, key, country_code, name, names, first_seq."""
    named = rows.where("layer_id >= 4 and name is not null")
    return named.groupBy("layer_id", F.lower("name").alias("key"), "country_code").agg(F.min_by("name", "seq").alias("name"), F.min_by("names", "seq").alias("names"), F.min("seq").alias("first_seq"))


def parents(rows: DataFrame) -> DataFrame:
    """dump_id, layer_id, parent: names from address lines that refer to places of an earlier line, higher layers only; and street names."""
    lines = rows.select("dump_id", "seq", F.col("layer_id").alias("own"), F.explode("addresslines").alias("a")).where("coalesce(a.isaddress, true)").select("dump_id", "seq", "own", F.col("a.place_id").alias("ref"))
    there = rows.select(F.col("dump_id").alias("ref"), F.col("seq").alias("r_seq"), "layer_id", "name")
    met = lines.join(there, "ref").where("r_seq < seq and layer_id > own and name is not null")
    return met.groupBy("dump_id", "layer_id").agg(F.min_by("name", "r_seq").alias("parent"))

"""Outputs: GeoJSON, JSON lines, request metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake.operators.ingest import cut_lineage
from placelake.schema import LAYERS

#: Upper bounds of latency buckets, in seconds.
BUCKETS = [0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]


def _coords(p: Column) -> Column:
    return F.array(F.round(p["lon"], 7), F.round(p["lat"], 7))


def geometry(full: bool, columns) -> Column:
    """GeoJSON geometry as a JSON string: lines, else polygons, else the centre; single ones as single types."""
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 7), F.round("lat", 7)).alias("coordinates")))
    if not full or "lines" not in columns:
        return point
    lines = F.transform("lines", lambda l: F.transform(l, _coords))
    line = F.when(F.size("lines") == 1, F.to_json(F.struct(F.lit("LineString").alias("type"), F.get(lines, 0).alias("coordinates")))).when(F.size("lines") > 1, F.to_json(F.struct(F.lit("MultiLineString").alias("type"), lines.alias("coordinates"))))
    if "polygons" not in columns:
        return F.coalesce(line, point)
    polys = F.transform("polygons", lambda rings: F.transform(rings, lambda r: F.transform(r, _coords)))
    poly = F.when(F.size("polygons") == 1, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(polys, 0).alias("coordinates")))).when(F.size("polygons") > 1, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), polys.alias("coordinates"))))
    return F.coalesce(line, poly, point)


def features(hits: DataFrame, full: bool = False) -> DataFrame:
    """qid, rank, feature (JSON): geometry and properties of each hit, rounded: distance 1, score 4, importance 3 decimals. Absent properties are left out."""
    layer = F.element_at(F.array(*map(F.lit, LAYERS)), F.col("layer_id") + 1)
    own = [c for c in ("name", "housenumber", "street", "postcode", "district", "city", "county", "state", "country", "osm_type", "osm_id", "osm_key", "osm_value") if c in hits.columns]
    props = [F.col(c) for c in own] + [layer.alias("type")]
    props += [F.round(c, d).alias(c) for c, d in (("distance", 1), ("score", 4), ("importance", 3)) if c in hits.columns]
    props += [F.col("country_code").alias("countrycode")] if "country_code" in hits.columns else []
    props += [F.array(F.round("lon", 7), F.round("lat", 7)).alias("center")] if full else []
    body = F.concat(F.lit('{"type":"Feature","geometry":'), geometry(full, hits.columns), F.lit(',"properties":'), F.to_json(F.struct(*props)), F.lit("}"))
    return hits.select("qid", "rank", body.alias("feature"))


def collections(features_: DataFrame) -> DataFrame:
    """qid, collection: a FeatureCollection for each request."""
    all_ = F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"])
    return features_.groupBy("qid").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(all_, ","), F.lit("]}")).alias("collection"))


def every_nth(places: DataFrame, n: int, *order: str) -> DataFrame:
    """Every n-th place in an order, from the first, by partition (column country_code).

    Rows are sorted by range, over all tasks; a row's number is its place in its task plus what the tasks before hold of its
    country. The driver sees a count for each country and task that meet.
    """
    rows = cut_lineage(places.repartitionByRange("country_code", *order).sortWithinPartitions("country_code", *order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    met = rows.groupBy("country_code", part.alias("_part")).agg(F.count("*").alias("n"), F.min("_id").alias("_low")).orderBy("_low").collect()
    before, table = {}, []
    for m in met:
        table.append((m.country_code, m._part, m._low, before.get(m.country_code, 0)))
        before[m.country_code] = before.get(m.country_code, 0) + m.n
    kind = rows.schema["country_code"].dataType.simpleString()
    offsets = F.broadcast(places.sparkSession.createDataFrame(table, f"_c {kind}, _p long, _low long, _before long"))  # countries and tasks bound it
    numbered = rows.join(offsets, F.col("country_code").eqNullSafe(F.col("_c")) & (part == F.col("_p")))
    return numbered.where((F.col("_id") - F.col("_low") + F.col("_before")) % n == 0).select(*places.columns)


def latency_histogram(requests: DataFrame) -> DataFrame:
    """endpoint, le, n: requests (endpoint, seconds) at most as slow as each bound, the last without bound."""
    bounds = F.array(*map(F.lit, [*BUCKETS, float("inf")]))
    rows = requests.select("endpoint", F.explode(bounds).alias("le"), "seconds")
    return rows.groupBy("endpoint", "le").agg(F.sum((F.col("seconds") <= F.col("le")).cast("long")).alias("n"))


def prometheus(histogram: DataFrame, name: str = "request_seconds") -> DataFrame:
    le = F.when(F.col("le") == float("inf"), "+Inf").otherwise(F.col("le").cast("string"))
    return histogram.select(F.concat(F.lit(f'{name}_bucket{{endpoint="'), "endpoint", F.lit('",le="'), le, F.lit('"} '), F.col("n").cast("string")).alias("line"))

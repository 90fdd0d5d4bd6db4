"""Spatial requests over places: radius, box, nearest, reverse, containment, lookup. Requests and places are DataFrames.

Places have place_id, lon, lat, layer_id, importance and, where lines or polygons matter, `lines` and `polygons`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelake.functions import geo
from placelake.functions.rank import Ranking, proximity
from placelake.operators.cells import area_join, near_join, nearest_reach, shape_join
from placelake.schema import HOUSE, LOCALITY, POI, STREET

REVERSE_LAYERS = (HOUSE, POI, STREET, LOCALITY)
#: Metres: segments of lines are found by their ends and points between them, this far apart at most.
PIECE = 1000.0
EVERYWHERE = 20_037_600.0  # half the Earth's girth, rounded up


def keep(places: DataFrame, layers=(), countries=(), tag: Column | None = None) -> DataFrame:
    """Layer, country and tag filters; each is left out where empty. All reach the scan."""
    if layers:
        places = places.where(F.col("layer_id").isin(list(layers)))
    if countries:
        places = places.where(F.col("country_code").isin([c.upper() for c in countries]))
    return places.where(tag) if tag is not None else places


def _ranked(hits: DataFrame, k: int, *order) -> DataFrame:
    window = W.partitionBy("qid").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


_NO_LINES = "cast(array() as array<array<struct<lon:double,lat:double>>>)"


def _lined() -> Column:
    return F.size(F.coalesce("lines", F.expr(_NO_LINES))) > 0


def _pieces(places: DataFrame) -> DataFrame:
    """place_id, a, b (a segment of its lines, or where it is found by one point alone, that point twice), k, parts (0 for a point), v_lon, v_lat.

    A segment is found by points that cut it in `parts` of PIECE at most, on a plane tangent within five degrees of it.
    """
    centre = F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat"))
    ends = lambda a, b: F.struct(a.alias("a"), b.alias("b"))

    def segments(line: Column) -> Column:
        n = F.size(line) - 1
        return F.when(n >= 1, F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: ends(a, b).withField("one", F.lit(False)))).when(n == 0, F.transform(line, lambda a: ends(a, a).withField("one", F.lit(True)))).otherwise(F.slice(F.transform(line, lambda a: ends(a, a).withField("one", F.lit(True))), 1, 0))

    own = F.flatten(F.transform("lines", segments))
    alone = F.array(ends(centre, centre).withField("one", F.lit(True)))
    cut = places.select("place_id", "lon", "lat", own.alias("own")).select("place_id", F.explode(F.when(F.size("own") > 0, F.col("own")).otherwise(alone)).alias("s"))
    cut = cut.select("place_id", F.col("s.one").alias("one"), *(F.col(f"s.{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in ("lon", "lat")))
    low = F.when(F.col("a_lat") * F.col("b_lat") < 0, F.lit(0.0)).otherwise(F.greatest(F.least(F.abs("a_lat"), F.abs("b_lat")) - 5, F.lit(0.0)))
    length = geo.DEGREE * F.sqrt(F.pow(F.col("b_lat") - F.col("a_lat"), 2) + F.pow((F.col("b_lon") - F.col("a_lon")) * F.cos(F.radians(low)), 2))
    cut = cut.withColumn("parts", F.when(F.col("one"), F.lit(0).cast("long")).otherwise(F.greatest(F.ceil(length / PIECE), F.lit(1).cast("long"))))
    cut = cut.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts"))))
    at = lambda c: F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) * F.col("k") / F.greatest(F.col("parts"), F.lit(1).cast("long"))
    return cut.drop("one").withColumns({"v_lon": at("lon"), "v_lat": at("lat")})


def within(requests: DataFrame, places: DataFrame, steps: int = 2) -> DataFrame:
    """Pairs (qid, place_id, distance) with a distance of at most the request's radius. requests: qid, lon, lat, radius; steps: see near_join()."""
    places = places.where(geo.valid("lon", "lat"))
    asked = requests.select("qid", F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), "radius")
    if "lines" not in places.columns:
        points = places.select("place_id", F.col("lon").alias("v_lon"), F.col("lat").alias("v_lat"))
        pairs = near_join(asked.withColumn("_reach", F.col("radius") * 1.01 + 1), points, "_reach", ("q_lon", "q_lat"), ("v_lon", "v_lat"), steps)
        return pairs.withColumn("distance", geo.haversine("q_lon", "q_lat", "v_lon", "v_lat")).where("distance <= radius").select("qid", "place_id", "distance")
    # metres on the plane that the distance is of, to the nearest of the points that a segment is found by, and what they may be on the sphere, where parallels widen towards the equator
    plane, cos = F.col("radius") + PIECE / 2, F.cos(F.radians("q_lat"))
    wide = F.greatest(F.cos(F.radians(F.greatest(F.abs("q_lat") - plane / geo.DEGREE, F.lit(0.0)))) / F.greatest(cos, F.lit(1e-9)), F.lit(1.0))
    asked = asked.withColumns({"q_cos": cos, "_reach": F.least(plane * 1.01 * F.sqrt(wide) + 1, F.lit(EVERYWHERE * 1.01))})
    pairs = near_join(asked, _pieces(places), "_reach", ("q_lon", "q_lat"), ("v_lon", "v_lat"), steps)
    # most fall out by their own distance; of the points of a segment the nearest alone makes a pair
    cos, metres = F.col("q_cos"), geo.DEGREE
    east, north = (F.col("v_lon") - F.col("q_lon")) * cos, F.col("v_lat") - F.col("q_lat")
    pairs = pairs.where((F.col("parts") == 0) | (east * east + north * north <= F.pow(plane * 1.001 / metres, 2)))
    # geo.segment_distance step by step, a column for each: as one expression it is more code than the JVM compiles
    keys = ["qid", "q_lon", "q_lat", "radius", "place_id"]
    pairs = pairs.select(*keys, "a_lon", "a_lat", "k", "parts", *(((F.col(f"{e}_lon") - F.col("q_lon")) * cos * metres).alias(f"{e}x") for e in "ab"), *(((F.col(f"{e}_lat") - F.col("q_lat")) * metres).alias(f"{e}y") for e in "ab"))
    pairs = pairs.withColumns({"dx": F.col("bx") - F.col("ax"), "dy": F.col("by") - F.col("ay")}).withColumn("size", F.expr("dx * dx + dy * dy"))
    pairs = pairs.withColumn("t", F.expr("case when size > 0 then greatest(0d, least(1d, -(ax * dx + ay * dy) / size)) else 0d end")).withColumns({"x": F.expr("ax + t * dx"), "y": F.expr("ay + t * dy")})
    far = F.when(F.col("parts") == 0, geo.haversine("q_lon", "q_lat", "a_lon", "a_lat")).when(F.col("k") == F.floor(F.col("t") * F.col("parts") + 0.5), F.expr("sqrt(x * x + y * y)"))
    pairs = pairs.select(*keys, far.alias("far")).select(*keys, F.explode(F.array("far")).alias("distance")).where("distance <= radius")  # exploded, so that the filter isn't moved before the steps
    return pairs.groupBy(*keys).agg(F.min("distance").alias("distance")).select("qid", "place_id", "distance")


def nearest(requests: DataFrame, places: DataFrame, k: int = 5, most: float | None = None) -> DataFrame:
    """Exactly the k nearest places of each request (qid, lon, lat): qid, place_id, distance, rank; `most` caps the distance.

    Places are counted by cells; each request is given a radius within which k of them lie for sure, small where they are
    dense, and one radius join answers all. Ties go to the smaller place_id.
    """
    one = F.when(_lined(), F.struct(F.col("lines")[0][0]["lon"].alias("lon"), F.col("lines")[0][0]["lat"].alias("lat"))).otherwise(F.struct("lon", "lat")) if "lines" in places.columns else F.struct("lon", "lat")
    counted = places.where(geo.valid("lon", "lat")).select(one.alias("c")).select(F.col("c.lon").alias("c_lon"), F.col("c.lat").alias("c_lat"))
    asked = nearest_reach(requests.select("qid", "lon", "lat"), counted, k, ("lon", "lat"), ("c_lon", "c_lat"), min(most or EVERYWHERE, EVERYWHERE))
    return _ranked(within(asked.withColumnRenamed("_radius", "radius"), places, 1), k, "distance", "place_id")


def reverse(requests: DataFrame, places: DataFrame, radius: float = 1000.0, limit: int = 1, layers=REVERSE_LAYERS) -> DataFrame:
    """The nearest places of address layers within a radius: qid, place_id, distance, rank. No request looks further than `limit` of them lie for sure."""
    return nearest(requests, keep(places, layers), limit, float(radius))


def in_box(requests: DataFrame, places: DataFrame) -> DataFrame:
    """Pairs (qid, place_id) of places whose centre or lines' box meets the request's box (struct column `box`); polygons play no part.

    A place with lines is found by its box's middle, by a request grown by half a side of the place's size class: a power
    of two, so that long lines make requests grow for long lines alone.
    """
    points = places.where(geo.valid("lon", "lat"))
    if "lines" not in places.columns:
        return area_join(points.select("place_id", "lon", "lat"), requests.select("qid", "box"), ("lon", "lat"), "box").select("qid", "place_id")
    own = F.when(_lined(), geo.box_union(geo.box_of_points(F.flatten("lines")), geo.bbox("lon", "lat", "lon", "lat"))).otherwise(geo.bbox("lon", "lat", "lon", "lat"))
    side = F.greatest(F.expr("p_box.max_lon - p_box.min_lon"), F.expr("p_box.max_lat - p_box.min_lat"))
    boxed = points.select("place_id", own.alias("p_box")).withColumn("class", F.when(side <= 0, SMALLEST_CLASS).otherwise(F.greatest(F.ceil(F.log2(side)), F.lit(SMALLEST_CLASS))).cast("int"))
    boxed = boxed.withColumn("c", geo.box_center(F.col("p_box"))).select("place_id", "p_box", "class", F.col("c.lon").alias("lon"), F.col("c.lat").alias("lat"))
    classes = [r[0] for r in boxed.select("class").distinct().collect()]  # a few dozen at most
    grown = requests.select("qid", "box", F.explode(F.array(*map(F.lit, classes)) if classes else F.expr("cast(array() as array<int>)")).alias("class"))
    half = F.when(F.col("class") == SMALLEST_CLASS, F.lit(2.0**SMALLEST_CLASS)).otherwise(F.pow(F.lit(2.0), F.col("class"))) / 2 + 1e-9
    grown = grown.withColumn("grown", geo.bbox(F.col("box.min_lon") - half, F.col("box.min_lat") - half, F.col("box.max_lon") + half, F.col("box.max_lat") + half))
    return area_join(boxed, grown, ("lon", "lat"), "grown", on=("class",), parts=4).where(geo.boxes_intersect(F.col("box"), F.col("p_box"))).select("qid", "place_id")


#: Size classes of boxes begin at 2 to this power, in degrees.
SMALLEST_CLASS = -12


def spatial_only(hits: DataFrame, places: DataFrame, limit: int, with_focus: bool = True, r: Ranking = Ranking()) -> DataFrame:
    """Rank candidates (qid, place_id, distance) without text: by nearness with a breath of importance, or by importance alone."""
    own = hits.join(places.select("place_id", "importance"), "place_id")
    score = proximity(F.col("distance"), r) * (1 + F.col("importance") * 1e-3) if with_focus else F.col("importance")
    return _ranked(own.withColumn("score", score), limit, F.desc("score"), "place_id")


def best_near(requests: DataFrame, places: DataFrame, limit: int, digits: int, r: Ranking = Ranking()) -> DataFrame:
    """spatial_only() of all places (place_id, lon, lat, importance of 0 to 1) within each request's radius, scores rounded: qid, place_id, score, rank.

    The `limit` nearest places, whatever their importance, set the score that counts at least. Even the most important
    place can't reach it from further than a distance that follows; only up to there, or the radius, places are looked at.
    """
    own = places.select("place_id", "lon", "lat", "importance")
    k_th = nearest(requests, own.select("place_id", "lon", "lat"), limit).where(F.col("rank") == limit).select("qid", F.col("distance").alias("k_th"))
    bias, scale = min(1.0, max(0.0, r.location_bias)), max(1.0, r.location_bias_scale_km * 1000)
    least = (1.0 - bias) + bias * F.exp(-F.col("k_th") / scale) - 2 * 10.0**-digits
    over = (least / (1 + 1e-3) - (1.0 - bias)) / (bias or 1.0)  # what is left there of the part that falls with distance
    far = F.when((F.col("k_th") <= F.col("radius")) & (over > 0), -scale * F.log(over) * 1.000001 + 1)
    asked = requests.join(k_th.hint("merge"), "qid", "left").withColumn("radius", F.least(F.coalesce(far, F.col("radius")), F.col("radius"))).drop("k_th")
    hits = within(asked, own.select(F.struct("place_id", "importance").alias("place_id"), "lon", "lat"))  # importance goes along
    scored = hits.select("qid", "place_id.place_id", F.round(proximity(F.col("distance"), r) * (1 + F.col("place_id.importance") * 1e-3), digits).alias("score"))
    return _ranked(scored, limit, F.desc("score"), "place_id")


def containing(requests: DataFrame, places: DataFrame, layers=(), least_layer: int = LOCALITY) -> DataFrame:
    """Areas that hold each request point (qid, lon, lat), most specific first: qid, place_id, rank.

    places: place_id, layer_id, extent, polygons. Even-odd, so that holes are outside. Order: layer, size of extent, id.
    """
    areas = keep(places.where(F.col("layer_id") >= least_layer), layers).where("size(polygons) > 0").select("place_id", "layer_id", "extent", "polygons")
    asked = requests.select("qid", F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"))
    found = shape_join(asked, areas, ("q_lon", "q_lat"), "extent", "polygons", geo.polygons_contain)
    size = F.expr("(extent.max_lon - extent.min_lon) * (extent.max_lat - extent.min_lat)")
    window = W.partitionBy("qid").orderBy("layer_id", size, "place_id")
    return found.select("qid", "place_id", "layer_id", F.row_number().over(window).alias("rank"))


def lookup(refs: DataFrame, places: DataFrame) -> DataFrame:
    """Places by reference (qid, pos, kind, number), in order of pos; own ids or merged ones, P for place ids of a dump; unknown ones are skipped."""
    own = places.select("place_id", F.col("osm_type").alias("kind"), F.explode(F.array_distinct(F.concat(F.array("osm_id"), F.coalesce("merged_ids", F.expr("cast(array() as array<bigint>)"))))).alias("number"))
    dump = places.where("nominatim_id is not null").select("place_id", F.lit("P").alias("kind"), F.col("nominatim_id").alias("number"))
    hit = refs.join(own.unionByName(dump), ["kind", "number"]).groupBy("qid", "pos").agg(F.min("place_id").alias("place_id"))
    return hit.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy("pos")))


def unique_places(hits: DataFrame, limit: int) -> DataFrame:
    """The best of rows of one element (osm_type, osm_id) for each qid, then the first `limit` by rank."""
    best = hits.withColumn("_n", F.row_number().over(W.partitionBy("qid", "osm_type", "osm_id").orderBy("rank"))).where("_n = 1").drop("_n")
    return _ranked(best.withColumnRenamed("rank", "_rank"), limit, "_rank").drop("_rank")


def drop_near_duplicates(hits: DataFrame, limit: int, metres: float = 1000.0) -> DataFrame:
    """Keep, from best to worst, what isn't the same element as, or of the same layer, name and house number within `metres` of, one kept before.

    hits: qid, rank, osm_type, osm_id, layer_id, name, housenumber, lon, lat. Order matters, so each request's list (a
    page of results, whose length the search bounds) is folded as one array.
    """
    row = F.struct("rank", "osm_type", "osm_id", "layer_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("housenumber", F.lit("")).alias("hn"), "lon", "lat", "place_id")
    lists = hits.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("rows"))

    def step(acc: Column, x: Column) -> Column:
        same = F.exists(acc, lambda y: ((y["osm_type"] == x["osm_type"]) & (y["osm_id"] == x["osm_id"])) | (
            (y["layer_id"] == x["layer_id"]) & (y["name"] == x["name"]) & (y["hn"] == x["hn"]) & (geo.haversine(x["lon"], x["lat"], y["lon"], y["lat"]) <= metres)))
        return F.when(same, acc).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate("rows", F.slice("rows", 1, 0), step)
    return lists.select("qid", F.posexplode(F.slice(kept, 1, limit)).alias("pos", "r")).select("qid", F.col("r.place_id").alias("place_id"), (F.col("pos") + 1).alias("rank"))

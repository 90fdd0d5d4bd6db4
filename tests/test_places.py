import math
import random

import pytest
from pyspark.sql import functions as F

from placelake.api import Engine, InvalidRequest, Search
from placelake.functions import geo, rank, tags, text
from placelake.operators import ingest, spatial
from placelake.operators.textsearch import Rules, TextIndex
from placelake.schema import PLACE

R = 6_371_008.8


def hav(a, b):
    (x1, y1), (x2, y2) = a, b
    h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def town(spark):
    """A town of a few named places, one with a line, one with an area."""
    base = dict.fromkeys([c.strip().split(" ")[0] for c in PLACE.replace("map<string,string>", "m").replace("struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>", "s").split(", ")])

    def row(i, kind, num, layer, name, lon, lat, **more):
        own = base | {"place_id": i, "osm_type": kind, "osm_id": num, "osm_key": "amenity", "osm_value": "cafe", "layer_id": layer, "name": name, "country_code": "LI", "lon": lon, "lat": lat, "importance": [0.1, 0.2, 0.25, 0.3, 0.4, 0.55][layer], "names": {}, "alt_names": [], "parents": [], "lines": [], "polygons": [], "merged_ids": []}
        return own | more

    square = [[{"lon": 9.529, "lat": 47.129}, {"lon": 9.531, "lat": 47.129}, {"lon": 9.531, "lat": 47.131}, {"lon": 9.529, "lat": 47.129}]]
    rows = [
        row(1, "N", 1, 5, "Vaduz", 9.5209, 47.1410), row(2, "N", 2, 1, "Café Vaduz", 9.5215, 47.1405), row(3, "N", 3, 1, "Kunstmuseum", 9.5225, 47.1395), row(4, "N", 4, 5, "Schaan", 9.5095, 47.1650),
        row(5, "W", 5, 2, "Landstrasse", 9.55, 47.10, lines=[[{"lon": 9.50, "lat": 47.10}, {"lon": 9.60, "lat": 47.10}]], merged_ids=[77]), row(6, "W", 6, 1, "Hauptstrasse Park", 9.53, 47.13, polygons=[square]),
        row(7, "N", 7, 1, "Raiffeisenbank", 9.54, 47.15), row(8, "N", 8, 1, "Кафе Москва", 9.56, 47.16),
    ]
    return spark.createDataFrame(rows, PLACE).cache()


def ask(spark, q, **more):
    one = {"qid": 1, "q": q, "limit": 5, "autocomplete": True, "lon": None, "lat": None} | more
    return spark.createDataFrame([one], "qid int, q string, limit int, autocomplete boolean, lon double, lat double")


def names(hits, town):
    return [r.name for r in hits.join(town.select("place_id", "name"), "place_id").orderBy("rank").collect()]


def test_text_search(spark, town):
    index = TextIndex(town, rules=Rules(suffixes=[(None, "str", ["strasse"])]))
    asked = [(1, "vad", True), (2, "kunstmusem", False), (3, "kunstmusuem", False), (4, "hauptstr. park ", True), (5, "kafe moskva", True), (6, "?!", True)]
    q = spark.createDataFrame([(k, t, 5, auto, None, None) for k, t, auto in asked], "qid int, q string, limit int, autocomplete boolean, lon double, lat double")
    hits = index.search(q).join(town.select("place_id", "name"), "place_id").where("rank = 1").collect()
    assert {r.qid: r.name for r in hits} == {1: "Vaduz", 2: "Kunstmuseum", 3: "Kunstmuseum", 4: "Hauptstrasse Park", 5: "Кафе Москва"}


def test_engine(spark, town):
    engine = Engine(town)
    q = spark.createDataFrame([(1, 9.55, 47.1009)], "qid int, lon double, lat double")
    hit = engine.reverse(q, radius=200.0, layers=["street"]).first()
    assert hit.place_id == 5 and abs(hit.distance - 100) < 1
    assert [r.place_id for r in engine.lookup(["W77", "N1", "N999999", "W5"]).orderBy("rank").collect()] == [5, 1, 5]
    assert names(engine.search(Search(lon=9.5209, lat=47.1410, radius=200.0, layers=["city"])), town) == ["Vaduz"]
    for bad in (Search(), Search(q="x", lon=1.0), Search(q="x", radius=5.0), Search(q="x", limit=0), Search(lon=200.0, lat=0.0)):
        with pytest.raises(InvalidRequest):
            bad.validate()


def test_nearest_is_brute_force_also_over_the_date_line(spark):
    rng = random.Random(7)
    at = [(k, rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(88, 90)])) for k in range(400)]
    asked = [(k, rng.choice([179.9, -179.95, rng.uniform(-180, 180)]), rng.uniform(-89.9, 89.9)) for k in range(25)]
    p, q = spark.createDataFrame(at, "place_id long, lon double, lat double"), spark.createDataFrame(asked, "qid long, lon double, lat double")
    got = {}
    for r in spatial.nearest(q, p, 4).collect():
        got.setdefault(r.qid, {})[r["rank"]] = r.place_id
    for k, x, y in asked:
        want = sorted((hav((x, y), (a, b)), i) for i, a, b in at)[:4]
        assert [got[k][n] for n in range(1, 5)] == [i for _, i in want]


def test_polygons(spark):
    big = [[(0, 40), (10, 40), (10, 50), (0, 50), (0, 40)], [(4, 44), (5, 44), (5, 45), (4, 45), (4, 44)]]
    rings = F.array(*(F.array(*(F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in r)) for r in big))
    d = spark.createDataFrame([(2.0, 42.0), (4.5, 44.5), (15.0, 55.0), (0.0, 45.0), (4.0, 44.5)], "lon double, lat double")
    got = d.select(geo.polygon_contains("lon", "lat", rings).alias("c"), geo.polygon_covers("lon", "lat", rings).alias("e"), ingest.interior_point(rings).alias("p")).collect()
    assert [r.c for r in got][:3] == [True, False, False]
    assert [r.e for r in got] == [True, False, False, True, True]
    assert 0 < got[0].p.lon < 10 and 40 < got[0].p.lat < 50


def test_text_functions(spark):
    d = spark.createDataFrame([("Städtle-Straße 35a",)], "s string")
    assert d.select(text.tokens(F.col("s"))).first()[0] == ["stadtle", "strasse", "35a"]
    words = spark.createDataFrame([(["stadtle", "35", "ab"],)], "w array<string>")
    assert words.select(text.edge_ngrams(F.col("w"))).first()[0] == "3 35 a ab s st sta stad stadt stadtl stadtle".split()
    f = spark.createDataFrame([("35",), ("rue",), ("vaduz",), ("liechtenstein",)], "t string")
    assert [r[0] for r in f.select(text.fuzzy_distance(F.col("t"))).collect()] == [0, 0, 1, 2]
    m = lambda q, n, p: spark.range(1).select(rank.name_match(F.array(*map(F.lit, q)), F.array(*map(F.lit, n)), F.lit(p))).first()[0]
    assert [m(["a", "b"], ["a", "b"], False), m(["a", "b"], ["a", "bc"], True), m(["a"], ["a", "b"], False), m(["x"], ["a"], True)] == [1.6, 1.425, 1.25, 1.0]
    e = lambda q, n, c: spark.range(1).select(rank.city_echo(F.array(*map(F.lit, q)), F.array(*map(F.lit, n)), F.array(*map(F.lit, c)), F.lit(False))).first()[0]
    assert [e(["long", "st", "cape", "town"], ["the", "westin", "cape", "town"], ["cape", "town"]), e(["cape", "town"], ["westin", "cape", "town"], ["cape", "town"])] == [0.5, 1.0]


def test_rings_and_simplify():
    assert ingest.join_rings([[1, 2, 3], [5, 4, 3], [5, 6, 1]]) == ([[1, 2, 3, 4, 5, 6, 1]], 0)
    assert ingest.join_rings([[1, 2, 3], [3, 4]]) == ([], 1)
    line = [(x / 10, math.sin(x / 10)) for x in range(100)]
    short = ingest.simplify(line, 0.05)
    assert short[0] == line[0] and short[-1] == line[-1] and len(short) < 40


def test_interpolation(spark):
    pts = [{"lon": 0.0, "lat": 0.0}, {"lon": 0.001, "lat": 0.0}, {"lon": 0.002, "lat": 0.0}]
    lines = spark.createDataFrame([(1, "odd", [1, 2, 3], pts), (2, "even", [1, 2, 3], pts)], "way_id long, kind string, refs array<long>, points array<struct<lon:double,lat:double>>")
    houses = spark.createDataFrame([(1, "1", "A", None, None), (3, "9", "A", None, None)], "node_id long, housenumber string, street string, postcode string, city string")
    got = {(r.way_id, r.number): r.lon for r in ingest.interpolated_houses(lines, houses).collect()}
    assert sorted(got) == [(1, 3), (1, 5), (1, 7)] and abs(got[1, 5] - 0.001) < 1e-9


def test_street_merge(spark):
    line = lambda x: [[{"lon": x, "lat": 1.0}, {"lon": x + 0.001, "lat": 1.0}]]
    rows = [(1, 11, "k", "Städtle", 0.2, None, [], line(0.0)), (2, 12, "k", "Städtle", 0.3, "9490", ["b"], line(0.0015)), (3, 13, "k", "Städtle", 0.2, None, [], line(1.0)), (4, 14, "z", "Aeulestrasse", 0.2, None, [], line(0.0))]
    s = spark.createDataFrame(rows, "place_id long, osm_id long, key string, name string, importance double, postcode string, alt_names array<string>, lines array<array<struct<lon:double,lat:double>>>")
    got = {r.place_id: r for r in ingest.merge_streets(s).collect()}
    assert sorted(got) == [2, 3, 4] and got[2].merged_ids == [11] and len(got[2].lines) == 2

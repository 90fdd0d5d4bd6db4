import gzip

import pytest
from pyspark.sql import functions as F

from placelake.api import Engine
from placelake.operators import elements
from placelake.sources import importer, pbf, registry


def N(i, lon, lat, **tags):
    return ("N", i, round(lon * 1e7), round(lat * 1e7), None, None, {k.replace("__", ":"): v for k, v in tags.items()})


def W(i, refs, **tags):
    return ("W", i, None, None, refs, None, {k.replace("__", ":"): v for k, v in tags.items()})


def R(i, members, **tags):
    return ("R", i, None, None, None, members, {k.replace("__", ":"): v for k, v in tags.items()})


def square(first, x, y, w):
    return [N(first, x, y), N(first + 1, x + w, y), N(first + 2, x + w, y + w), N(first + 3, x, y + w)]


@pytest.fixture(scope="module")
def land(spark):
    """A country of one city with a suburb's node, two segments of a street, a park with a hole, a house line and a postal area."""
    rows = [
        *square(100, 10.0, 50.0, 1.0), *square(110, 10.2, 50.2, 0.4), *square(120, 10.3, 50.3, 0.02), *square(130, 10.305, 50.305, 0.005), *square(140, 10.2, 50.2, 0.2),
        W(1, [100, 101, 102]), W(2, [100, 103, 102]), W(3, [110, 111, 112, 113, 110]), W(4, [120, 121, 122, 123, 120]), W(5, [130, 131, 132, 133, 130]), W(6, [140, 141, 142, 143, 140]),
        R(1, [("W", 1, "outer"), ("W", 2, "outer")], **{"type": "boundary", "boundary": "administrative", "admin_level": "2", "name": "Landia", "ISO3166-1": "LX"}),
        R(2, [("W", 3, "outer"), ("N", 200, "label")], type="boundary", boundary="administrative", admin_level="8", name="Mitte"),
        R(3, [("W", 4, "outer"), ("W", 5, "inner")], type="multipolygon", leisure="park", name="Ring Park"), R(4, [("W", 6, "outer")], type="boundary", boundary="postal_code", postal_code="1234"),
        R(5, [("W", 1, "outer")], type="multipolygon", leisure="park", name="Open Park"), R(6, [("W", 99, "outer")], type="multipolygon", leisure="park", name="Lost Park"), R(7, [("W", 4, "outer")], type="route", name="No Place"),
        N(200, 10.4, 50.4, place="city", name="Mitte", population="12000", wikidata="Q7"), N(201, 10.42, 50.42, place="suburb", name="Oberdorf"), N(202, 10.421, 50.421, amenity="cafe", name="Café Eins", wikidata="Q64;Q1"),
        N(203, 10.25, 50.25, amenity="bank", name="Bank"), N(204, 10.0, 0.0, amenity="cafe", name="Elsewhere", addr__country="zz"), N(205, 10.5, 50.5, amenity="cafe"),
        N(300, 10.41, 50.41), N(301, 10.415, 50.41), N(302, 10.42, 50.41), N(303, 10.43, 50.41),
        W(10, [300, 301], highway="residential", name="Lange Gasse"), W(11, [301, 302, 303], highway="residential", name="Lange Gasse"), W(12, [303, 300], highway="residential"),
        N(400, 10.44, 50.44, addr__housenumber="2", addr__street="Lange Gasse"), N(401, 10.45, 50.44, addr__housenumber="10", addr__street="Lange Gasse"), W(13, [400, 401], addr__interpolation="even"),
        W(14, [120, 121, 122, 120], building="church", name="Dom"),
    ]
    return spark.createDataFrame(rows, pbf.SCHEMA).cache()


@pytest.fixture(scope="module")
def made(spark, land):
    articles = spark.createDataFrame([(64, 0.8), (7, 0.5)], "qid long, importance double")
    return elements.make_places(land, articles)


def test_places_of_elements(made):
    got = {(r.osm_type, r.osm_id, r.housenumber): r for r in made.places.collect()}
    names = {(k[0], k[1]): r.name for k, r in got.items() if r.name}
    assert names == {("R", 1): "Landia", ("N", 200): "Mitte", ("N", 201): "Oberdorf", ("N", 202): "Café Eins", ("N", 203): "Bank", ("N", 204): "Elsewhere", ("R", 3): "Ring Park", ("W", 11): "Lange Gasse", ("W", 14): "Dom"}
    assert {k[2] for k in got if k[0] == "W" and k[1] == 13} == {"4", "6", "8"} and got["W", 13, "6"].lon == pytest.approx(10.445) and got["W", 13, "6"].country_code == "LX"
    street = got["W", 11, None]  # the longer segment names it
    assert street.merged_ids == [10] and len(street.lines) == 2
    assert len(got["R", 3, None].polygons[0]) == 2 and len(got["W", 14, None].polygons) == 1 and got["W", 14, None].lines == []
    assert got["N", 202, None].importance == pytest.approx(0.2 + 0.35 * 0.8) and got["N", 203, None].importance == pytest.approx(0.2)
    assert {r.rel_id for r in made.broken.collect()} == {5}


def test_hierarchy_of_elements(made):
    units = {r.unit_id: r.name for r in made.units.collect()}
    got = {(r.osm_type, r.osm_id): r for r in made.places.where("housenumber is null").collect()}
    held = {k: [units[u] for u in r.parents] for k, r in got.items()}
    assert held["N", 202] == ["Oberdorf", "Mitte", "Landia"] and held["N", 203] == ["Mitte", "Landia"] and held["N", 200] == ["Landia"] and held["N", 204] == []
    assert got["N", 203].postcode == "1234" and got["N", 202].postcode is None
    assert got["N", 202].country_code == "LX" and got["N", 204].country_code == "ZZ"
    assert {r.code: r.kept for r in made.kept.collect()} == {"lx": True, "zz": True}
    assert elements.missing_countries(made.kept, ["LX", "de"]) == ["de"]


def test_import_of_a_file(spark, land, tmp_path):
    path, folder = str(tmp_path / "land.osm.pbf"), str(tmp_path / "data")
    pbf.write_pbf(land, path)
    report = importer.import_file(spark, path, folder)
    assert report.source == "land" and report.partitions.keys() == {"lx", "zz"} and report.broken == 1 and report.removed == []
    places = registry.read_partitions(spark, folder, ["lx"])
    hit = Engine(places).nearest(spark.createDataFrame([(1, 10.4211, 50.4211)], "qid int, lon double, lat double"), limit=1).join(places, "place_id").first()
    assert hit.name == "Café Eins"
    inside = Engine(places).contains(spark.createDataFrame([(1, 10.301, 50.301)], "qid int, lon double, lat double")).count()
    assert inside == 1  # the country; the city's node stands for its boundary
    before, known = registry.read_generation(folder), registry.Registry(folder)
    known.sources["land"].countries = ["lx", "de"]
    known.save()
    again = importer.update_all(spark, folder)["land"]
    assert again.removed == ["zz"] and again.missing == ["de"] and registry.Registry(folder).sources["land"].partitions == ["lx"]
    assert importer.update_all(spark, folder) == {} and registry.read_generation(folder) != before
    assert importer.remove_source(folder, "land") == ["lx"] and registry.list_partitions(folder) == []
    with pytest.raises(LookupError):
        importer.remove_source(folder, "land")


def test_articles(spark, tmp_path):
    path = tmp_path / "a.tsv.gz"
    path.write_bytes(gzip.compress(b"language\timportance\twikidata_id\nen\t0.5\tQ1;Q2\nde\t0.7\tQ1\nen\t7\tQ3\nen\tx\tQ4\nen\t0.1\t\n"))
    want = {1: 0.7, 3: 1.0}
    for _ in range(2):
        assert {r.qid: r.importance for r in importer.cached_articles(spark, str(path), str(tmp_path / "cache")).collect()} == want
    (tmp_path / "b.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(importer.ImportFailed):
        importer.read_articles(spark, str(tmp_path / "b.tsv"))


def test_durations():
    assert [importer.parse_duration(t) for t in ("90s", "15m", " 6H ", "1d", "2w", "30")] == [90, 900, 21_600, 86_400, 1_209_600, 30]
    for bad in ("", "0m", "5y", "-3s", "1.5h"):
        with pytest.raises(ValueError):
            importer.parse_duration(bad)


def test_chains_grow_at_both_ends():
    from placelake.operators.ingest import join_rings

    assert join_rings([[1, 2, 3], [3, 4]])[1] == join_rings([[3, 4], [1, 2, 3]])[1] == 1
    assert join_rings([[5, 6], [1, 2], [6, 7, 1], [5, 4, 2]]) == ([[5, 6, 7, 1, 2, 4, 5]], 0)
    assert join_rings([[1, 2], [3, 4], [9], []]) == ([], 2)


def test_lines_of_any_length(spark):
    from placelake.operators import spatial

    ferry = [[{"lon": -20.0, "lat": 40.0}, {"lon": 20.0, "lat": 40.0}]]
    p = spark.createDataFrame([(1, -20.0, 40.0, ferry), (2, 0.0, 41.0, []), (3, 179.99, 0.0, [])], "place_id long, lon double, lat double, lines array<array<struct<lon:double,lat:double>>>")
    q = spark.createDataFrame([(1, 0.0, 40.004), (2, 0.0, 40.6), (3, -179.99, 0.001)], "qid int, lon double, lat double")
    near = {(r.qid, r.place_id) for r in spatial.within(q.withColumn("radius", F.lit(1000.0)), p).collect()}
    assert near == {(1, 1)}
    first = {r.qid: r.place_id for r in spatial.nearest(q, p, 1).collect()}
    assert first == {1: 1, 2: 2, 3: 3}
    box = spark.createDataFrame([(1, (5.0, 39.9, 5.1, 40.1)), (2, (5.0, 40.1, 5.1, 40.2)), (3, (-0.1, 40.9, 0.1, 41.1))], "qid int, box struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>")
    assert {(r.qid, r.place_id) for r in spatial.in_box(box, p).collect()} == {(1, 1), (3, 2)}


def test_double_swaps(spark):
    from placelake.functions import text

    words = spark.createDataFrame([("abcdefgh", "badcefgh"), ("abcdefgh", "badcfegh"), ("kunstmuseum", "knustmusuem"), ("abc", "bca"), ("abcd", "dcba"), ("same", "same")], "a string, b string")
    assert [r[0] for r in words.select(text.osa_distance(F.col("a"), F.col("b"))).collect()] == [2, None, 2, 2, None, 0]

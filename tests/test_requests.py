import json

import pytest

from placelake import __main__ as cli
from placelake.api import CountryNotLoaded, Engine, InvalidRequest
from placelake.functions import text
from placelake.operators import ingest
from placelake.operators.textsearch import Rules
from placelake.sources import outputs

PLACE = "place_id long, osm_type string, osm_id long, osm_key string, osm_value string, layer_id int, name string, names map<string,string>, country_code string, lon double, lat double, importance double, parents array<long>, extent struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>, polygons array<array<array<struct<lon:double,lat:double>>>>"


@pytest.fixture(scope="module")
def engine(spark):
    square = [[{"lon": 0.0, "lat": 0.0}, {"lon": 2.0, "lat": 0.0}, {"lon": 2.0, "lat": 2.0}, {"lon": 0.0, "lat": 2.0}, {"lon": 0.0, "lat": 0.0}]]
    box = (0.0, 0.0, 2.0, 2.0)
    rows = [(1, "N", 1, "shop", "bakery", 1, "Back", {"fr": "Four"}, "DE", 1.0, 1.0, 0.2, [5], None, []), (2, "N", 2, "shop", "cafe", 1, "Kaffee", {}, "AT", 1.001, 1.0, 0.2, [], None, []), (3, "N", 3, "shop", "bakery", 1, "Brot", {}, "AT", 1.002, 1.0, 0.2, [], None, []),
            (5, "R", 5, "boundary", "administrative", 5, "Ort", {"fr": "Lieu"}, "DE", 1.0, 1.0, 0.5, [], box, [square]), (6, "R", 6, "place", "suburb", 4, "Teil", {}, "AT", 1.0, 1.0, 0.4, [], box, [square])]
    return Engine(spark.createDataFrame(rows, PLACE).cache())


def test_filters_on_every_request(spark, engine):
    q = spark.createDataFrame([(7, 1.0, 1.0)], "qid int, lon double, lat double")
    ids = lambda hits: [r.place_id for r in hits.orderBy("rank").collect()]
    assert ids(engine.nearest(q, layers=["poi"])) == [1, 2, 3] and ids(engine.nearest(q, layers=["poi"], countries=["at"])) == [2, 3] and ids(engine.nearest(q, layers=["poi"], osm_tag=["shop:bakery"])) == [1, 3]
    assert ids(engine.reverse(q, countries=["AT"])) == [2] and ids(engine.reverse(q, limit=5, osm_tag=["!shop:bakery"])) == [2]
    assert ids(engine.contains(q)) == [6, 5] and ids(engine.contains(q, countries=["de"])) == [5] and ids(engine.contains(q, osm_tag=["place"])) == [6]
    for bad in (lambda: engine.nearest(q, limit=0), lambda: engine.reverse(q, radius=1e9), lambda: engine.contains(q, layers=["poi"])):
        with pytest.raises(InvalidRequest):
            bad()
    with pytest.raises(CountryNotLoaded):
        engine.nearest(q, countries=["fr"])


def test_answers_in_a_language(spark, engine):
    q = spark.createDataFrame([(7, 1.0, 1.0)], "qid int, lon double, lat double")
    units = spark.createDataFrame([(5, 5, "Ort", {"fr": "Lieu"}, "DE")], "unit_id long, layer_id int, name string, names map<string,string>, country_code string")
    found = json.loads(engine.present(engine.nearest(q, limit=2, layers=["poi"]), "fr", units=units).first().collection)
    assert [(f["properties"]["name"], f["properties"].get("city")) for f in found["features"]] == [("Four", "Lieu"), ("Kaffee", None)]


def test_rule_files(spark, tmp_path):
    (tmp_path / "de.toml").write_text('countries = ["DE"]\n[words]\n"St." = ["Sankt"]\nhbf = ["Haupt Bahnhof"]\n[suffixes]\n"Str" = ["straße"]\n')
    (tmp_path / "en.toml").write_text('[words]\nst = ["street", "saint"]\n')
    words = spark.createDataFrame([("st",), ("hbf",), ("hauptstr",), ("xstr",)], "term string")
    got = lambda r, *cc: {(x.term, x.alt) for x in r.expand(spark, words, list(cc) or None).collect()}
    both = Rules.load(str(tmp_path))
    english = {("st", "street"), ("st", "saint")}
    assert got(both, "fr") == english and got(both, "de") == english | {("st", "sankt"), ("hbf", "haupt bahnhof"), ("hauptstr", "hauptstrasse")}
    assert got(Rules.load(str(tmp_path), languages=["en"]), "de") == english and ("st", "sankt") in got(Rules.load(str(tmp_path), everywhere=True), "fr")
    assert got(Rules.load(inline={"words": {"st": ["stadt"]}})) == {("st", "stadt")}
    for bad in ({"words": {"a b": ["c"]}}, {"suffixes": {"a": ["b c"]}}, {"words": {"a": "b"}}, {"other": {}}):
        with pytest.raises(ValueError):
            Rules.load(inline=bad)
    assert text.plain_tokens("Große Æ-Łódź_2") == ["grosse", "ae", "lodz", "2"]


def test_command_line(spark, tmp_path):
    config = tmp_path / "c.toml"
    config.write_text('[synonyms.words]\nst = ["street"]\n')
    assert cli.run(["--config", str(config), "synonyms", "st", "x"], spark) == ["st -> street"]
    config.write_text("[import]\nmin_shares = 1\n")
    with pytest.raises(cli.ConfigError):
        cli.run(["--config", str(config), "list"], spark)
    assert cli.run(["--data", str(tmp_path), "list"], spark) == []


def test_streets_of_any_size(spark):
    line = lambda x1, y1, x2, y2: [[{"lon": x1, "lat": y1}, {"lon": x2, "lat": y2}]]
    rows = [(1, "a", line(0.0, 0.0, 10.0, 10.0)), (2, "a", line(5.0, 5.0, 5.001, 5.001)), (3, "a", line(20.0, 0.0, 20.001, 0.0)), (4, "b", line(5.0, 5.0, 5.001, 5.001)), (5, "a", line(20.0015, 0.0, 20.002, 0.0))]
    got = ingest.street_links(spark.createDataFrame(rows, "place_id long, key string, lines array<array<struct<lon:double,lat:double>>>"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (3, 5)]


def test_every_nth_of_each_country(spark):
    rows = [(k, "LI" if k % 3 else None, k * 7 % 1000) for k in range(1000)]
    d = spark.createDataFrame(rows, "place_id long, country_code string, _x int").repartition(7)
    got = sorted(r.place_id for r in outputs.every_nth(d, 10, "place_id").collect())
    want = sorted([k for k in range(1000) if k % 3][::10] + [k for k in range(1000) if not k % 3][::10])
    assert got == want

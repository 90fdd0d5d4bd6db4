import gzip
import json

import pytest
from pyspark.sql import functions as F

from placelake.sources import dump, osmchange, outputs, pbf, registry
from placelake.streaming import changes

XML = """<?xml version="1.0"?><osmChange version="0.6" generator="x">
<create><node id="31" lat="-3.25" lon="170.5000001"><tag k="place" v="hamlet"/><tag k="name" v="Ü &amp; b"/></node></create>
<delete><node id="40"/><way id="50"/></delete>
<create><node id="40" lat="1" lon="2"/></create>
<modify><way id="51"><nd ref="31"/><nd ref="40"/><nd ref="31"/></way><node id="31" lat="4" lon="5"/></modify>
<delete><node id="31"/></delete>
<modify><relation id="60"><member type="node" ref="40" role="label"/><member type="way" ref="51" role=""/></relation></modify></osmChange>"""


def test_changes_in_document_order(spark, tmp_path):
    (tmp_path / "1.osc").write_text(XML)
    (tmp_path / "2.osc.gz").write_bytes(gzip.compress(b'<osmChange><delete><way id="51"/></delete><modify><way id="50"><nd ref="9"/></way></modify></osmChange>'))
    all_ = osmchange.read_changes(spark, str(tmp_path))
    assert [(r.kind, r.id, r.deleted) for r in all_.where("seq.file like '%1.osc'").orderBy("seq").collect()] == [
        ("N", 31, False), ("N", 40, True), ("W", 50, True), ("N", 40, False), ("W", 51, False), ("N", 31, False), ("N", 31, True), ("R", 60, False)]
    got = {(r.kind, r.id): r for r in osmchange.net_changes(all_).collect()}
    assert {k: r.deleted for k, r in got.items()} == {("N", 31): True, ("N", 40): False, ("W", 50): False, ("W", 51): True, ("R", 60): False}
    first = all_.where("kind = 'N' and id = 31").orderBy("seq").first()
    assert (first.lon_e7, first.lat_e7, first.tags) == (1705000001, -32500000, {"place": "hamlet", "name": "Ü & b"})
    assert all_.where("kind = 'W' and id = 51 and not deleted").first().refs == [31, 40, 31] and [tuple(m) for m in got["R", 60].members] == [("N", 40, "label"), ("W", 51, "")]


@pytest.mark.parametrize("text", ['<osmChange><node id="1"/></osmChange>', "<osm/>", "<osmChange><create><area id='1'/></create></osmChange>", "<osmChange><create><node lat='1'/></create></osmChange>", "<osmChange>"])
def test_change_documents_that_are_wrong(text):
    with pytest.raises(osmchange.ChangeError):
        list(osmchange.parse_changes(text.encode(), "x"))


def test_merge(spark):
    base = spark.createDataFrame([("N", i, "old") for i in (2, 4, 6)] + [("W", i, "old") for i in (10, 20)], "kind string, id long, v string")
    new = spark.createDataFrame([("N", 1, "new", False), ("N", 4, "new", False), ("N", 7, "new", False), ("W", 15, "new", False), ("R", 5, "new", False), ("N", 6, None, True), ("W", 99, None, True)], "kind string, id long, v string, deleted boolean")
    got = {(r.kind, r.id): r.v for r in osmchange.merge(base, new).collect()}
    assert got == {("N", 1): "new", ("N", 2): "old", ("N", 4): "new", ("N", 7): "new", ("W", 10): "old", ("W", 15): "new", ("W", 20): "old", ("R", 5): "new"}
    assert tuple(osmchange.merge_stats(base, new).first()) == (4, 1, 1)
    with pytest.raises(ValueError):
        osmchange.check_keys(base.unionByName(base))
    assert osmchange.parse_state("#x\nsequenceNumber=4932\ntimestamp=2026-01-01T00\\:00\\:00Z\n") == (4932, "2026-01-01T00:00:00Z")
    assert osmchange.sequence_path(4932) == "000/004/932"


def test_pbf_round_trip(spark, tmp_path):
    rows = [("N", i, i * 1000 - 5, -i * 77, None, None, {"name": f"n{i}"} if i % 2 else {}) for i in range(1, 50)] + [("W", 3, None, None, [5, 2, 9], None, {"highway": "path"}), ("R", 4, None, None, None, [("W", 3, "outer")], {"type": "boundary"})]
    path = str(tmp_path / "x.osm.pbf")
    pbf.write_pbf(spark.createDataFrame(rows, pbf.SCHEMA), path, block=20, bbox=(9.4, 47.0, 9.7, 47.3), sequence=12)
    assert pbf.header(path)["bbox"] == (9.4, 47.0, 9.7, 47.3) and pbf.header(path)["sequence"] == 12
    pbf.register(spark)
    got = spark.read.format("osm_pbf").option("blobs", 2).load(path)
    back = sorted((r.kind, r.id, r.lon_e7, r.lat_e7, r.refs, [tuple(m) for m in r.members] if r.members else None, r.tags) for r in got.collect())
    assert back == sorted(rows, key=lambda r: (r[0], r[1]))
    assert got.where("kind = 'W'").count() == 1
    with open(path, "rb") as f:
        cut = f.read()[:-3]
    (tmp_path / "cut.osm.pbf").write_bytes(cut)
    with pytest.raises(pbf.PbfError):
        pbf.blobs(str(tmp_path / "cut.osm.pbf"))


def test_dump(spark, tmp_path):
    place = lambda i, **k: {"place_id": i, "object_type": "N", "object_id": i, "osm_key": "place", "osm_value": "x", "country_code": "li", "centroid": [9.5, 47.1]} | k
    rows = [{"type": "NominatimDumpFile", "content": {"version": "0.1.0"}}, {"type": "CountryInfo", "content": [{"country_code": "li", "name": {"name": "Liechtenstein", "name:en": "L"}}]},
            {"type": "Place", "content": [place(1, address_type="city", name={"name": "Vaduz"})]}, {"type": "Place", "content": [place(2, rank_address=30, housenumber="5", addresslines=[{"place_id": 1, "isaddress": True}]), place(3, object_type="X")]}, {"type": "Other", "content": {}}]
    path = tmp_path / "d.jsonl"
    path.write_text("\n".join(map(json.dumps, rows)))
    lines = dump.read_dump(spark, str(path))
    p = dump.places(lines)
    assert {(r.dump_id, r.layer_id, r.name) for r in p.collect()} == {("1", 5, "Vaduz"), ("2", 0, None)} and dump.skipped(lines) == 1
    assert [tuple(r) for r in dump.countries(lines).select("code", "name").collect()] == [("li", "Liechtenstein")]
    assert [tuple(r) for r in dump.parents(p).collect()] == [("2", 5, "Vaduz")]


def test_registry(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, "N", i, "LI" if i % 3 else "AT", 1, 9.0 + i / 100, 47.0) for i in range(30)]
    p = spark.createDataFrame(rows, "place_id long, osm_type string, osm_id long, country_code string, layer_id int, lon double, lat double")
    meta = {r.partition: r.num_places for r in registry.write_partitions(p, folder, "test").collect()}
    assert meta == {"li": 20, "at": 10} and registry.read_generation(folder)
    assert registry.read_partitions(spark, folder, ["li"]).count() == 20
    with pytest.raises(LookupError):
        registry.read_partitions(spark, folder, ["de"])
    r = registry.Registry(folder)
    r.upsert(registry.Source("a", "x.osm.pbf", "pbf", version=registry.Version(sequence=1)))
    assert registry.Registry(folder).sources["a"].version.sequence == 1 and r.remove("a") and not r.remove("a")
    assert registry.default_name("https://x/europe/austria-latest.osm.pbf") == "austria" and registry.detect_format("a.jsonl.gz") == "dump"
    assert [registry.owner_rule(5, None), registry.owner_rule(100, 10), registry.owner_rule(1, 10), registry.owner_rule(5, 6)] == ["own", "take", "skip", "split"]


def test_stream(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "id long, seq long, deleted boolean, value string"

    def feed(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        changes.follow(spark.readStream.schema(schema).parquet(src), out, ["id"], ck).awaitTermination()
        return {r.id: r.value for r in changes.live(changes.current(spark, out)).collect()}

    assert feed((1, 1, False, "a"), (2, 2, False, "b")) == {1: "a", 2: "b"}
    assert feed((1, 5, False, "c"), (2, 1, False, "late"), (3, 6, True, None)) == {1: "c", 2: "b"}
    assert tuple(changes.gap(spark.createDataFrame([(1,), (2,), (4,)], "seq long")).first()) == (1, 4, 1, False)


def test_geojson(spark):
    d = spark.createDataFrame([(1, 1, "A", 1, 9.123456789, 47.0, 12.34, 0.123456)], "qid int, rank int, name string, layer_id int, lon double, lat double, distance double, score double")
    f = json.loads(outputs.collections(outputs.features(d)).first().collection)["features"][0]
    assert f["geometry"]["coordinates"] == [9.1234568, 47.0] and f["properties"] == {"name": "A", "type": "poi", "distance": 12.3, "score": 0.1235}

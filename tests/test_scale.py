"""What keeps joins on cells in bounds: no broadcast of exploded cells, searches that end at the best."""

from pyspark.sql import functions as F

from placelake.functions import geo, rank, tags
from placelake.operators import address, cells, ingest, spatial

ROADS = "place_id long, lon double, lat double, lines array<array<struct<lon:double,lat:double>>>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_boxes_are_not_broadcast(spark):
    """the planner takes cells for as few as the requests they are cut from."""
    q = spark.range(50).select("id", geo.bbox(F.col("id") / 100, F.lit(0.0), F.col("id") / 100 + 0.04, F.lit(0.02)).alias("box")).withColumnRenamed("id", "qid")
    p = spark.createDataFrame([(1, 0.1, 0.0, [[{"lon": 0.1, "lat": 0.0}, {"lon": 0.13, "lat": 0.01}]]), (2, 0.7, 0.0, [])], ROADS)
    for places, want in ((p, {(q, 1) for q in range(6, 14)}), (p.drop("lines"), {(q, 1) for q in range(6, 11)})):
        hits = spatial.in_box(q, places)
        assert "Broadcast" not in plan(hits)
        assert {(r.qid, r.place_id) for r in hits.collect()} == want


def test_lines_make_one_pair_a_segment(spark):
    """a long segment lies near a request by many of its points, of which one makes a pair; distances are those of place_distance."""
    at = lambda *v: [{"lon": x, "lat": y} for x, y in v]
    rows = [(1, 0.0, 0.0, [at((0.0, 0.0), (0.1, 0.05), (0.02, 0.08)), at((0.3, 0.3))]), (2, 0.05, 0.02, []), (3, 0.0, 70.0, [at((0.0, 70.0), (3.0, 71.0))]), (4, 179.9, 89.0, [at((179.9, 89.0), (100.0, 89.9), (-50.0, 89.95))])]
    p = spark.createDataFrame(rows, ROADS)
    q = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate([(0.05, 0.02), (0.06, 0.04), (0.3, 0.301), (1.5, 70.45), (100.0, 89.8), (-20.0, 89.94), (7.0, 90.0), (9.0, 9.0)])], "qid int, lon double, lat double")
    for radius in (700.0, 30_000.0):
        asked = q.withColumn("radius", F.lit(radius))
        far = q.select("qid", F.col("lon").alias("x"), F.col("lat").alias("y")).crossJoin(p.select("place_id", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"), F.col("lines").alias("p_lines")))
        want = {(r.qid, r.place_id): r.d for r in far.select("qid", "place_id", geo.place_distance("x", "y").alias("d")).collect() if r.d <= radius}
        got = spatial.within(asked, p).collect()
        assert len(got) == len(want) and {(r.qid, r.place_id): r.distance for r in got} == want and len(want) >= 4
    pieces = spatial._pieces(p.where("place_id = 1")).where("parts > 0")
    assert pieces.groupBy("a_lon", "b_lon", "k").count().where("count > 1").isEmpty()
    assert "p_lines" not in plan(spatial.within(q.withColumn("radius", F.lit(700.0)), p))


def test_reverse_looks_no_further_than_the_nearest(spark):
    """of places all within the radius, those near are looked at alone; the results are those of the whole radius."""
    p = spark.range(4000).select(F.col("id").alias("place_id"), F.lit(1).alias("layer_id"), ((F.col("id") * 37 % 400) / 100).alias("lon"), ((F.col("id") * 41 % 390) / 100).alias("lat"))
    q = p.where("place_id % 50 = 0").select(F.col("place_id").alias("qid"), "lon", "lat")
    whole = spatial._ranked(spatial.within(q.withColumn("radius", F.lit(500_000.0)), p), 3, "distance", "place_id")
    got = spatial.reverse(q, p, 500_000.0, 3)
    assert sorted(map(tuple, got.select("qid", "place_id", "rank").collect())) == sorted(map(tuple, whole.select("qid", "place_id", "rank").collect()))
    reach = cells.nearest_reach(q, p, 3, ("lon", "lat"), ("lon", "lat"), 500_000.0).agg(F.max("_radius")).first()[0]
    assert reach < 100_000


def test_best_near_is_the_best_of_the_whole_radius(spark):
    """places too far to reach the score of the nearest are left out, important ones that can are not."""
    p = spark.range(3000).select(F.col("id").alias("place_id"), ((F.col("id") * 37 % 4000) / 100).alias("lon"), ((F.col("id") * 41 % 3900) / 100).alias("lat"), ((F.col("id") * 7 % 100) / 100).alias("importance"))
    q = p.where("place_id % 100 = 0").select(F.col("place_id").alias("qid"), "lon", "lat").union(spark.createDataFrame([(-1, 120.0, -60.0), (-2, 44.0, 20.0)], "qid long, lon double, lat double"))
    for radius in (3_000_000.0, 60_000.0):
        asked = q.withColumn("radius", F.lit(radius))
        score = F.round(rank.proximity(F.col("distance")) * (1 + F.col("importance") * 1e-3), 9)
        whole = spatial._ranked(spatial.within(asked, p).join(p.select("place_id", "importance"), "place_id").withColumn("score", score), 3, F.desc("score"), "place_id")
        got = spatial.best_near(asked, p, 3, 9).select("qid", "place_id", "score", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.select("qid", "place_id", "score", "rank").collect()))


def test_locality_parents_of_each_class(spark):
    """the least ratio of all classes, though only the nearest of each are looked at; a place's own unit is none."""
    rows = [(k, 5 if k % 3 else 4, ["city", "village", "hamlet"][k % 3] if k % 3 else "suburb", k * 37 % 400 / 1000, k * 41 % 390 / 1000) for k in range(300)]
    loc = spark.createDataFrame(rows, "unit_id long, l_layer int, value string, l_lon double, l_lat double")
    p = spark.range(200).select(F.col("id").alias("place_id"), F.when(F.col("id") % 9 == 0, 4).otherwise(0).alias("layer_id"), ((F.col("id") * 53 % 400) / 1000).alias("lon"), ((F.col("id") * 59 % 390) / 1000).alias("lat"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("own_unit"))
    radius = tags.lookup(F.col("value"), tags.PLACE_RADIUS)
    met = p.crossJoin(loc).withColumn("ratio", geo.haversine("lon", "lat", "l_lon", "l_lat") / radius).where("ratio <= 1 and l_layer > layer_id and (own_unit is null or own_unit != unit_id)")
    want = met.groupBy("place_id", F.col("l_layer").alias("layer_id")).agg(F.min_by("unit_id", F.struct("ratio", "unit_id")).alias("unit_id"))
    got = address.locality_parents(p, loc)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 150
    assert address.locality_parents(p, loc.where("false")).count() == 0
    near = cells.nearest_reach(p, loc.where("value = 'village'"), 2, ("lon", "lat"), ("l_lon", "l_lat"), 15_000.0)
    assert near.where("_radius < 15000").count() > 150


def test_streets_are_not_broadcast(spark):
    """cells of segments and labels are merged, whatever the planner takes them for."""
    line = lambda x: [[{"lon": x, "lat": 0.0}, {"lon": x + 0.002, "lat": 0.001}]]
    s = spark.createDataFrame([(k, "a" if k < 40 else "b", line((k + (5 if k > 20 else 0)) * 0.003)) for k in range(60)], "place_id long, key string, lines array<array<struct<lon:double,lat:double>>>")
    links = ingest.street_links(s)
    assert "Broadcast" not in plan(links)
    assert {r.node: r.root for r in ingest.label_components(s, links).collect()} == {k: 0 if k <= 20 else 21 if k < 40 else 40 for k in range(60)}

"""Geometry as column expressions: degrees in, metres out. Lines are arrays of struct<lon,lat>, polygons arrays of rings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean Earth radius in metres.
EARTH = 6_371_008.8
DEGREE = EARTH * 0.017453292519943295


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def haversine(lon1, lat1, lon2, lat2) -> Column:
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def segment_distance(lon, lat, a: Column, b: Column) -> Column:
    """Point to segment, on a plane tangent at the point."""
    lon, lat = _c(lon), _c(lat)
    east = lambda p: (p["lon"] - lon) * F.cos(F.radians(lat)) * DEGREE
    north = lambda p: (p["lat"] - lat) * DEGREE
    ax, ay, bx, by = east(a), north(a), east(b), north(b)
    size = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    t = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * (bx - ax) + ay * (by - ay)) / size))).otherwise(F.lit(0.0))
    x, y = ax + t * (bx - ax), ay + t * (by - ay)
    return F.sqrt(x * x + y * y)


def line_distance(lon, lat, line: Column) -> Column:
    """Point to line; to the point where a line has one; null where it has none."""
    far = F.zip_with(F.slice(line, 1, F.greatest(F.size(line) - 1, F.lit(0))), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda a, b: segment_distance(lon, lat, a, b))
    one = haversine(lon, lat, F.get(line, 0)["lon"], F.get(line, 0)["lat"])
    return F.when(F.size(line) > 1, F.array_min(far)).when(F.size(line) == 1, one)


def lines_distance(lon, lat, lines: Column) -> Column:
    return F.array_min(F.transform(lines, lambda line: line_distance(lon, lat, line)))


def place_distance(lon, lat) -> Column:
    """Point to place (columns lon, lat, lines of the place given by name p_lon, p_lat, p_lines): to its lines, where it has any."""
    return F.coalesce(lines_distance(lon, lat, F.col("p_lines")), haversine(lon, lat, "p_lon", "p_lat"))


def _crossings(lon, lat, ring: Column) -> Column:
    """How many edges of a ring (closed or not) a ray to the east crosses, by the half-open rule."""
    lon, lat = _c(lon), _c(lat)
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    hits = F.zip_with(ring, shifted, lambda a, b: F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]), 1).otherwise(0))
    return F.aggregate(hits, F.lit(0), lambda s, x: s + x)


def polygon_contains(lon, lat, rings: Column) -> Column:
    """Even-odd over all rings, so that a point in a hole is outside."""
    return F.aggregate(F.transform(rings, lambda r: _crossings(lon, lat, r)), F.lit(0), lambda s, x: s + x) % 2 == 1


def polygons_contain(lon, lat, polygons: Column) -> Column:
    return F.coalesce(F.exists(polygons, lambda rings: polygon_contains(lon, lat, rings)), F.lit(False))


def e7(degrees) -> Column:
    """Degrees as rounded ten-millionths."""
    return F.round(_c(degrees) * 1e7).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out, and written into the plan, once, wherever `use` has it."""
    return F.get(F.transform(F.array(value), use), 0)


def ring_side(lon, lat, ring: Column) -> Column:
    """1 inside, 0 on the edge, -1 outside a closed ring, exactly, on ten-millionths of a degree (products in DECIMAL, as they pass 64 bits)."""
    whole = lambda v: e7(v).cast("decimal(19,0)")
    corner = lambda p: F.struct(whole(p["lon"]).alias("x"), whole(p["lat"]).alias("y"))

    def edge(a: Column, b: Column, at: Column) -> Column:
        def sides(cross: Column) -> Column:
            on = (cross == 0) & (F.least(a["x"], b["x"]) <= at["x"]) & (at["x"] <= F.greatest(a["x"], b["x"])) & (F.least(a["y"], b["y"]) <= at["y"]) & (at["y"] <= F.greatest(a["y"], b["y"]))
            up, down = (a["y"] <= at["y"]) & (b["y"] > at["y"]) & (cross > 0), (a["y"] > at["y"]) & (b["y"] <= at["y"]) & (cross < 0)
            return F.struct(on.alias("on"), F.when(up, 1).when(down, -1).otherwise(0).alias("turn"))

        return let((b["x"] - a["x"]) * (at["y"] - a["y"]) - (b["y"] - a["y"]) * (at["x"] - a["x"]), sides)

    def side(at: Column, points: Column) -> Column:
        n = F.greatest(F.size(points) - 1, F.lit(0))
        edges = F.zip_with(F.slice(points, 1, n), F.slice(points, 2, n), lambda a, b: edge(a, b, at))
        return let(edges, lambda es: F.when(F.exists(es, lambda e: e["on"]), 0).when(F.aggregate(es, F.lit(0), lambda s, e: s + e["turn"]) != 0, 1).otherwise(-1))

    both = F.struct(F.struct(whole(lon).alias("x"), whole(lat).alias("y")).alias("at"), F.transform(ring, corner).alias("points"))
    return let(both, lambda v: side(v["at"], v["points"]))


def polygon_covers(lon, lat, rings: Column) -> Column:
    """Inside or on the edge of a polygon; the inside of a hole isn't, its edge is."""
    sides = F.transform(rings, lambda r: ring_side(lon, lat, r))
    return let(sides, lambda s: (F.get(s, F.lit(0)) >= 0) & ~F.exists(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda h: h > 0))


def segment_hits_box(a: Column, b: Column, box: Column) -> Column:
    """Liang-Barsky: whether a segment meets a box, edges included."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    low, high, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, a["lon"] - box["min_lon"]), (dx, box["max_lon"] - a["lon"]), (-dy, a["lat"] - box["min_lat"]), (dy, box["max_lat"] - a["lat"])):
        low = F.when(p < 0, F.greatest(low, q / p)).otherwise(low)
        high = F.when(p > 0, F.least(high, q / p)).otherwise(high)
        ok = ok & ((p != 0) | (q >= 0))
    return ok & (low <= high)


def ring_crosses_box(ring: Column, box: Column) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.exists(F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), lambda a, b: segment_hits_box(a, b, box)), lambda x: x)


def bbox(min_lon, min_lat, max_lon, max_lat) -> Column:
    return F.struct(_c(min_lon).alias("min_lon"), _c(min_lat).alias("min_lat"), _c(max_lon).alias("max_lon"), _c(max_lat).alias("max_lat"))


def box_of_points(points: Column) -> Column:
    lons, lats = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return bbox(F.array_min(lons), F.array_min(lats), F.array_max(lons), F.array_max(lats))


def box_contains(box: Column, lon, lat) -> Column:
    return (_c(lon) >= box["min_lon"]) & (_c(lon) <= box["max_lon"]) & (_c(lat) >= box["min_lat"]) & (_c(lat) <= box["max_lat"])


def box_contains_box(a: Column, b: Column) -> Column:
    return (b["min_lon"] >= a["min_lon"]) & (b["max_lon"] <= a["max_lon"]) & (b["min_lat"] >= a["min_lat"]) & (b["max_lat"] <= a["max_lat"])


def boxes_intersect(a: Column, b: Column) -> Column:
    return (a["min_lon"] <= b["max_lon"]) & (b["min_lon"] <= a["max_lon"]) & (a["min_lat"] <= b["max_lat"]) & (b["min_lat"] <= a["max_lat"])


def box_union(a: Column, b: Column) -> Column:
    return bbox(F.least(a["min_lon"], b["min_lon"]), F.least(a["min_lat"], b["min_lat"]), F.greatest(a["max_lon"], b["max_lon"]), F.greatest(a["max_lat"], b["max_lat"]))


def box_intersection(a: Column, b: Column) -> Column:
    return bbox(F.greatest(a["min_lon"], b["min_lon"]), F.greatest(a["min_lat"], b["min_lat"]), F.least(a["max_lon"], b["max_lon"]), F.least(a["max_lat"], b["max_lat"]))


def box_center(box: Column) -> Column:
    return F.struct(((box["min_lon"] + box["max_lon"]) / 2).alias("lon"), ((box["min_lat"] + box["max_lat"]) / 2).alias("lat"))


def box_around(lon, lat, radius) -> Column:
    """Box that holds the circle; all longitudes where it meets a pole or the antimeridian."""
    lon, lat, radius = _c(lon), _c(lat), _c(radius)
    dlat = radius / DEGREE
    dlon = dlat / F.greatest(F.cos(F.radians(lat)), F.lit(1e-6))
    low, high = F.greatest(lat - dlat, F.lit(-90.0)), F.least(lat + dlat, F.lit(90.0))
    wide = (low <= -90) | (high >= 90) | (lon - dlon < -180) | (lon + dlon > 180)
    return bbox(F.when(wide, -180.0).otherwise(lon - dlon), low, F.when(wide, 180.0).otherwise(lon + dlon), high)


def box_expanded(box: Column, degrees: float) -> Column:
    """Grown by so many degrees of latitude, and as many metres of longitude."""
    middle = (box["min_lat"] + box["max_lat"]) / 2
    by = F.lit(degrees) / F.greatest(F.cos(F.radians(middle)), F.lit(0.01))
    return bbox(box["min_lon"] - by, box["min_lat"] - degrees, box["max_lon"] + by, box["max_lat"] + degrees)


def crosses_antimeridian(box: Column) -> Column:
    return box["max_lon"] - box["min_lon"] > 180


def box_parse(text) -> Column:
    """'min_lon,min_lat,max_lon,max_lat'; null unless it is four numbers in range and order."""
    parts = F.split(_c(text), ",")
    n = [F.trim(F.get(parts, k)).try_cast("double") for k in range(4)]
    ok = (F.size(parts) == 4) & valid(n[0], n[1]) & valid(n[2], n[3]) & (n[0] <= n[2]) & (n[1] <= n[3])
    return F.when(ok, bbox(*n))


def valid(lon, lat) -> Column:
    return F.coalesce(~F.isnan(_c(lon)) & ~F.isnan(_c(lat)) & _c(lon).between(-180, 180) & _c(lat).between(-90, 90), F.lit(False))


def lower_bound(box: Column, lon, lat) -> Column:
    """Metres to a box at least, with a tenth off for the plane's error."""
    x, y = F.greatest(box["min_lon"], F.least(_c(lon), box["max_lon"])), F.greatest(box["min_lat"], F.least(_c(lat), box["max_lat"]))
    return haversine(lon, lat, x, y) * 0.9


def morton(lon, lat) -> Column:
    """Z-order of the position on a grid of 65536 x 65536."""
    x = F.least(F.lit(65535), F.floor((_c(lon) + 180) / 360 * 65536)).cast("long")
    y = F.least(F.lit(65535), F.floor((_c(lat) + 90) / 180 * 65536)).cast("long")

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def hilbert(x: Column, y: Column, order: int = 16) -> Column:
    """Distance along the Hilbert curve of a square of 2^order; x and y are longs."""
    steps = F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1))

    def step(acc: Column, k: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        rx = F.when(acc["x"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        ry = F.when(acc["y"].bitwiseAND(side) > 0, 1).otherwise(0).cast("long")
        d = acc["d"] + side * side * (F.lit(3) * rx).bitwiseXOR(ry)
        x1 = F.when((ry == 0) & (rx == 1), F.lit((1 << order) - 1) - acc["x"]).otherwise(acc["x"])
        y1 = F.when((ry == 0) & (rx == 1), F.lit((1 << order) - 1) - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, y1).otherwise(x1).alias("x"), F.when(ry == 0, x1).otherwise(y1).alias("y"), d.alias("d"))

    return F.aggregate(steps, F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d")), step)["d"]


def cumulative(line: Column) -> Column:
    """Metres along a line at each of its points."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    steps = F.zip_with(F.slice(line, 1, n), F.slice(line, 2, n), lambda a, b: haversine(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))


def point_along(line: Column, along: Column, metres) -> Column:
    """The point so many metres along a line, whose cumulative lengths are `along`."""
    d = _c(metres)
    k = F.greatest(F.lit(1), F.least(F.size(F.filter(along, lambda x: x < d)), F.size(line) - 1))
    a, b, low, high = F.get(line, k - 1), F.get(line, k), F.get(along, k - 1), F.get(along, k)
    t = F.when(high > low, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d - low) / (high - low)))).otherwise(F.lit(0.0))
    return F.struct((a["lon"] + t * (b["lon"] - a["lon"])).alias("lon"), (a["lat"] + t * (b["lat"] - a["lat"])).alias("lat"))


def line_midpoint(line: Column) -> Column:
    # bound as lambda variables: an expression is worked out again wherever it stands
    middle = F.get(F.transform(F.array(F.struct(line.alias("line"), cumulative(line).alias("along"))), lambda x: point_along(x["line"], x["along"], F.element_at(x["along"], -1) / 2)), 0)
    return F.when(F.size(line) == 1, F.get(line, 0)).when(F.size(line) > 1, middle)


def is_closed(refs: Column) -> Column:
    return (F.size(refs) >= 4) & (F.get(refs, 0) == F.element_at(refs, -1))

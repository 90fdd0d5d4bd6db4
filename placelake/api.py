"""Requests as builders, and an engine that answers tables of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placelake.functions import geo, tags, text
from placelake.functions.rank import Ranking
from placelake.operators import address, spatial
from placelake.operators.textsearch import Rules, TextIndex
from placelake.schema import LAYER_ID, LOCALITY
from placelake.sources import outputs

#: Policy of requests from outside.
MAX_LIMIT, MAX_RADIUS, REVERSE_RADIUS = 50, 500_000.0, 1000.0


class InvalidRequest(ValueError):
    pass


class CountryNotLoaded(LookupError):
    pass


def _layers(names) -> list[int]:
    try:
        return [LAYER_ID[n] for n in names]
    except KeyError as e:
        raise InvalidRequest(f"unknown layer {e}") from None


def _check(lon, lat, radius=None, limit=1) -> None:
    if (lon is None) != (lat is None):
        raise InvalidRequest("lat and lon go together")
    if lon is not None and not (-180 <= lon <= 180 and -90 <= lat <= 90):
        raise InvalidRequest("coordinates out of range")
    if radius is not None and not (0 < radius <= MAX_RADIUS):
        raise InvalidRequest(f"radius must be over 0 and at most {MAX_RADIUS:.0f}")
    if radius is not None and lon is None:
        raise InvalidRequest("a radius needs a point")
    if not 1 <= limit <= MAX_LIMIT:
        raise InvalidRequest(f"limit must be from 1 to {MAX_LIMIT}")


@dataclass
class Search:
    q: str = ""
    lon: float | None = None
    lat: float | None = None
    radius: float | None = None
    bbox: tuple[float, float, float, float] | None = None
    countries: list[str] = field(default_factory=list)
    layers: list[str] = field(default_factory=list)
    osm_tag: list[str] = field(default_factory=list)
    limit: int = 10
    autocomplete: bool = True

    def validate(self) -> Search:
        _check(self.lon, self.lat, self.radius, self.limit)
        if self.bbox and not (self.bbox[0] <= self.bbox[2] and self.bbox[1] <= self.bbox[3]):
            raise InvalidRequest("bbox is min_lon, min_lat, max_lon, max_lat")
        if not self.q.strip() and self.lon is None and not self.bbox:
            raise InvalidRequest("a text or a location is needed")
        return self


def invalid_reason(requests: DataFrame) -> DataFrame:
    """The same checks over a table (lon, lat, radius, limit): column invalid_reason, null where a request is fine."""
    reason = (
        F.when(F.col("lon").isNull() != F.col("lat").isNull(), "lat and lon go together").when(F.col("lon").isNotNull() & ~geo.valid("lon", "lat"), "coordinates out of range")
        .when(F.col("radius").isNotNull() & ~((F.col("radius") > 0) & (F.col("radius") <= MAX_RADIUS)), "radius out of range").when(F.col("radius").isNotNull() & F.col("lon").isNull(), "a radius needs a point")
        .when(~F.col("limit").between(1, MAX_LIMIT), "limit out of range")
    )
    return requests.withColumn("invalid_reason", reason)


class Engine:
    """Answers requests over places (and names of admin units); each method takes a table of requests or one builder."""

    def __init__(self, places: DataFrame, context=None, rules: Rules | None = None, ranking: Ranking = Ranking()):
        self.spark: SparkSession = places.sparkSession
        self.places, self.context, self.rules, self.ranking = places, context, rules, ranking
        self._index: TextIndex | None = None

    @property
    def index(self) -> TextIndex:
        if self._index is None:
            self._index = TextIndex(self.places, self.context, self.rules, self.ranking)
        return self._index

    def _loaded(self, countries: list[str]) -> None:
        if countries:
            there = {r[0] for r in self.places.select(F.lower("country_code")).distinct().collect()}  # countries: a few hundred
            if missing := [c for c in countries if c.lower() not in there]:
                raise CountryNotLoaded(", ".join(missing))

    def search(self, s: Search) -> DataFrame:
        """One search: text with filters, or by place alone; qid is 0."""
        s.validate()
        self._loaded(s.countries)
        layers, tag = _layers(s.layers), tags.tag_filter(s.osm_tag, F.col("osm_key"), F.col("osm_value")) if s.osm_tag else None
        one = self.spark.createDataFrame([(0, s.q, s.lon, s.lat, s.limit, s.autocomplete)], "qid int, q string, lon double, lat double, limit int, autocomplete boolean")
        inside = None
        if s.radius:
            inside = spatial.within(one.select("qid", "lon", "lat", F.lit(float(s.radius)).alias("radius")), self.places)
        if s.bbox:
            boxed = spatial.in_box(one.select("qid", geo.bbox(*map(float, s.bbox)).alias("box")), self.places)
            inside = boxed if inside is None else inside.join(boxed, ["qid", "place_id"], "left_semi")
        if s.countries:
            own = spatial.keep(self.places, countries=s.countries).select(F.lit(0).alias("qid"), "place_id")
            inside = own if inside is None else inside.join(own, ["qid", "place_id"], "left_semi")
        if one.select(F.size(text.tokens(F.col("q")))).first()[0]:
            return self.index.search(one, inside, layers, tag)
        fitting = spatial.keep(self.places, layers, s.countries, tag)
        if inside is None:
            if s.lon is None:
                raise InvalidRequest("a text or a location is needed")
            return spatial.nearest(one, fitting, s.limit)
        if "distance" not in inside.columns:
            there = inside.join(self.places.select("place_id", "lon", "lat"), "place_id")
            inside = there.select("qid", "place_id", (geo.haversine(F.lit(s.lon), F.lit(s.lat), "lon", "lat") if s.lon is not None else F.lit(None).cast("double")).alias("distance"))
        return spatial.spatial_only(inside, fitting, s.limit, s.lon is not None, self.ranking)

    def _fitting(self, layers, countries, osm_tag) -> DataFrame:
        self._loaded(list(countries))
        tag = tags.tag_filter(list(osm_tag), F.col("osm_key"), F.col("osm_value")) if osm_tag else None
        return spatial.keep(self.places, layers, list(countries), tag)

    def reverse(self, requests: DataFrame, radius: float = REVERSE_RADIUS, limit: int = 1, layers=(), countries=(), osm_tag=()) -> DataFrame:
        """The nearest places of address layers, or of those given, within `radius` of each request (qid, lon, lat)."""
        _check(0.0, 0.0, radius, limit)
        return spatial.reverse(requests, self._fitting((), countries, osm_tag), radius, limit, _layers(layers) or spatial.REVERSE_LAYERS)

    def nearest(self, requests: DataFrame, limit: int = 5, radius: float | None = None, layers=(), countries=(), osm_tag=()) -> DataFrame:
        """The nearest places of each request (qid, lon, lat)."""
        _check(0.0, 0.0, radius, limit)
        return spatial.nearest(requests, self._fitting(_layers(layers), countries, osm_tag), limit, most=radius)

    def present(self, hits: DataFrame, lang: str | None = None, geometry: bool = False, units: DataFrame | None = None) -> DataFrame:
        """qid, collection: GeoJSON for hits (qid, place_id, rank and scores), with names in `lang` where a place has them, full geometry where
        asked for, and the names of parents where the admin units (ADMIN_UNIT) are given."""
        extra = [c for c in hits.columns if c in ("distance", "score")]
        rows = hits.select("qid", "place_id", "rank", *extra).join(self.places, "place_id")
        if lang:
            rows = rows.withColumn("name", text.localized(F.col("names"), F.col("name"), F.lit(lang)))
        if units is not None:
            rows = rows.drop("city").join(address.address(self.places, units, lang), "place_id", "left")
        return outputs.collections(outputs.features(rows, geometry))

    def lookup(self, refs: list[str]) -> DataFrame:
        rows = self.spark.createDataFrame([(0, k, r) for k, r in enumerate(refs)], "qid int, pos int, ref string").withColumn("r", text.place_ref(F.col("ref")))
        if bad := rows.where("r is null").first():
            raise InvalidRequest(f"not a reference: {bad.ref}")
        return spatial.lookup(rows.select("qid", "pos", "r.kind", "r.number"), self.places)

    def contains(self, requests: DataFrame, layers=(), countries=(), osm_tag=()) -> DataFrame:
        """Areas that hold each request (qid, lon, lat), most specific first."""
        ids = _layers(layers)
        if any(k < LOCALITY for k in ids):
            raise InvalidRequest("only layers from locality up contain")
        return spatial.containing(requests, self._fitting((), countries, osm_tag), ids)

    def status(self) -> DataFrame:
        from placelake.sources.registry import partition_meta

        return partition_meta(self.places.withColumn("partition", F.lower("country_code")))

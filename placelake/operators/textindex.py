"""Inverted index of places as tables: postings and term statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake.functions import text
from placelake.schema import CITY

#: Fields and what a match in each is worth.
BOOST = {"name": 3.0, "exonym": 3.0, "alt": 2.5, "address": 1.0, "housenumber": 1.5}
K1, B = 1.2, 0.75
MAJOR_IMPORTANCE = 0.3


def documents(places: DataFrame, context: Column | None = None) -> DataFrame:
    """place_id and a token array for each field. context: names of the place's parents (array<string>), default and English."""
    has = set(places.columns)
    col = lambda c, kind: F.col(c) if c in has else F.expr(f"cast(null as {kind})")
    empty = F.expr("cast(array() as array<string>)")
    names, alts = col("names", "map<string,string>"), F.coalesce(col("alt_names", "array<string>"), empty)
    all_of = lambda xs: F.flatten(F.transform(xs, text.tokens))
    english = F.element_at(names, "en")
    exonym = F.when((F.col("layer_id") >= CITY) & english.isNotNull() & (english != F.coalesce("name", F.lit(""))), text.tokens(english)).otherwise(empty)
    others = F.concat(alts, F.coalesce(F.map_values(names), empty))
    latin = F.array_compact(F.transform(F.concat(F.array("name"), others), text.transliterate))
    address = F.array_compact(F.concat(F.array(col("street", "string"), col("postcode", "string"), col("city", "string")), context if context is not None else empty))
    return places.select(
        "place_id", text.tokens(F.col("name")).alias("name"), exonym.alias("exonym"), F.array_distinct(all_of(F.concat(others, latin))).alias("alt"),
        all_of(F.concat(address, F.array_compact(F.transform(address, text.transliterate)))).alias("address"), text.tokens(col("housenumber", "string")).alias("housenumber"),
    )


def postings(docs: DataFrame) -> DataFrame:
    """field, term, place_id, tf, dl: how often a term is in a field of a place, and the field's length."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in BOOST))
    rows = docs.select("place_id", F.explode(fields).alias("f")).select("place_id", "f.field", "f.terms").where("size(terms) > 0")
    rows = rows.select("place_id", "field", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return rows.groupBy("field", "term", "place_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def term_stats(postings_: DataFrame) -> DataFrame:
    """grp, term, df: in how many places a term is; name and exonym count as one field."""
    grp = F.when(F.col("field") == "exonym", "name").otherwise(F.col("field"))
    return postings_.select(grp.alias("grp"), "term", "place_id").distinct().groupBy("grp", "term").agg(F.count("*").alias("df"))


def field_stats(postings_: DataFrame, n_places: int) -> DataFrame:
    """field, avgdl: mean length over all places; an exonym's is 1."""
    sums = postings_.groupBy("field").agg(F.sum("tf").alias("words"))
    return sums.select("field", F.when(F.col("field") == "exonym", 1.0).otherwise(F.col("words") / max(1, n_places)).alias("avgdl"))


def bm25(tf: Column, dl: Column, avgdl: Column, df: Column, n_places: int) -> Column:
    idf = F.log(1 + (n_places - F.least(df, F.lit(n_places)) + 0.5) / (F.least(df, F.lit(n_places)) + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


def weighted(postings_: DataFrame, n_places: int) -> DataFrame:
    """postings with their BM25 weight: field, term, place_id, w. Statistics are over all partitions of places."""
    grp = F.when(F.col("field") == "exonym", "name").otherwise(F.col("field"))
    rows = postings_.withColumn("grp", grp).join(term_stats(postings_), ["grp", "term"]).join(F.broadcast(field_stats(postings_, n_places)), "field")  # five fields
    return rows.select("field", "term", "place_id", bm25(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("df"), n_places).alias("w"))

"""Text search over places: variants of query words, BM25, phases, re-ranking, de-duplication.

A query word becomes variants, dictionary terms each with a weight: the word itself, synonyms, words it begins, parts of a
compound, words a typo away. Variants meet postings in one equi-join on (field, term); scores add up by field, fields by
the best plus a tenth of the rest, and query words by sum. Phases relax from exact to two typos to a missing word, each
over the requests that the ones before left without a hit.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placelake.functions import geo, text
from placelake.functions.rank import Ranking, city_echo, combined, name_match
from placelake.operators import textindex
from placelake.operators.ingest import cut_lineage
from placelake.operators.spatial import drop_near_duplicates

#: What kinds of variants are worth against the word as typed.
SYNONYM, PREFIX, COMPOUND, TYPO, TYPO_PREFIX, TIE = 0.9, 0.6, 0.8, 0.4, 0.3, 0.1
PHASES = [(0, 0, 1.0), (1, 0, 1.0), (2, 0, 1.0), (2, 1, 0.5)]  # typos, missing words, factor


def fetch_size(limit: Column, with_tags: bool) -> Column:
    """How many candidates are re-ranked."""
    return F.least(F.greatest(limit * 50, F.lit(200)), F.lit(2000)) if with_tags else F.least(F.greatest(limit * 5, F.lit(20)), F.lit(200))


@dataclass
class Rules:
    """Synonyms: (country or None, word, alternatives) and (country or None, suffix, replacements); normalised on the way in."""

    words: list[tuple[str | None, str, list[str]]] = field(default_factory=list)
    suffixes: list[tuple[str | None, str, list[str]]] = field(default_factory=list)

    @classmethod
    def load(cls, folder: str | None = None, inline: dict | None = None, languages: list[str] | None = None, everywhere: bool = False) -> Rules:
        """Rules of a folder's TOML files, one for each language by its name, and inline ones.

        A file has `countries` (codes; all where it is left out) and the tables `words` and `suffixes`, each from a word to its
        alternatives. `languages` picks files; `everywhere` passes their countries over. Unknown tables, keys or suffix
        alternatives of several words, and alternatives that aren't lists of text are errors.
        """
        found = cls()
        files = sorted(Path(folder).glob("*.toml")) if folder else []
        for path in files:
            if languages is None or path.stem in languages:
                found._take(tomllib.loads(path.read_text()), path.name, everywhere)
        if inline:
            found._take(inline, "inline rules", True)
        return found

    def _take(self, rules: dict, name: str, everywhere: bool) -> None:
        if unknown := set(rules) - {"countries", "words", "suffixes"}:
            raise ValueError(f"{name}: unknown {', '.join(sorted(unknown))}")
        countries = [None] if everywhere or "countries" not in rules else [c.lower() for c in rules["countries"]]
        for table, into in (("words", self.words), ("suffixes", self.suffixes)):
            for key, values in rules.get(table, {}).items():
                if not isinstance(values, list) or not all(isinstance(v, str) for v in values):
                    raise ValueError(f"{name}: {table}.{key} isn't a list of text")
                word, others = text.plain_tokens(key), [text.plain_tokens(v) for v in values]
                if len(word) != 1 or not all(others) or table == "suffixes" and any(len(v) != 1 for v in others):
                    raise ValueError(f"{name}: {table}.{key} must be a single word, and so must what a suffix stands for")
                into.extend((cc, word[0], [" ".join(v) for v in others]) for cc in countries)

    def expand(self, spark: SparkSession, words: DataFrame, countries: list[str] | None = None) -> DataFrame:
        """(term, alt) for distinct words (column term); alt is a word or a phrase. Of suffix rules the longest that fits applies, after two letters at least."""
        use = lambda cc: cc is None or countries is None or cc in countries
        w = [(a, b) for cc, a, bs in self.words if use(cc) for b in bs]
        s = [(a, b) for cc, a, bs in self.suffixes if use(cc) for b in bs]
        rules = F.broadcast(spark.createDataFrame(w, "term string, alt string")) if w else None  # rule files: hundreds of rows
        out = words.join(rules, "term").select("term", "alt") if w else words.select("term", F.col("term").alias("alt")).limit(0)
        if s:
            sr = F.broadcast(spark.createDataFrame(s, "suffix string, repl string"))
            hit = words.join(sr, F.col("term").endswith(F.col("suffix")) & (F.char_length("term") >= F.char_length("suffix") + 2))
            longest = hit.withColumn("_m", F.max(F.char_length("suffix")).over(W.partitionBy("term"))).where(F.char_length("suffix") == F.col("_m"))
            out = out.unionByName(longest.select("term", F.concat(F.expr("left(term, char_length(term) - char_length(suffix))"), F.col("repl")).alias("alt")))
        return out.where("alt != term").distinct()


def deletions(term: Column, most: int) -> Column:
    """A word and what is left of it after up to `most` deletions; words within `most` edits share one."""
    one = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.char_length(t))))
    out = F.array(term)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, one))))
    return out


def typo_terms(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(term, d, like, edits): dictionary terms (column like) within d edits of words (term, d); an equi-join on deletions, then the exact distance."""
    w = words.where("d > 0").distinct().withColumn("x", F.explode(F.when(F.col("d") == 1, deletions(F.col("term"), 1)).otherwise(deletions(F.col("term"), 2))))
    t = dictionary.select(F.col("term").alias("like")).distinct().withColumn("x", F.explode(deletions(F.col("like"), 2)))
    pairs = w.join(t, "x").select("term", "d", "like").distinct().where("term != like")
    return pairs.withColumn("edits", text.osa_distance(F.col("term"), F.col("like"))).where("edits <= d")


def typo_prefixes(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(term, like): dictionary terms some beginning of which is one edit from an unfinished word."""
    w = words.select("term").distinct().withColumn("x", F.explode(deletions(F.col("term"), 1)))
    n = F.char_length("like")
    starts = F.transform(F.sequence(F.lit(3), F.least(n, F.lit(14))), lambda k: F.expr("like").substr(F.lit(1), k))
    t = dictionary.select(F.col("term").alias("like")).distinct().where("char_length(like) >= 4").withColumn("start", F.explode(starts)).withColumn("x", F.explode(deletions(F.col("start"), 1)))
    pairs = w.join(t, "x").select("term", "like", "start").distinct()
    return pairs.where(text.osa_distance(F.col("term"), F.col("start")) <= 1).select("term", "like").distinct()


def compounds(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(term, parts): splits of words of six letters or more into two or three dictionary terms of three letters or more.

    Four at most of each word: fewest parts first, then the longest shortest part.
    """
    n = F.char_length("term")
    cuts = F.transform(F.sequence(F.lit(3), n - 3), lambda i: F.array(F.expr("term").substr(F.lit(1), i), F.expr("term").substr(i + 1, n)))
    two = words.select("term").distinct().where("char_length(term) >= 6").withColumn("parts", F.explode(cuts))
    m = F.char_length(F.get("parts", F.lit(1)))
    again = F.transform(F.sequence(F.lit(3), m - 3), lambda i: F.array(F.get("parts", F.lit(0)), F.substring(F.get("parts", F.lit(1)), F.lit(1), i), F.substring(F.get("parts", F.lit(1)), i + 1, m)))
    three = two.where(m >= 6).withColumn("parts", F.explode(again))
    all_ = two.unionByName(three).withColumn("k", F.size("parts"))
    known = dictionary.select(F.col("term").alias("part")).distinct()
    hit = all_.withColumn("part", F.explode(F.array_distinct("parts"))).join(known, "part").groupBy("term", "parts", "k").agg(F.count("*").alias("n")).where(F.col("n") == F.size(F.array_distinct("parts")))
    shortest = F.array_min(F.transform("parts", F.char_length))
    best = hit.withColumn("_n", F.row_number().over(W.partitionBy("term").orderBy("k", F.desc(shortest), "parts"))).where("_n <= 4")
    return best.select("term", "parts")


class TextIndex:
    """Postings of places with weights, and the search over them. `save` and `load` keep the tables as Parquet, by term."""

    def __init__(self, places: DataFrame, context: Column | None = None, rules: Rules | None = None, ranking: Ranking = Ranking()):
        self.places, self.rules, self.ranking = places, rules or Rules(), ranking
        self.docs = cut_lineage(textindex.documents(places, context))
        self.n = self.docs.count()
        self.postings = cut_lineage(textindex.weighted(textindex.postings(self.docs), self.n))
        self.dictionary = cut_lineage(self.postings.select("field", "term").distinct())

    def _variants(self, words: DataFrame, typos: int) -> DataFrame:
        """qid, pos, field, term, w, group, need: a group's `need` terms must all be in the field. words: qid, pos, term, prefix, d, many."""
        spark, named = words.sparkSession, self.dictionary.where("field in ('name', 'exonym')").select("term").distinct()
        every = F.explode(F.array(*map(F.lit, textindex.BOOST)))
        typed = words.withColumn("field", every).select("qid", "pos", "field", "term", F.lit(1.0).alias("w"), F.lit("exact").alias("grp"), F.lit(1).alias("need"))
        out = [typed]
        asked = words.select("term").distinct()
        alts = self.rules.expand(spark, asked).withColumn("parts", F.split("alt", " "))
        alts = words.join(alts, "term").select("qid", "pos", F.col("alt").alias("grp"), "parts", F.size("parts").alias("need")).withColumn("field", every)
        out.append(alts.select("qid", "pos", "field", F.explode("parts").alias("term"), (F.lit(SYNONYM) / F.col("need")).alias("w"), "grp", "need"))
        begun = words.where("prefix").withColumn("x", F.col("term").substr(1, 12)).join(
            named.select(F.col("term").alias("like"), F.explode(text.edge_ngrams(F.array("term"))).alias("x")), "x").where(F.col("like").startswith(F.col("term")) & (F.col("like") != F.col("term")))
        out.append(begun.withColumn("field", F.explode(F.array(F.lit("name"), F.lit("exonym")))).select("qid", "pos", "field", F.col("like").alias("term"), F.lit(PREFIX).alias("w"), F.concat(F.lit("p:"), "like").alias("grp"), F.lit(1).alias("need")))
        there = self.dictionary.where("field = 'address'").select(F.col("term").alias("like"), F.explode(text.edge_ngrams(F.array("term"))).alias("x"))
        near = words.where("prefix and many and char_length(term) >= 3 and not term rlike '[0-9]'").withColumn("x", F.col("term").substr(1, 12)).join(there, "x").where(F.col("like").startswith(F.col("term")) & (F.col("like") != F.col("term")))
        out.append(near.select("qid", "pos", F.lit("address").alias("field"), F.col("like").alias("term"), F.lit(PREFIX).alias("w"), F.concat(F.lit("p:"), "like").alias("grp"), F.lit(1).alias("need")))
        split = words.join(compounds(asked, self.dictionary.where("field != 'housenumber'")), "term").withColumn("need", F.size("parts")).withColumn("field", F.explode(F.array(*(F.lit(f) for f in textindex.BOOST if f != "housenumber"))))
        out.append(split.select("qid", "pos", "field", F.explode("parts").alias("part"), (F.lit(COMPOUND) / F.col("need")).alias("w"), F.concat(F.lit("c:"), F.array_join("parts", "+")).alias("grp"), "need").withColumnRenamed("part", "term"))
        if typos:
            unknown = words.join(self.dictionary.select("term").distinct(), "term", "left_anti").unionByName(words.where("prefix")).distinct()
            unknown = unknown.withColumn("d", F.least("d", F.lit(typos))).where("d > 0")
            like = typo_terms(unknown.select("term", "d"), self.dictionary.where("field in ('name', 'exonym', 'address')"))
            wrong = unknown.join(like, ["term", "d"]).withColumn("field", F.explode(F.array(F.lit("name"), F.lit("exonym"), F.lit("address"))))
            out.append(wrong.select("qid", "pos", "field", F.col("like").alias("term"), F.lit(TYPO).alias("w"), F.concat(F.lit("t:"), "like").alias("grp"), F.lit(1).alias("need")))
            open_ = typo_prefixes(unknown.where("prefix"), named)
            out.append(unknown.where("prefix").join(open_, "term").withColumn("field", F.explode(F.array(F.lit("name"), F.lit("exonym")))).select("qid", "pos", "field", F.col("like").alias("term"), F.lit(TYPO_PREFIX).alias("w"), F.concat(F.lit("q:"), "like").alias("grp"), F.lit(1).alias("need")))
        every_ = out[0]
        for part in out[1:]:
            every_ = every_.unionByName(part.select(*every_.columns))
        return every_

    def _phase(self, words: DataFrame, requests: DataFrame, candidates: DataFrame | None, typos: int, slack: int, factor: float) -> DataFrame:
        boost = F.element_at(F.create_map(*(F.lit(x) for kv in textindex.BOOST.items() for x in kv)), F.col("field"))
        constant = F.col("grp").rlike("^[pqt]:")
        hits = self._variants(words, typos).join(self.postings.withColumnRenamed("w", "bm"), ["field", "term"])
        if candidates is not None:
            hits = hits.join(candidates.select("qid", "place_id"), ["qid", "place_id"], "left_semi")
        grouped = hits.groupBy("qid", "pos", "place_id", "field", "grp", "need").agg(F.count("*").alias("got"), F.sum(F.col("w") * boost * F.when(constant, 1.0).otherwise(F.col("bm"))).alias("s")).where("got >= need")
        by_field = grouped.groupBy("qid", "pos", "place_id", "field").agg(F.sum("s").alias("s"))
        by_word = by_field.groupBy("qid", "pos", "place_id").agg((F.max("s") + TIE * (F.sum("s") - F.max("s"))).alias("s"))
        found = by_word.groupBy("qid", "place_id").agg(F.sum("s").alias("s"), F.count("*").alias("words"))
        found = found.join(requests.select("qid", "n_words"), "qid").where((F.col("words") >= F.col("n_words") - slack) & ((F.lit(slack) == 0) | (F.col("n_words") >= 2)))
        return found.select("qid", "place_id", (F.col("s") * factor).alias("text_score"))

    def search(self, requests: DataFrame, candidates: DataFrame | None = None, layers=(), tag: Column | None = None) -> DataFrame:
        """qid, place_id, rank, score, distance. requests: qid, q, limit, autocomplete, lon, lat (null without focus).

        candidates (qid, place_id) restricts the search before anything is scored; layers too; `tag` (a condition on
        places) applies after the best candidates are fetched. Requests without a word find nothing.
        """
        asked = requests.withColumn("words", text.tokens(F.col("q"))).withColumn("n_words", F.size("words")).where("n_words > 0").withColumn("prefix", text.last_is_prefix(F.col("q"), F.col("autocomplete")))
        asked = cut_lineage(asked)
        words = asked.select("qid", "n_words", "prefix", F.posexplode("words").alias("pos", "term"))
        words = words.select("qid", "pos", "term", (F.col("prefix") & (F.col("pos") == F.col("n_words") - 1)).alias("prefix"), text.fuzzy_distance(F.col("term")).alias("d"), (F.col("n_words") > 1).alias("many"))
        words = words.withColumn("d", F.when(F.col("prefix"), F.least("d", F.lit(1))).otherwise(F.col("d")))
        if layers:
            allowed = self.places.where(F.col("layer_id").isin(list(layers))).select("place_id")
        left, found = asked, None
        for typos, slack, factor in PHASES:
            hits = self._phase(words.join(left.select("qid"), "qid", "left_semi"), left, candidates, typos, slack, factor)
            if layers:
                hits = hits.join(allowed, "place_id", "left_semi")
            hits = cut_lineage(hits)  # plans of phases stay apart
            found = hits if found is None else found.unionByName(hits)
            left = left.join(hits.select("qid").distinct(), "qid", "left_anti")
            left = cut_lineage(left)
            if left.isEmpty():
                break
        return self._ranked(asked, found, tag)

    def _ranked(self, asked: DataFrame, found: DataFrame, tag: Column | None) -> DataFrame:
        r = self.ranking
        slim = self.places.select("place_id", "importance", F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
        scored = found.join(slim, "place_id").join(asked.select("qid", "limit", "lon", "lat", "words", "prefix"), "qid")
        metres = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), geo.haversine("lon", "lat", "p_lon", "p_lat"))
        scored = scored.withColumn("distance", metres).withColumn("score", combined(F.col("text_score"), F.col("importance"), F.col("distance"), r))
        scored = scored.withColumn("_n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "place_id"))).where(F.col("_n") <= fetch_size(F.col("limit"), tag is not None))
        full = scored.select("qid", "place_id", "limit", "words", "prefix", "score", "distance").join(self.places, "place_id")
        if tag is not None:
            full = full.where(tag)
        full = full.join(self.docs.select("place_id", F.col("name").alias("name_words"), F.col("exonym").alias("exonym_words"), F.col("address").alias("context")), "place_id")
        match = F.greatest(name_match(F.col("words"), F.col("name_words"), F.col("prefix"), r), name_match(F.col("words"), F.col("exonym_words"), F.col("prefix"), r))
        echo = city_echo(F.col("words"), F.concat("name_words", "exonym_words"), F.col("context"), F.col("prefix"), r)
        full = full.withColumn("score", F.col("score") * match * echo)
        if "lines" in full.columns:  # ranked by the centre, told by the shape
            near = geo.lines_distance("q_lon", "q_lat", F.col("lines"))
            full = full.join(asked.select("qid", F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat")), "qid").withColumn("distance", F.when(F.col("distance").isNotNull(), F.coalesce(near, "distance"))).drop("q_lon", "q_lat")
        full = full.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "place_id")))
        if "housenumber" not in full.columns:
            full = full.withColumn("housenumber", F.lit(None).cast("string"))
        kept = drop_near_duplicates(full, 1 << 30)
        out = kept.withColumnRenamed("rank", "_rank").join(full.select("qid", "place_id", "score", "distance", "limit"), ["qid", "place_id"])
        return out.where(F.col("_rank") <= F.col("limit")).select("qid", "place_id", F.col("_rank").alias("rank"), "score", "distance")

"""Secret scans with corpus-wide ownership frequency; DataFrame operations only.

Candidates are found in every whole text. Their hashes are counted over the corpus by distinct owners and repositories:
a value that many owners hold is a copied example, one that a single owner holds looks live. What the fixed patterns miss,
long tokens that mix letters and digits, is reported only if one owner alone holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelake.llm.common import checkpoint

#: The patterns of the base kinds, and the least length of what each must hold.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: Long enough runs only; equal to dropping shorter matches of ACCESS and HEX, whose failures lie within one run.
LONG_ACCESS, LONG_HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
#: A necessary condition for ASSIGN with a value that is long enough.
MAYBE_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}"""
#: Added by this method, where one owner alone has the value.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ["assign", "access", "hex", "owned"]
MARK, OTHER = "\u0001", "\u0002"
SPAN = "array<struct<start:int,kind:int,end:int,hash:string,value_length:int>>"


def spans(text: Column, pattern: str, kind: int, maybe: str | None = None) -> Column:
    """Leftmost non-overlapping matches as structs in code points. Matches are set between marks and cut out: every second piece is one."""
    pieces = F.split(F.regexp_replace(F.translate(text, MARK, OTHER), f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)
    value = lambda m: F.regexp_extract(m, pattern, 2) if kind == 0 else m

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.char_length(piece)
        hit = F.struct(acc["at"].alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.sha2(value(piece), 256).alias("hash"), F.char_length(value(piece)).alias("value_length"))
        found = F.when(acc["odd"], F.concat(acc["found"], F.array(hit))).otherwise(acc["found"])
        return F.struct(end.alias("at"), (~acc["odd"]).alias("odd"), found.alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("odd"), F.expr(f"cast(array() as {SPAN})").alias("found"))
    all_ = F.aggregate(pieces, zero, step)["found"]
    kept = F.filter(all_, lambda s: s["value_length"] >= list(LEAST.values())[kind]) if kind < 3 else all_
    return F.when(F.coalesce(text.rlike(maybe or pattern), F.lit(False)), kept).otherwise(F.expr(f"cast(array() as {SPAN})"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined, by start and then kind."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(found), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame, owner: str = "owner", repository: str = "repository", live_owners: int = 1, copied_owners: int = 3) -> DataFrame:
    """One row per row of `docs` (doc_id, text, owner, repository): doc_id, n_assign, n_access, n_hex, base, all_spans, n_live, n_copied.

    `base` and `all_spans` list spans as kind:start:end. n_live counts spans whose value at most `live_owners` owners
    hold, n_copied those that `copied_owners` or more hold. Values are compared by SHA-256 and never returned. Null text
    counts as empty; a null owner or repository counts as one more. Equal rows come back each, with equal results.
    """
    text = F.col("text")
    token = F.filter(spans(text, TOKEN, 3, r"(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20}"), lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike("[0-9]") & F.substring(text, s["start"] + 1, s["end"] - s["start"]).rlike("[A-Za-z]"))
    base = F.concat(spans(text, ASSIGN, 0, MAYBE_ASSIGN), spans(text, LONG_ACCESS, 1), spans(text, LONG_HEX, 2))
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        base.alias("base"), token.alias("tokens"), F.monotonically_increasing_id().alias("id"),
    )
    apart = F.filter("tokens", lambda t: ~F.exists("base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    rows = checkpoint(rows.withColumn("more", apart).drop("tokens"))
    hits = rows.where("size(base) + size(more) > 0").select("id", "owner", "repository", F.explode(F.concat("base", "more")).alias("s"))
    hits = hits.select("id", "owner", "repository", "s", F.col("s.hash").alias("hash"))
    held = hits.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    held = held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"))
    held = held.select(F.reverse(F.reverse("hash")).alias("of"), "owners", "repositories")  # not known to be partitioned: a hot hash can be split
    told = hits.join(held, hits["hash"] == held["of"]).where((F.col("s.kind") < 3) | (F.col("owners") <= live_owners))
    per_row = told.groupBy("id").agg(
        F.collect_list("s").alias("found"), F.sum((F.col("owners") <= live_owners).cast("long")).alias("n_live"), F.sum((F.col("owners") >= copied_owners).cast("long")).alias("n_copied"),
    ).withColumnRenamed("id", "of_id")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.join(per_row, rows["id"] == per_row["of_id"], "left").select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), listed(F.col("base")).alias("base"),
        listed(F.coalesce("found", F.expr(f"cast(array() as {SPAN})"))).alias("all_spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )

"""OsmChange documents (XML), change sets, and their merge into a base of elements."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENT = "kind string, id long, lon_e7 long, lat_e7 long, refs array<long>, members array<struct<kind:string,id:long,role:string>>, tags map<string,string>"
_CHANGE = f"file string, at long, deleted boolean, {ELEMENT}"
ACTIONS = {"create": False, "modify": False, "delete": True}
KINDS = {"node": "N", "way": "W", "relation": "R"}
#: Changes of a file handed on at once.
ROWS = 20_000


class ChangeError(ValueError):
    """A change document that isn't one."""


def parse_changes(content: bytes, name: str = "") -> Iterator[dict]:
    """Elements of one OsmChange document (XML, gzipped or not) in document order: `at`, `deleted` and the columns of ELEMENT.

    Elements stand within create, modify or delete; anything else there, or an element without a number, is an error.
    """
    raw = gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    e7 = lambda v: None if v is None else int((Decimal(v) * 10_000_000).to_integral_value(ROUND_HALF_UP))
    path, at = [], 0
    try:
        for event, x in ElementTree.iterparse(raw, events=("start", "end")):
            if event == "start":
                path.append(x.tag)
                if len(path) == 1 and x.tag != "osmChange" or len(path) == 2 and x.tag not in ACTIONS or len(path) == 3 and x.tag not in KINDS:
                    raise ChangeError(f"{name}: {x.tag} at {'/'.join(path[:-1]) or 'the top'}")
                continue
            depth, action = len(path), path[1] if len(path) > 1 else None
            path.pop()
            if depth != 3:
                if depth == 2:
                    x.clear()
                continue
            members = [{"kind": (m.get("type") or "")[:1].upper(), "id": int(m.get("ref")), "role": m.get("role") or ""} for m in x.iter("member")]
            yield {
                "at": at, "deleted": ACTIONS[action], "kind": KINDS[x.tag], "id": int(x.attrib["id"]), "lon_e7": e7(x.get("lon")), "lat_e7": e7(x.get("lat")),
                "refs": [int(n.get("ref")) for n in x.iter("nd")] if x.tag == "way" else None, "members": members if x.tag == "relation" else None, "tags": [(t.get("k"), t.get("v")) for t in x.iter("tag")],
            }
            at += 1
            x.clear()
    except (ElementTree.ParseError, KeyError, TypeError, ArithmeticError) as e:
        raise ChangeError(f"{name}: {e}") from e


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    member = pa.list_(pa.struct([("kind", pa.string()), ("id", pa.int64()), ("role", pa.string())]))
    schema = pa.schema([("file", pa.string()), ("at", pa.int64()), ("deleted", pa.bool_()), ("kind", pa.string()), ("id", pa.int64()), ("lon_e7", pa.int64()), ("lat_e7", pa.int64()), ("refs", pa.list_(pa.int64())), ("members", member), ("tags", pa.map_(pa.string(), pa.string()))])
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = parse_changes(content.as_py(), name)
            while some := list(islice(found, ROWS)):
                yield pa.RecordBatch.from_pylist([{"file": name} | r for r in some], schema=schema)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Elements of OsmChange files with `seq` (file, then place in the document) and `deleted`; a file is read whole by one task, in order, and files in order of name."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(_parsed, _CHANGE)
    return rows.select(F.struct("file", "at").alias("seq"), "deleted", "kind", "id", "lon_e7", "lat_e7", "refs", "members", "tags")


def net_changes(changes: DataFrame) -> DataFrame:
    """The last change of each element (kind, id) by seq."""
    rest = [c for c in changes.columns if c not in ("kind", "id", "seq")]
    return changes.groupBy("kind", "id").agg(F.max_by(F.struct(*rest), "seq").alias("c")).select("kind", "id", *(F.col("c")[c].alias(c) for c in rest))


def check_keys(base: DataFrame) -> None:
    """A base must have each element once."""
    twice = base.groupBy("kind", "id").count().where("count > 1").first()
    if twice:
        raise ValueError(f"element {twice.kind}{twice.id} is there {twice['count']} times")


def merge(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply net changes (kind, id, deleted, ...) to a base of elements; a full outer join on (kind, id)."""
    values = [c for c in base.columns if c not in ("kind", "id")]
    b = base.select("kind", "id", F.struct(*values).alias("old"))
    c = changes.select("kind", "id", F.coalesce("deleted", F.lit(False)).alias("gone"), F.struct(*values).alias("new"))
    both = b.join(c, ["kind", "id"], "full_outer").where("not coalesce(gone, false)")
    return both.select("kind", "id", F.when(F.col("gone").isNull(), F.col("old")).otherwise(F.col("new")).alias("v")).select("kind", "id", "v.*")


def merge_stats(base: DataFrame, changes: DataFrame) -> DataFrame:
    """created, modified, deleted: what a merge does; deleting what isn't there counts for nothing."""
    b, c = base.select("kind", "id", F.lit(True).alias("there")), changes.select("kind", "id", F.coalesce("deleted", F.lit(False)).alias("gone"))
    both = c.join(b, ["kind", "id"], "left")
    n = lambda cond, name: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    return both.agg(n(~F.col("gone") & F.col("there").isNull(), "created"), n(~F.col("gone") & F.col("there").isNotNull(), "modified"), n(F.col("gone") & F.col("there").isNotNull(), "deleted"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, kind, id of elements that differ between two tables; maps are compared by sorted entries."""
    plain = lambda d: d.select("kind", "id", F.to_json(F.struct(*(F.array_sort(F.map_entries(c)).alias(c) if c == "tags" else F.col(c) for c in d.columns if c not in ("kind", "id")))).alias("v"))
    left, right = plain(a).exceptAll(plain(b)), plain(b).exceptAll(plain(a))
    return left.select(F.lit("left").alias("side"), "kind", "id").unionByName(right.select(F.lit("right").alias("side"), "kind", "id"))


def parse_state(text: str) -> tuple[int | None, str | None]:
    """Sequence number and time of a replication state file."""
    found = dict(line.split("=", 1) for line in text.splitlines() if "=" in line and not line.startswith("#"))
    seq = found.get("sequenceNumber", "").strip()
    return (int(seq) if seq.isdigit() else None), (found["timestamp"].strip().replace("\\:", ":") if "timestamp" in found else None)


def sequence_path(seq):
    """Where a replication server keeps a sequence: 4932 -> 000/004/932. For a number or a column."""
    if isinstance(seq, int):
        t = f"{seq:09d}"
        return f"{t[:3]}/{t[3:6]}/{t[6:]}"
    t = F.lpad(seq.cast("string"), 9, "0")
    return F.concat_ws("/", F.substring(t, 1, 3), F.substring(t, 4, 3), F.substring(t, 7, 3))

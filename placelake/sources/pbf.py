"""OSM PBF files: a Python data source (one partition per run of blobs), its writer, header box and truncation check."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

SCHEMA = "kind string, id long, lon_e7 long, lat_e7 long, refs array<long>, members array<struct<kind:string,id:long,role:string>>, tags map<string,string>"
KINDS = "NWR"
NANO = 1_000_000_000


class PbfError(ValueError):
    pass


# -- protocol buffers: the wire format, read and written by field number


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        wire = key & 7
        if wire == 0:
            value, at = _varint(buf, at)
        elif wire == 2:
            n, at = _varint(buf, at)
            value, at = buf[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = buf[at : at + n], at + n
        else:
            raise PbfError(f"wire type {wire}")
        yield key >> 3, value


def _packed(buf: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(buf):
        v, at = _varint(buf, at)
        out.append(_zag(v) if signed else v)
    return out


def _zag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


def _zig(v: int) -> int:
    return v << 1 if v >= 0 else (-v << 1) - 1


def _enc(v: int) -> bytes:
    out = bytearray()
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def _put(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _enc(number << 3) + _enc(value)
    return _enc(number << 3 | 2) + _enc(len(value)) + value


def _deltas(values: list[int]) -> bytes:
    return b"".join(_enc(_zig(b - a)) for a, b in zip([0, *values], values, strict=False))


# -- files


def blobs(path: str) -> list[tuple[str, int, int]]:
    """(type, offset, size) of each blob; the last must end where the file does."""
    import os

    out, end = [], os.path.getsize(path)
    with open(path, "rb") as f:
        while f.tell() < end:
            head = f.read(4)
            if len(head) < 4:
                raise PbfError(f"{path} is cut off")
            own = dict(fields(f.read(struct.unpack(">I", head)[0])))
            if 1 not in own or 3 not in own:
                raise PbfError(f"{path} is cut off")
            out.append((own[1].decode(), f.tell(), own[3]))
            f.seek(own[3], 1)
            if f.tell() > end:
                raise PbfError(f"{path} is cut off")
    return out


def _content(path: str, offset: int, size: int) -> bytes:
    with open(path, "rb") as f:
        f.seek(offset)
        own = dict(fields(f.read(size)))
    return own[1] if 1 in own else zlib.decompress(own[3])


def header(path: str) -> dict:
    """bbox in degrees (min_lon, min_lat, max_lon, max_lat) or None, replication sequence, timestamp and URL."""
    kind, offset, size = blobs(path)[0]
    if kind != "OSMHeader":
        raise PbfError("no header")
    own = dict(fields(_content(path, offset, size)))
    box = None
    if 1 in own:
        b = {k: _zag(v) / NANO for k, v in fields(own[1])}
        box = (b[1], b[4], b[2], b[3])
    return {"bbox": box, "timestamp": own.get(32), "sequence": own.get(33), "url": own[34].decode() if 34 in own else None}


def block_kinds(block: bytes) -> set[str]:
    found = set()
    for number, value in fields(block):
        if number == 2:
            found |= {"N" if n in (1, 2) else KINDS[n - 2] for n, _ in fields(value) if n in (1, 2, 3, 4)}
    return found


def elements(block: bytes, kinds: set[str]) -> Iterator[tuple]:
    own: dict[int, list] = {}
    for number, value in fields(block):
        own.setdefault(number, []).append(value)
    strings = [s.decode("utf-8", "replace") for n, s in fields(own[1][0]) if n == 1]
    grain, lat0, lon0 = own.get(17, [100])[0], own.get(19, [0])[0], own.get(20, [0])[0]
    degree = lambda v, off: (off + grain * v) // 100
    for group in own.get(2, []):
        for number, raw in fields(group):
            if number == 1 and "N" in kinds:
                e = dict(fields(raw))
                yield "N", _zag(e[1]), degree(_zag(e[9]), lon0), degree(_zag(e[8]), lat0), None, None, _tags(e, strings)
            elif number == 2 and "N" in kinds:
                yield from _dense(raw, strings, degree, lat0, lon0)
            elif number == 3 and "W" in kinds:
                e = dict(fields(raw))
                yield "W", e[1], None, None, _summed(e.get(8, b"")), None, _tags(e, strings)
            elif number == 4 and "R" in kinds:
                e = dict(fields(raw))
                members = [(KINDS[t], i, strings[r]) for r, i, t in zip(_packed(e.get(8, b"")), _summed(e.get(9, b"")), _packed(e.get(10, b"")), strict=True)]
                yield "R", e[1], None, None, None, members, _tags(e, strings)


def _summed(buf: bytes) -> list[int]:
    total, out = 0, []
    for d in _packed(buf, signed=True):
        total += d
        out.append(total)
    return out


def _tags(e: dict, strings: list[str]) -> dict[str, str]:
    return {strings[k]: strings[v] for k, v in zip(_packed(e.get(2, b"")), _packed(e.get(3, b"")), strict=True)}


def _dense(raw: bytes, strings: list[str], degree, lat0: int, lon0: int) -> Iterator[tuple]:
    e = dict(fields(raw))
    pairs = iter(_packed(e.get(10, b"")))
    for i, lat, lon in zip(_summed(e[1]), _summed(e[8]), _summed(e[9]), strict=True):
        tags = {}
        for k in pairs:
            if not k:
                break
            tags[strings[k]] = strings[next(pairs)]
        yield "N", i, degree(lon, lon0), degree(lat, lat0), None, None, tags


class _Run(InputPartition):
    def __init__(self, path: str, spans: list[tuple[int, int]]):
        self.path, self.spans = path, spans


class PbfReader(DataSourceReader):
    """A predicate on kind skips blocks of other kinds without parsing their elements."""

    def __init__(self, path: str, per_task: int):
        self.path, self.per_task, self.kinds = path, per_task, set(KINDS)

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self.kinds &= {f.value}
            elif isinstance(f, In) and f.attribute == ("kind",):
                self.kinds &= set(f.value)
            yield f  # rows are still tested

    def partitions(self):
        data = [(o, n) for kind, o, n in blobs(self.path) if kind == "OSMData"]
        return [_Run(self.path, data[k : k + self.per_task]) for k in range(0, len(data), self.per_task)]

    def read(self, part):
        for offset, size in part.spans:
            block = _content(part.path, offset, size)
            if self.kinds & block_kinds(block):
                yield from elements(block, self.kinds)


class PbfSource(DataSource):
    """spark.read.format("osm_pbf").load(path): all elements. Make it known with register(spark)."""

    @classmethod
    def name(cls):
        return "osm_pbf"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return PbfReader(self.options["path"], int(self.options.get("blobs", 8)))


def register(spark) -> None:
    """Make the source known; predicates on kind reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PbfSource)


# -- writing


def _blob(kind: str, content: bytes) -> bytes:
    blob = _put(2, len(content)) + _put(3, zlib.compress(content))
    head = _put(1, kind.encode()) + _put(3, len(blob))
    return struct.pack(">I", len(head)) + head + blob


def header_block(bbox: tuple[float, float, float, float] | None = None, sequence: int | None = None, timestamp: int | None = None, url: str | None = None) -> bytes:
    out = b""
    if bbox:
        low_lon, low_lat, high_lon, high_lat = (_zig(round(v * NANO)) for v in bbox)
        out += _put(1, _put(1, low_lon) + _put(2, high_lon) + _put(3, high_lat) + _put(4, low_lat))
    out += _put(4, b"OsmSchema-V0.6") + _put(4, b"DenseNodes")
    for number, value in ((32, timestamp), (33, sequence), (34, url.encode() if url else None)):
        out += _put(number, value) if value is not None else b""
    return _blob("OSMHeader", out)


def primitive_block(rows: list) -> bytes:
    """One block of elements of one kind, in order of id."""
    table: dict[str, int] = {"": 0}
    at = lambda s: table.setdefault(s, len(table))
    tags = lambda e: _put(2, b"".join(_enc(at(k)) for k in e.tags or {})) + _put(3, b"".join(_enc(at(v)) for v in (e.tags or {}).values()))
    group = b""
    if rows[0].kind == "N":
        pairs = b"".join(b"".join(_enc(at(k)) + _enc(at(v)) for k, v in (e.tags or {}).items()) + b"\0" for e in rows)
        group = _put(2, _put(1, _deltas([e.id for e in rows])) + _put(8, _deltas([e.lat_e7 for e in rows])) + _put(9, _deltas([e.lon_e7 for e in rows])) + _put(10, pairs))
    for e in rows if rows[0].kind != "N" else []:
        own = _put(1, e.id) + tags(e)
        if e.kind == "W":
            group += _put(3, own + _put(8, _deltas(list(e.refs or []))))
        else:
            m = list(e.members or [])
            group += _put(4, own + _put(8, b"".join(_enc(at(x.role or "")) for x in m)) + _put(9, _deltas([x.id for x in m])) + _put(10, b"".join(_enc(KINDS.index(x.kind)) for x in m)))
    strings = b"".join(_put(1, s.encode()) for s in table)
    return _blob("OSMData", _put(1, strings) + _put(2, group))


def write_pbf(df, path: str, block: int = 8000, **head) -> None:
    """Write elements as one file, nodes, ways, relations, each by id. Rows stream through the driver, a partition at a time."""
    import os

    rows = df.withColumn("_k", df["kind"].substr(1, 1)).selectExpr("*", "case _k when 'N' then 0 when 'W' then 1 else 2 end as _o").orderBy("_o", "id").drop("_k", "_o").toLocalIterator(prefetchPartitions=True)
    tmp, held = f"{path}.tmp", []
    with open(tmp, "wb") as f:
        f.write(header_block(**head))
        for r in rows:
            if held and (len(held) >= block or held[0].kind != r.kind):
                f.write(primitive_block(held))
                held = []
            held.append(r)
        if held:
            f.write(primitive_block(held))
    os.replace(tmp, path)

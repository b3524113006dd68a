"""Manifests of packages as rows of events; trees and texts are made of them by windows and ordered aggregation."""

import struct
import xml.parsers.expat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from appcorpus.functions.names import xml_escape
from appcorpus.shipping import ship
from appcorpus.sources.archives import each_entry, payload_of, spread
from appcorpus.sources.packages import BROKEN

NAME = "AndroidManifest.xml"
MAX_DEPTH = 1_000
#: Events in document order. kind: start, end and cdata; document: a text manifest, as it is; error: nothing of it counts;
#: malformed: a text manifest whose nodes don't count.
DDL = "path string, position long, kind string, tag string, text string, attrs array<struct<name:string,value:string>>"
_ATTRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
_SCHEMA = pa.schema([("path", pa.string()), ("position", pa.int64()), ("kind", pa.string()), ("tag", pa.string()), ("text", pa.string()), ("attrs", _ATTRS)])
_CHUNK = 20_000

# Chunk types of binary XML, the missing string, units of complex values, how text is written.
_POOL, _DOCUMENT, _MAP, _NAMESPACE, _START, _END, _CDATA = 0x0001, 0x0003, 0x0180, 0x0100, 0x0102, 0x0103, 0x0104
_NONE = 0xFFFFFFFF
_DIMENSIONS = ["px", "dip", "sp", "pt", "in", "mm"]
_FRACTIONS = ["%", "%p"]
_RADIX = [0, 7, 15, 23]
_HEADER = '<?xml version="1.0" encoding="utf-8"?>'
_CDATA_SPLIT = ("]]>", "]] ]]><![CDATA[>")


# Ids of the platform's attributes that manifests use most.
ATTRIBUTES = {
    0x01010000: "theme", 0x01010001: "label", 0x01010002: "icon", 0x01010003: "name", 0x01010006: "permission", 0x01010009: "protectionLevel", 0x0101000C: "hasCode",
    0x0101000E: "enabled", 0x0101000F: "debuggable", 0x01010010: "exported", 0x01010011: "process", 0x01010012: "taskAffinity", 0x01010018: "authorities", 0x0101001D: "launchMode",
    0x0101001E: "screenOrientation", 0x0101001F: "configChanges", 0x01010024: "value", 0x01010025: "resource", 0x01010026: "mimeType", 0x01010027: "scheme", 0x01010028: "host",
    0x01010029: "port", 0x0101002A: "path", 0x0101002B: "pathPrefix", 0x0101002C: "pathPattern", 0x0101020C: "minSdkVersion", 0x0101021B: "versionCode", 0x0101021C: "versionName",
    0x01010270: "targetSdkVersion", 0x01010280: "allowBackup",
}


def _chunk(data: bytes, at: int) -> tuple[int, int, int]:
    kind, head, size = struct.unpack_from("<HHI", data, at)
    if size < 8 or at + size > len(data):
        raise ValueError(f"chunk at {at} leaves the manifest")
    return kind, head, size


class _Strings:
    """The string pool; a string is decoded when it is asked for."""

    def __init__(self, data: bytes, at: int, size: int):
        count, styles, flags, first = struct.unpack_from("<4I", data, at + 8)
        if styles or size < 28 or count * 4 > size - 28 or not 28 <= first <= size:
            raise ValueError("malformed string pool")
        self.data, self.base, self.end, self.wide = data, at + first, at + size, not flags & 0x100
        self.offsets = struct.unpack_from(f"<{count}I", data, at + 28)

    def _length(self, at: int) -> tuple[int, int]:
        if self.wide:
            high, low = struct.unpack_from("<HH", self.data, at)
            return (high, at + 2) if high < 0x8000 else ((high & 0x7FFF) << 16 | low, at + 4)
        high = self.data[at]
        return (high, at + 1) if high < 0x80 else ((high & 0x7F) << 8 | self.data[at + 1], at + 2)

    def __getitem__(self, k: int) -> str:
        if k == _NONE:
            return ""
        length, at = self._length(self.base + self.offsets[k])
        if not self.wide:
            length, at = self._length(at)
        end = at + (2 * length if self.wide else length)
        if end > self.end:
            raise ValueError("string leaves the pool")
        return self.data[at:end].decode("utf-16-le" if self.wide else "utf-8")


def _complex(value: int) -> float:
    mantissa = (value >> 8) - (1 << 24 if value >> 31 else 0)
    return mantissa / (1 << _RADIX[value >> 4 & 3])


def typed_value(kind: int, value: int, strings) -> str:
    """The text of a typed value; kinds without a form of their own are written out as number and kind."""
    place, unit = "android:" if value >> 24 == 1 else "", value & 15
    if kind == 0x03:
        return strings[value]
    if kind in (0x01, 0x02):
        return f"{'@?'[kind - 1]}{place}{value:08X}"
    if kind == 0x04:
        return f"{struct.unpack('<f', struct.pack('<I', value))[0]:f}"
    if kind == 0x05 and unit < len(_DIMENSIONS):
        return f"{_complex(value):f}{_DIMENSIONS[unit]}"
    if kind == 0x06 and unit < len(_FRACTIONS):
        return f"{_complex(value) * 100:f}{_FRACTIONS[unit]}"
    if kind == 0x10:
        return str(value - (1 << 32 if value >> 31 else 0))
    if kind == 0x11:
        return f"0x{value:08X}"
    if kind == 0x12:
        return "true" if value else "false"
    if 0x1C <= kind <= 0x1F:
        return f"#{value:08X}"
    return f"<0x{value:X}, type 0x{kind:02X}>"


def _attribute(number: int) -> str:
    """The name of an attribute of which a manifest keeps the resource id only."""
    return ATTRIBUTES.get(number, f"attr_{number:08X}")


class _Depth:
    """How many elements are open; the root is closed once."""

    def __init__(self):
        self.open, self.done = 0, False

    def start(self, tag: str) -> None:
        if not tag:
            raise ValueError("empty element name")
        self.inside()
        self.open += 1

    def inside(self) -> None:
        if self.open >= MAX_DEPTH:
            raise ValueError("elements are nested too deep")

    def end(self) -> None:
        if not self.open:
            raise ValueError("an element ends that didn't begin")
        self.open -= 1
        self.done = not self.open


def _binary(data: bytes) -> Iterator[dict]:
    kind, at, end = _chunk(data, 0)
    pool, _, size = _chunk(data, at)
    if kind != _DOCUMENT or pool != _POOL:
        raise ValueError("no document with a string pool")
    strings = _Strings(data, at, size)
    at += size
    kind, _, size = _chunk(data, at)
    if kind != _MAP or size % 4:
        raise ValueError("no resource map after the string pool")
    ids = struct.unpack_from(f"<{(size - 8) // 4}I", data, at + 8)
    at += size
    depth, prefixes, declared = _Depth(), {}, []
    while at < end and not depth.done:
        kind, head, size = _chunk(data, at)
        body = at + head
        if kind == _NAMESPACE:
            prefix, uri = struct.unpack_from("<2I", data, body)
            prefixes[uri] = strings[prefix]
            declared.append((f"xmlns:{strings[prefix]}", strings[uri]))
        elif kind == _START:
            _, name, first, width, count = struct.unpack_from("<2I3H", data, body)
            attrs, declared = declared, []
            for k in range(count):
                space, own, _, _, _, value_kind, value = struct.unpack_from("<3IHBBI", data, body + first + k * width)
                prefix = f"{prefixes[space]}:" if prefixes.get(space) else ""
                name_of = strings[own] or (_attribute(ids[own]) if own < len(ids) else "")
                attrs.append((prefix + name_of, typed_value(value_kind, value, strings)))
            depth.start(strings[name])
            yield {"kind": "start", "tag": strings[name], "attrs": [{"name": k, "value": v} for k, v in attrs]}
        elif kind == _CDATA and depth.open:
            depth.inside()
            yield {"kind": "cdata", "text": strings[struct.unpack_from("<I", data, body)[0]]}
        elif kind == _END:
            depth.end()
            yield {"kind": "end"}
        at += size
    if not depth.done:
        raise ValueError("no whole root element")


def _plain(text: str) -> list[dict]:
    out, depth, parser = [], _Depth(), xml.parsers.expat.ParserCreate()

    def start(tag: str, attrs: list[str]) -> None:
        depth.start(tag)
        out.append({"kind": "start", "tag": tag, "attrs": [{"name": k, "value": v} for k, v in zip(attrs[::2], attrs[1::2])]})

    def end(_: str) -> None:
        depth.end()
        out.append({"kind": "end"})

    def said(text: str) -> None:
        if text.strip():
            depth.inside()
            out.append({"kind": "cdata", "text": text})

    parser.ordered_attributes = parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, said
    parser.Parse(text, True)
    return out


def events(data: bytes) -> Iterator[dict]:
    """Events of one manifest. A text manifest stays as it is even where its nodes can't be read; binary XML is whole or an error."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text = ""
    try:
        if not text.lstrip().startswith("<"):
            yield from _binary(data)
            return
        yield {"kind": "document", "text": text}
        yield from _plain(text)
    except xml.parsers.expat.ExpatError as problem:
        yield {"kind": "malformed", "text": str(problem)}
    except BROKEN as problem:
        yield {"kind": "malformed" if text.lstrip().startswith("<") else "error", "text": str(problem)}


def _batches(rows: Iterator[tuple[str, Iterator[dict]]]) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for path, own in rows:
        for position, event in enumerate(own):
            held.append({"path": path, "position": position, **event})
            if len(held) == _CHUNK:
                yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)


def events_of(rows: DataFrame) -> DataFrame:
    """Events of (path, content), the content being a manifest's bytes."""
    ship(rows.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((path.as_py(), events(content.as_py() or b"")) for batch in batches for path, content in zip(batch.column(0), batch.column(1)))

    return rows.select("path", "content").mapInArrow(read, DDL)


def manifest_events(entries: DataFrame) -> DataFrame:
    """Events of the last manifest entry of each file (see `archives.list_entries`), read by its range alone; a file that can't be read is one error."""
    named = entries.where((F.col("name") == NAME) & (F.col("kind") == "archive"))
    last = named.groupBy("path").agg(F.max_by(F.struct("entry_index", "name", "compression", "compressed_size", "uncompressed_size", "header_offset"), "entry_index").alias("e")).select("path", "e.*")

    def one(row: dict, file: pa.NativeFile) -> tuple[str, Iterator[dict]]:
        try:
            return row["path"], events(payload_of(row, file))
        except ValueError as problem:
            return row["path"], iter([{"kind": "error", "text": str(problem)}])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(each_entry(batches, one))

    bad = entries.where("error is not null").select("path", F.lit(0).cast("long").alias("position"), F.lit("error").alias("kind"), F.lit(None).cast("string").alias("tag"), F.col("error").alias("text"))
    return spread(last).mapInArrow(read, DDL).unionByName(bad, allowMissingColumns=True)


def _leveled(found: DataFrame) -> DataFrame:
    """Good files' events with `depth`, `node_id` of those that begin a node, and `inside`: whether anything stands between a start and its end."""
    order = Window.partitionBy("path").orderBy("position")
    kind = F.col("kind")
    step = F.when(kind == "start", 1).when(kind == "end", -1).otherwise(0)
    dropped = F.max(kind.isin("error", "malformed")).over(Window.partitionBy("path"))
    node = F.when(kind.isin("start", "cdata"), F.sum(kind.isin("start", "cdata").cast("long")).over(order) - 1)
    out = found.withColumns({"_dropped": dropped, "depth": F.sum(step).over(order) - F.when(kind == "start", 1).otherwise(0), "node_id": node, "inside": F.lead("kind").over(order) != "end"})
    return out.where(~F.col("_dropped") & kind.isin("start", "end", "cdata")).drop("_dropped")


def _with_opener(leveled: DataFrame) -> DataFrame:
    """With `opener`: of a node the element around it, of an end its own start, as struct<node_id, tag, inside>: the last start one level up, or of the same level."""
    start = F.struct("node_id", "tag", "inside")
    seats = F.array(F.struct((F.col("depth") + F.when(F.col("kind") == "end", 1).otherwise(0)).alias("level"), F.lit(True).alias("own"), F.lit(None).cast("struct<node_id:long,tag:string,inside:boolean>").alias("start")))
    seats = F.when(F.col("kind") == "start", F.concat(seats, F.array(F.struct((F.col("depth") + 1).alias("level"), F.lit(False).alias("own"), start.alias("start"))))).otherwise(seats)
    seated = leveled.withColumn("_s", F.explode(seats)).withColumn("_level", F.col("_s.level"))
    before = Window.partitionBy("path", "_level").orderBy("position", "_s.own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return seated.withColumn("opener", F.last("_s.start", ignorenulls=True).over(before)).where("_s.own").drop("_s", "_level")


def manifest_nodes(found: DataFrame) -> DataFrame:
    """(path, node_id, parent_id, depth, tag, text, attrs): one row for each element or CDATA of events, in document order."""
    nodes = _with_opener(_leveled(found)).where("kind <> 'end'")
    return nodes.select("path", "node_id", F.col("opener.node_id").alias("parent_id"), F.col("depth").cast("long").alias("depth"), "tag", "text", F.coalesce("attrs", F.array().cast(DDL.rpartition("attrs ")[2])).alias("attrs"))


def _line(pad: Column) -> Column:
    """An event's line; none for the end of an element that holds nothing."""
    attrs = F.array_join(F.transform(F.coalesce("attrs", F.array().cast(DDL.rpartition("attrs ")[2])), lambda a: F.concat(F.lit(" "), a["name"], F.lit('="'), xml_escape(a["value"], True), F.lit('"'))), "")
    start = F.concat(pad, F.lit("<"), "tag", attrs, F.when(F.col("inside"), ">").otherwise(" />"))
    said = F.concat(pad, F.lit("<![CDATA["), F.replace("text", F.lit(_CDATA_SPLIT[0]), F.lit(_CDATA_SPLIT[1])), F.lit("]]>"))
    end = F.when(F.col("opener.inside"), F.concat(pad, F.lit("</"), "opener.tag", F.lit(">")))
    return F.when(F.col("kind") == "start", start).when(F.col("kind") == "cdata", said).otherwise(end)


def manifests(found: DataFrame) -> DataFrame:
    """(path, xml, error) of events: text manifests as they are, binary ones as text of four spaces a level; what can't be read has an error."""
    lines = _with_opener(_leveled(found)).withColumn("line", _line(F.repeat(F.lit("    "), F.col("depth").cast("int")))).where("line is not null")
    body = lines.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("body"))
    first = lambda *kinds: F.max(F.when(F.col("kind").isin(*kinds), F.col("text")))
    each = found.groupBy("path").agg(first("document").alias("document"), first("error", "malformed").alias("error"))
    return each.join(body, "path", "left").select("path", F.coalesce("document", F.concat(F.lit(_HEADER + "\n"), "body")).alias("xml"), "error")


def attributes(nodes: DataFrame, tag: str, name: str) -> DataFrame:
    """(path, value) of one attribute of all elements of a tag: permissions, activities and the like."""
    own = nodes.where(F.col("tag") == tag).select("path", F.explode("attrs").alias("a"))
    return own.where(F.col("a.name") == name).select("path", "a.value")

"""Packages as bytes to catalog tables: one pass, one row for each fact.

A task holds one package and the facts of one DEX image, as columns, at a time. What can't be read gives a row with `error`, and
nothing else of that image; good files are not held up by bad ones.
"""

import io
import struct
import zipfile
import zlib
from collections.abc import Collection, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appcorpus.shipping import ship
from appcorpus.sources.dex import FACT, Block, Image, columns, members_of

MAX_ENTRY_BYTES = 256 << 20
MAX_ENTRIES = 100_000
_CHUNK = 20_000
NO_IMAGE = "no DEX in the root"
TOO_LARGE = "file over the size limit"
_FACT = pa.schema([("path", pa.string()), ("entry_index", pa.int64()), ("logical_index", pa.int64()), ("dex_id", pa.string()), *FACT])
FACT_DDL = "path string, entry_index long, logical_index long, dex_id string, fact string, idx long, sub long, a string, b string, c string, n long, m long, items array<string>, json string, error string"
BROKEN = (ValueError, IndexError, struct.error, zlib.error, zipfile.BadZipFile, NotImplementedError)

#: Catalog tables as projections of facts: columns beside the key, by fact.
TABLES = {
    "header": ["a as version", "n as file_size", "m = 1 as checksum_ok"],
    "entry": ["idx as entry_index", "a as name", "sub as compression", "m as compressed_size", "n as uncompressed_size"],
    "string": ["idx as string_index", "a as value"],
    "type": ["idx as type_index", "a as descriptor"],
    "proto": ["idx as proto_index", "a as proto"],
    "field": ["idx as field_index", "a as owner", "b as name", "c as type"],
    "method": ["idx as method_index", "a as owner", "b as name", "c as proto"],
    "class": ["idx as class_def_idx", "sub as type_index", "a as descriptor", "n as access_flags", "b as superclass", "items as interfaces", "c as source_file"],
    "member": ["idx as class_def_idx", "a as kind", "sub as ordinal", "n as member_index", "b as name", "c as type_or_proto", "m as access_flags"],
    "annotation": ["idx as class_def_idx", "a as target_kind", "sub as target_index", "n as parameter", "m as ordinal", "b as visibility", "c as type", "items as elements", "parse_json(json) as values"],
    "static": ["idx as class_def_idx", "sub as ordinal", "a as tag", "b as value", "parse_json(json) as typed"],
    "ref": ["idx as method_index", "sub as pc", "m as opcode", "a as ref_kind", "n as target_index"],
    "try": ["idx as method_index", "sub as start_addr", "n as end_addr", "cast(b as int) as handler_order", "a as catch_type", "m as handler_addr"],
    "error": ["error"],
}


def read_packages(spark: SparkSession, path: str, max_bytes: int = (2 << 30) - 1) -> DataFrame:
    """Files as (path, modificationTime, length, content). Larger ones are never loaded: their content is null, which `facts` turns into an error row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.where(F.col("length") > max_bytes).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") <= max_bytes).unionByName(large)


def scan(packages: DataFrame) -> DataFrame:
    """packages with `kind`: dex by its magic, else archive."""
    bare = F.hex(F.substring("content", 1, 8)).rlike("^6465780A(3[0-9]){3}00$")
    return packages.withColumn("kind", F.when(bare, "dex").otherwise("archive"))


def is_dex(head: bytes) -> bool:
    return head[:4] == b"dex\n" and head[4:7].isdigit() and head[7:8] == b"\0"


def _entries(content: bytes) -> list[zipfile.ZipInfo]:
    if is_dex(content):
        bare = zipfile.ZipInfo("classes.dex")
        bare.file_size = bare.compress_size = len(content)
        bare.header_offset = -1
        return [bare]
    found = zipfile.ZipFile(io.BytesIO(content)).infolist()
    if len(found) > MAX_ENTRIES:
        raise ValueError("too many entries")
    return found


def _inflate(content: bytes, entry: zipfile.ZipInfo) -> bytes:
    if entry.header_offset < 0:
        return content
    if entry.file_size > MAX_ENTRY_BYTES:
        raise ValueError("entry over the size limit")
    at = entry.header_offset
    if content[at : at + 4] != b"PK\x03\x04":
        raise ValueError("no local header")
    name, extra = struct.unpack_from("<HH", content, at + 26)
    at += 30 + name + extra
    raw = content[at : at + entry.compress_size]
    if entry.compress_type == zipfile.ZIP_DEFLATED:
        raw = zlib.decompressobj(-15).decompress(raw, entry.file_size + 1)
    elif entry.compress_type != zipfile.ZIP_STORED:
        raise ValueError(f"compression {entry.compress_type}")
    if len(raw) != entry.file_size:
        raise ValueError("size differs from the directory's")
    return raw


def _root_images(entries: list[zipfile.ZipInfo]) -> list[int]:
    """classes*.dex in the root, or else any .dex there; of equal names the first."""
    root = {}
    for k, entry in enumerate(entries):
        if "/" not in entry.filename and entry.filename.endswith(".dex"):
            root.setdefault(entry.filename, k)
    return [k for name, k in root.items() if name.startswith("classes")] or list(root.values())


#: Path, entry_index, logical_index and dex_id, then facts of one kind.
Keyed = tuple[tuple, Block]


def no_facts(path: str, problem: str, entry_index: int | None = None, dex_id: str | None = None, logical_index: int | None = None) -> Keyed:
    return (path, entry_index, logical_index, dex_id), ("error", 1, {"error": [problem]})


def image_blocks(path: str, entry_index: int, name: str, data: bytes, only: Collection[str] | None = None) -> list[Keyed]:
    """Facts of the images in an entry's bytes, with `only` those kinds; an image that can't be read is one error row, with nothing else of it."""
    try:
        bases = members_of(data)
    except BROKEN as problem:
        return [no_facts(path, str(problem), entry_index, name)]
    out = []
    for number, base in enumerate(bases):
        own = name if len(bases) == 1 else f"{name}!classes{number + 1}.dex"
        try:
            out += [((path, entry_index, number, own), block) for block in list(Image(data, base).blocks(only))]
        except BROKEN as problem:
            out.append(no_facts(path, str(problem), entry_index, own, number))
    return out


def _table(key: tuple, block: Block) -> pa.Table:
    fact, size, of = block
    own = [pa.repeat(pa.scalar(value, f.type), size) for f, value in zip(_FACT, key)]
    return pa.Table.from_arrays([*own, *columns(fact, size, **of).columns], schema=_FACT)


def image_facts(path: str, entry_index: int, name: str, data: bytes, only: Collection[str] | None = None) -> pa.Table:
    """The blocks as one table."""
    return pa.concat_tables([_FACT.empty_table(), *(_table(*block) for block in image_blocks(path, entry_index, name, data, only))])


def _package_blocks(path: str, content: bytes | None) -> Iterator[Keyed]:
    if content is None:
        yield no_facts(path, TOO_LARGE)
        return
    try:
        entries = _entries(content)
    except BROKEN as problem:
        yield no_facts(path, str(problem))
        return
    of = {"idx": range(len(entries)), "a": [e.filename for e in entries], "sub": [e.compress_type for e in entries], "m": [e.compress_size for e in entries], "n": [e.file_size for e in entries]}
    yield (path, None, None, None), ("entry", len(entries), of)
    images = _root_images(entries)
    if not images:
        yield no_facts(path, NO_IMAGE)
    for k in images:
        try:
            data = _inflate(content, entries[k])
        except BROKEN as problem:
            yield no_facts(path, str(problem), k, entries[k].filename)
            continue
        yield from image_blocks(path, k, entries[k].filename, data)


def batches_of(blocks: Iterable[Keyed]) -> Iterator[pa.RecordBatch]:
    """Small blocks together, as lists first, since columns of their own would cost more than their rows; large ones in pieces."""
    held, rows = {f.name: [] for f in _FACT}, 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) for f in _FACT], schema=_FACT)

    for key, (fact, size, of) in blocks:
        if size >= _CHUNK // 10:
            yield from _table(key, (fact, size, of)).combine_chunks().to_batches(_CHUNK)
            continue
        known = {**dict(zip(held, key)), "fact": fact}
        for name, column in held.items():
            own = of.get(name)
            column.extend(repeat(known.get(name), size) if own is None else own.tolist() if isinstance(own, np.ndarray | pa.Array) else own)
        rows += size
        if rows >= _CHUNK:
            yield out()
            held, rows = {f.name: [] for f in _FACT}, 0
    if rows:
        yield out()


def facts(packages: DataFrame) -> DataFrame:
    """All facts of (path, content), for packages that are there as bytes; files are better read by `sources.archives`."""
    ship(packages.sparkSession)

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                yield from batches_of(_package_blocks(path.as_py(), content.as_py()))

    return packages.select("path", "content").mapInArrow(read, FACT_DDL)


def table(found: DataFrame, fact: str) -> DataFrame:
    """A catalog table of facts, with its key."""
    key = ["path"] if fact == "entry" else ["path", "entry_index", "logical_index", "dex_id"]
    return found.where(F.col("fact") == fact).selectExpr(*key, *TABLES[fact])


def write_catalog(found: DataFrame, path: str) -> None:
    """Facts on disk, in one pass over the bytes, partitioned by kind, so that later queries read only theirs."""
    found.write.partitionBy("fact").mode("overwrite").parquet(path)

"""Package files read by ranges: first each archive's directory, then single entries, each in a task of its own.

No row and no task ever holds a package. Files are listed by Spark and opened where the task runs, through Arrow's file
systems (local, HDFS, S3, GCS). For stores that only Spark can open, `sources.packages.facts` takes (path, content) rows.
"""

import hashlib
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Collection, Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from appcorpus.shared import stored
from appcorpus.shipping import ship
from appcorpus.sources.packages import BROKEN, FACT_DDL, Keyed, MAX_ENTRIES, MAX_ENTRY_BYTES, NO_IMAGE, TOO_LARGE, batches_of, image_blocks, is_dex, no_facts

#: Bytes of entries that one task is to read, about, and entries, however small.
TASK_BYTES, TASK_ENTRIES = 32 << 20, 2_000
#: Splits of Spark's file listing whose directories one task reads.
SPLITS_OF_TASK = 16
MAX_DIRECTORY_BYTES = 64 << 20
_ENTRY = pa.schema([("path", pa.string()), ("kind", pa.string()), ("entry_index", pa.int64()), ("name", pa.string()), ("compression", pa.int64()), ("compressed_size", pa.int64()), ("uncompressed_size", pa.int64()), ("header_offset", pa.int64()), ("error", pa.string())])
ENTRY_DDL = "path string, kind string, entry_index long, name string, compression long, compressed_size long, uncompressed_size long, header_offset long, error string"
_VERDICT = pa.schema([("path", pa.string()), ("entry_index", pa.int64()), ("sha256", pa.string()), ("size", pa.int64()), ("verdict", pa.string())])


class WrongPayload(ValueError):
    """Its text is the verdict."""


def opened(path: str) -> pa.NativeFile:
    """A file for random access; Spark writes local paths with one slash behind the scheme."""
    system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return system.open_input_file(name)


def _directory(path: str, length: int, max_bytes: int) -> list[dict]:
    if length > max_bytes:
        return [{"path": path, "error": TOO_LARGE}]
    try:
        with opened(path) as file:
            if is_dex(file.read(8)):
                return [{"path": path, "kind": "dex", "entry_index": 0, "name": "classes.dex", "compression": 0, "compressed_size": length, "uncompressed_size": length, "header_offset": -1}]
            # Arrow's files refuse places before the start, which small archives are tried for
            archive = zipfile.ZipFile(io.BytesIO(file.read_at(length, 0)) if length < 1 << 12 else file)
            if len(archive.filelist) > MAX_ENTRIES or length - archive.start_dir > MAX_DIRECTORY_BYTES:
                raise ValueError("too many entries")
            own = lambda k, e: {"path": path, "kind": "archive", "entry_index": k, "name": e.filename, "compression": e.compress_type, "compressed_size": e.compress_size, "uncompressed_size": e.file_size, "header_offset": e.header_offset}
            return [own(k, e) for k, e in enumerate(archive.filelist)] or [{"path": path, "kind": "archive"}]
    except (*BROKEN, OSError) as problem:
        return [{"path": path, "kind": "archive", "error": str(problem)}]


def list_entries(spark: SparkSession, path: str, max_bytes: int = (2 << 30) - 1) -> DataFrame:
    """Every entry of every file below the path, in directory order, repeated names too; a bare image is one stored entry.

    Only directories are read. A file that has none that can be read, or is over the size limit, is one row with `error`; an
    archive without entries is one row without an entry. Files of no bytes are left out by Spark's listing.
    """
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = ((path, length) for batch in batches for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        yield from batched((row for path, length in listed for row in _directory(path, length, max_bytes)), _ENTRY)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    # Spark's splits count a file as 4 MB at least, of which only the directory is read here
    tasks = max(spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // SPLITS_OF_TASK)
    return stored(files.coalesce(tasks).mapInArrow(read, ENTRY_DDL))


def batched(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, 2_000)):
        yield from pa.Table.from_pylist(some, schema).to_batches()


def payload(file: pa.NativeFile, compression: int, compressed: int, size: int, offset: int) -> bytes:
    """An entry's bytes, stored or deflated, by one ranged read; what isn't as the directory says is a WrongPayload."""
    if size > MAX_ENTRY_BYTES or compressed > MAX_ENTRY_BYTES:
        raise WrongPayload("over the size limit")
    if offset < 0:
        return file.read_at(size, 0)
    if compression not in (0, 8):
        raise WrongPayload("unsupported method")
    head = file.read_at(30, offset)
    if head[:4] != b"PK\x03\x04" or len(head) < 30:
        raise WrongPayload("no local header")
    raw = file.read_at(compressed, offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    if len(raw) < compressed:
        raise WrongPayload("truncated")
    if compression == 8:
        inflater = zlib.decompressobj(-15)
        try:
            raw = inflater.decompress(raw, size + 1)
        except zlib.error:
            raise WrongPayload("damaged") from None
        if len(raw) < size and not inflater.eof:
            raise WrongPayload("truncated")
    if len(raw) != size:
        raise WrongPayload("size differs")
    return raw


def spread(entries: DataFrame) -> DataFrame:
    """Entries dealt out so that a task reads about TASK_BYTES, whatever file they are in."""
    spark = entries.sparkSession
    found = entries.agg(F.count("*").alias("n"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(found.n, max(spark.sparkContext.defaultParallelism, -(-int(found.bytes) // TASK_BYTES), -(-found.n // TASK_ENTRIES))))
    return entries.repartition(tasks)


def each_entry(batches: Iterator[pa.RecordBatch], take) -> Iterator:
    """take(row, file) for each entry; a file stays open while its entries follow each other."""
    path, file = None, None
    try:
        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != path:
                    if file is not None:
                        file.close()
                    path, file = row["path"], opened(row["path"])
                yield take(row, file)
    finally:
        if file is not None:
            file.close()


_READ = ["path", "entry_index", "name", "compression", "compressed_size", "uncompressed_size", "header_offset"]


def payload_of(row: dict, file: pa.NativeFile) -> bytes:
    return payload(file, row["compression"], row["compressed_size"], row["uncompressed_size"], row["header_offset"])


def verdicts(entries: DataFrame) -> DataFrame:
    """(path, entry_index, name, sha256, size, verdict) of each entry; the verdict is ok or what is wrong, and then size and digest are null."""

    def one(row: dict, file: pa.NativeFile) -> dict:
        try:
            data = payload_of(row, file)
        except WrongPayload as problem:
            return {"path": row["path"], "entry_index": row["entry_index"], "verdict": str(problem)}
        return {"path": row["path"], "entry_index": row["entry_index"], "sha256": hashlib.sha256(data).hexdigest(), "size": len(data), "verdict": "ok"}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(each_entry(batches, one), _VERDICT)

    known = entries.where("entry_index is not null")
    out = spread(known.select(*_READ)).mapInArrow(read, "path string, entry_index long, sha256 string, size long, verdict string")
    return out.join(known.select("path", "entry_index", "name"), ["path", "entry_index"])


def root_images(entries: DataFrame) -> DataFrame:
    """classes*.dex in the root of each file, or else any .dex there; of equal names the first."""
    root = entries.where(F.col("name").endswith(".dex") & ~F.contains("name", F.lit("/")))
    named = F.col("name").startswith("classes")
    # dealt out by path, which serves both windows: directories are read and shuffled once
    asked = root.withColumn("any_named", F.max(named).over(Window.partitionBy("path"))).where(named | ~F.col("any_named"))
    first = asked.withColumn("first", F.min("entry_index").over(Window.partitionBy("path", "name")))
    return first.where(F.col("entry_index") == F.col("first")).select(*root.columns)


def read_facts(entries: DataFrame, only: Collection[str] | None = None) -> DataFrame:
    """All facts of the files that the entries are of; each image is read by its own range. Bad files and images are error rows.

    only: kinds of an image's facts that are asked for; others are left in the task that reads them, errors never.
    """
    images = root_images(entries.where("error is null"))

    def one(row: dict, file: pa.NativeFile) -> list[Keyed]:
        try:
            data = payload_of(row, file)
        except WrongPayload as problem:
            return [no_facts(row["path"], str(problem), row["entry_index"], row["name"])]
        return image_blocks(row["path"], row["entry_index"], row["name"], data, only)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(chain.from_iterable(each_entry(batches, one)))

    facts = spread(images.select(*_READ)).mapInArrow(read, FACT_DDL)
    listed = entries.where("entry_index is not null").select("path", *_filled(fact="entry", idx="entry_index", a="name", sub="compression", m="compressed_size", n="uncompressed_size"))
    bad = entries.where("error is not null").select("path", *_filled(fact="error", error=F.col("error")))
    without = entries.where("error is null").select("path").distinct().join(images.select("path").distinct(), "path", "left_anti").select("path", *_filled(fact="error", error=F.lit(NO_IMAGE)))
    return facts.unionByName(listed).unionByName(bad).unionByName(without)


def _filled(fact: str, **of) -> list:
    """The columns of a fact but its path: those given, and nulls."""
    out = []
    for name, kind in (c.split() for c in FACT_DDL.split(", ")):
        if name == "fact":
            out.append(F.lit(fact).alias(name))
        elif name in of:
            value = of[name]
            out.append((F.col(value) if isinstance(value, str) else value).cast(kind).alias(name))
        elif name != "path":
            out.append(F.lit(None).cast(kind).alias(name))
    return out

"""Packages as bytes, made by Spark from the catalog views, so that extraction has true input and SQL can check it."""

import io
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appcorpus.shared import shared_folder
from appcorpus.shipping import ship
from appcorpus.sources.dex import VISIBILITIES

#: Entry 1 of every tenth package is cut off in the middle.
BROKEN = "cast(substr(package_id, 4) as int) % 10 = 7 and entry_index = 1"


MARK = "Ldalvik/annotation/"
SIGNATURE, THROWS = f"{MARK}Signature;", f"{MARK}Throws;"
NESTING = ["InnerClass", "EnclosingClass", "EnclosingMethod", "MemberClasses"]
FIELD_MARK, PARAMETER_MARK, MARKED = "Lcom/lib/F;", "Lcom/lib/P;", "(Ljava/lang/String;[I)Z"


_BYTES = [bytes([k]) for k in range(128)]


def _uleb(value: int) -> bytes:
    if value < 128:
        return _BYTES[value]
    out = b""
    while value > 127:
        out, value = out + bytes([value & 127 | 128]), value >> 7
    return out + bytes([value])


@lru_cache(100_000)
def _split(proto: str) -> tuple[tuple[str, ...], str]:
    """Parameters and return type."""
    params, _, ret = proto[1:].partition(")")
    return tuple(re.findall(r"\[*(?:[ZBSCIJFDV]|L[^;]+;)", params)), ret


@lru_cache(100_000)
def _text(text: str) -> bytes:
    """A string's item: length in UTF-16 units, modified UTF-8, a zero."""
    return _uleb(len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2) + text.encode().replace(b"\0", b"\xc0\x80") + b"\0"


_PADDING = [b"", bytes(3), bytes(2), bytes(1)]
_CODE = {"string": b"\x1a\0%b", "type": b"\x1c\0%b", "field": b"\x60\0%b", "method": b"\x71\0%b\0\0"}
_U16 = [struct.pack("<H", k) for k in range(1 << 16)]


def _refs(refs: list | dict) -> Iterable[tuple]:
    """Rows, or, since they are most of an image, whole columns."""
    names = ("method_index", "ref_kind", "target_index")
    return zip(*(refs[name] for name in names)) if isinstance(refs, dict) else map(itemgetter(*names), refs)


def _by_class(rows) -> dict[int, list]:
    out = {}
    for row in rows:
        out.setdefault(row["class_def_idx"], []).append(row)
    return out


def _index(first: list[str], more) -> dict[str, int]:
    return {text: k for k, text in enumerate([*first, *sorted(set(more) - set(first))])}


def encode_dex(row, base: int | None = None) -> bytes:
    """A version 035 image; the ids of strings, types, fields and methods are those of the views. With `base` the member of
    a version 041 container that starts there, but for what `encode_container` fills in."""
    head_size, base = (0x70, 0) if base is None else (0x78, base)
    split = {m["proto"]: _split(m["proto"]) for m in row["methods"]}
    used = [t for c in row["classes"] for t in (c["superclass"], c["iface1"], c["iface2"]) if t] + [t for params, ret in split.values() for t in (*params, ret)]
    used += [f["type"] for f in row["fields"]] + [t["catch_type"] for t in row["tries"] if t["catch_type"]]
    used += [a["type"] for a in row["annotations"]] + [t["exception"] for t in row["throws"]] + [THROWS, FIELD_MARK, PARAMETER_MARK]
    used += [f"{MARK}{name};" for name in NESTING] + ["Lcom/lib/In;"]
    types = _index([t["descriptor"] for t in row["types"]], used)
    strings = _index([s["value"] for s in row["strings"]], [*types, *(x["name"] for x in [*row["fields"], *row["methods"]]), "V", "value", "Lcom/", "name", "accessFlags", "Inner"])
    protos = {p: k for k, p in enumerate(sorted(split))}
    sizes = [(len(strings), 4), (len(types), 4), (len(protos), 12), (len(row["fields"]), 8), (len(row["methods"]), 8), (len(row["classes"]), 32)]
    starts, at = [], base + head_size
    for count, width in sizes:
        starts.append(at)
        at += count * width
    data_at, data = at, bytearray()

    def put(raw: bytes) -> int:
        nonlocal data
        if odd := len(data) & 3:
            data += _PADDING[odd]
        at = data_at + len(data)
        data += raw
        return at

    def type_list(names) -> int:
        return put(struct.pack("<I", len(names)) + b"".join(struct.pack("<H", types[t]) for t in names)) if names else 0

    refs, tries, tables = {}, {}, bytearray()
    for method, kind, target in _refs(row["refs"]):
        if method not in refs:
            refs[method] = []
        refs[method].append(_CODE[kind] % _U16[target])
    for t in row["tries"]:
        tries[t["method_index"]] = t

    def code(method: int) -> int:
        body = b"".join(refs.get(method, ())) + b"\x0e\0"
        t, tail = tries.get(method), b""
        if t is not None:
            caught = b"\x01\x01" + _uleb(types[t["catch_type"]]) if t["catch_type"] else b"\x01\0"
            tail = b"\0\0" * (len(body) // 2 % 2) + struct.pack("<IHH", t["start_addr"], t["end_addr"] - t["start_addr"], 1) + caught + _uleb(t["handler_addr"])
        return put(struct.pack("<4H2I", 1, 0, 0, int(t is not None), 0, len(body) // 2) + body + tail)

    at_strings = [put(_text(text)) for text in strings]
    tables += struct.pack(f"<{len(strings)}I", *at_strings)
    tables += b"".join(struct.pack("<I", strings[t]) for t in types)
    for p in protos:
        params, ret = split[p]
        tables += struct.pack("<3I", strings["V"], types[ret], type_list(params))
    tables += b"".join(struct.pack("<HHI", types[f["owner"]], types[f["type"]], strings[f["name"]]) for f in row["fields"])
    tables += b"".join(struct.pack("<HHI", types[m["owner"]], protos[m["proto"]], strings[m["name"]]) for m in row["methods"])
    of_class = {a["class_def_idx"]: a for a in row["annotations"]}
    throws = {t["method_index"]: t["exception"] for t in row["throws"]}

    def mark(visibility: str, kind: str, *value: bytes) -> bytes:
        item = bytes([VISIBILITIES.index(visibility)]) + _uleb(types[kind]) + _uleb(len(value)) + b"".join(_uleb(strings["value"]) + x for x in value)
        return struct.pack("<I", put(struct.pack("<2I", 1, put(item))))

    def wide(tag: int, index: int) -> bytes:
        return struct.pack("<BI", tag | 0x60, index)

    def encoded(x) -> bytes:
        """A static value of each kind."""
        n, own = x["number"], x["class_def_idx"]
        return {
            "byte": lambda: struct.pack("<Bb", 0x00, n - 30), "short": lambda: struct.pack("<Bh", 0x22, -n * 9), "char": lambda: struct.pack("<BH", 0x23, n * 1000), "long": lambda: struct.pack("<Bq", 0xE6, -n << 40),
            "float": lambda: struct.pack("<Bf", 0x70, n / 4), "double": lambda: struct.pack("<Bd", 0xF1, -n / 8), "string": lambda: wide(0x17, strings["value"]), "type": lambda: wide(0x18, types[x["descriptor"]]),
            "field": lambda: wide(0x19, own * 2), "method": lambda: wide(0x1A, own * 4), "enum": lambda: wide(0x1B, own * 2), "array": lambda: b"\x1c\x03" + struct.pack("<Bb", 0x00, n) + wide(0x17, strings["value"]) + b"\x1c\x01\x1e",
            "annotation": lambda: b"\x1d" + _uleb(types[FIELD_MARK]) + b"\x01" + _uleb(strings["value"]) + struct.pack("<Bi", 0x64, n), "methodtype": lambda: wide(0x15, protos["()V"]), "methodhandle": lambda: wide(0x16, n), "null": lambda: b"\x1e", "bool": lambda: b"\x3f",
        }[x["tag"]]()

    def nesting(x) -> list[int]:
        """The compiler's marks on a class that is nested or nests others."""
        item = lambda kind, *parts: put(b"\x02" + _uleb(types[f"{MARK}{kind};"]) + _uleb(len(parts)) + b"".join(_uleb(strings[name]) + value for name, value in parts))
        flags = ("accessFlags", struct.pack("<Bi", 0x64, 9))
        if x["nest"] == "enclosed":
            return [item("InnerClass", flags, ("name", wide(0x17, strings["Inner"]))), item("EnclosingClass", ("value", wide(0x18, types[x["superclass"]])))]
        if x["nest"] == "anonymous":
            return [item("InnerClass", flags, ("name", b"\x1e")), item("EnclosingMethod", ("value", wide(0x1A, x["class_def_idx"] * 4)))]
        return [item("MemberClasses", ("value", b"\x1c\x01" + wide(0x18, types[t]))) for t in (x["superclass"], "Lcom/lib/In;")]

    def annotations(c, fields, methods) -> int:
        """One on each class, a mark on each field f1 and on the second parameter of a certain shape, and the exceptions of methods."""
        a, own = of_class.get(c["class_def_idx"]), bytes(4)
        if a is not None:
            signature = b"\x1c\x02" + b"".join(struct.pack("<BI", 0x77, strings[t]) for t in ("Lcom/", c["descriptor"]))
            item = bytes([VISIBILITIES.index(a["visibility"])]) + _uleb(types[a["type"]]) + b"\x01" + _uleb(strings["value"]) + (signature if a["type"] == SIGNATURE else struct.pack("<Bi", 0x64, c["class_def_idx"]))
            items = [put(item), *(k for x in nests.get(c["class_def_idx"], ()) for k in nesting(x))]
            own = struct.pack("<I", put(struct.pack(f"<{len(items) + 1}I", len(items), *items)))
        at = [struct.pack("<I", f["field_index"]) + mark("runtime", FIELD_MARK) for f in fields if f["name"] == "f1"]
        thrown = [(m["method_index"], throws[m["method_index"]]) for m in methods if m["method_index"] in throws]
        of_methods = [struct.pack("<I", k) + mark("system", THROWS, b"\x1c\x01" + struct.pack("<BI", 0x78, types[t])) for k, t in thrown]
        parameters = [struct.pack("<2I", m["method_index"], put(struct.pack("<2I", 2, 0) + mark("build", PARAMETER_MARK))) for m in methods if m["proto"] == MARKED]
        return put(own + struct.pack("<3I", len(at), len(of_methods), len(parameters)) + b"".join([*at, *of_methods, *parameters]))

    values = {v["class_def_idx"]: v["value"] for v in row["values"]}
    members, kinds, nests = (_by_class(row["fields"]), _by_class(row["methods"])), _by_class(row["encoded"]), _by_class(row["nests"])
    for c in row["classes"]:
        fields, methods = (own.get(c["class_def_idx"], []) for own in members)
        direct = lambda m: m["name"] == "<init>" or m["access_flags"] & 10
        groups = [[f for f in fields if f["access_flags"] & 8], [f for f in fields if not f["access_flags"] & 8], [m for m in methods if direct(m)], [m for m in methods if not direct(m)]]
        body = b"".join(_uleb(len(g)) for g in groups)
        for k, group in enumerate(groups):
            last = 0
            for x in group:
                number = x["field_index"] if k < 2 else x["method_index"]
                body += _uleb(number - last) + _uleb(x["access_flags"]) + (_uleb(code(number)) if k > 1 else b"")
                last = number
        value = values.get(c["class_def_idx"])
        more = kinds.get(c["class_def_idx"])
        static = put(b"\x01\x64" + struct.pack("<i", value)) if value is not None else put(b"\x01" + encoded(more[0])) if more else 0
        interfaces = type_list([i for i in (c["iface1"], c["iface2"]) if i])
        up = types[c["superclass"]] if c["superclass"] else 0xFFFFFFFF
        tables += struct.pack("<8I", types[c["descriptor"]], c["access_flags"], up, interfaces, 0xFFFFFFFF, annotations(c, fields, methods), put(body), static)
    data.extend(b"\0" * (-len(data) % 4))
    end = data_at + len(data) - base
    head = struct.pack("<6I", end, head_size, 0x12345678, 0, 0, 0) + b"".join(struct.pack("<2I", n, at) for (n, _), at in zip(sizes, starts)) + struct.pack("<2I", len(data), data_at)
    body = bytes(20) + head + bytes(head_size - 0x70) + bytes(tables) + bytes(data)
    return (b"dex\n035\0" if head_size == 0x70 else b"dex\n041\0") + struct.pack("<I", zlib.adler32(body)) + body


def encode_container(rows) -> bytes:
    """A version 041 container of one member for each row."""
    members, at = [], 0
    for row in rows:
        members.append(bytearray(encode_dex(row, at)))
        at += len(members[-1])
    start = 0
    for member in members:
        struct.pack_into("<2I", member, 0x70, at, start)
        struct.pack_into("<I", member, 8, zlib.adler32(member[12:]))
        start += len(member)
    return b"".join(members)


def encode_archive(package: str, images) -> bytes:
    """Images by turns stored and deflated, then a manifest and an image that isn't in the root."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for number, name, image in images:
            broken = int(package[3:]) % 10 == 7 and number == 1
            archive.writestr(name, image[: len(image) // 2] if broken else image, zipfile.ZIP_DEFLATED if number % 2 else zipfile.ZIP_STORED)
        archive.writestr("AndroidManifest.xml", f'<manifest package="{package}"/>')
        archive.writestr("assets/classes3.dex", b"junk")
        if int(package[3:]) % 3 == 0:  # what the directory says of these isn't so
            for name, method in (("res/short.bin", zipfile.ZIP_STORED), ("res/cut.bin", zipfile.ZIP_DEFLATED), ("res/packed.bin", zipfile.ZIP_BZIP2), ("res/long.bin", zipfile.ZIP_DEFLATED)):
                archive.writestr(name, b"some text of an entry " * 9, method)
            archive.getinfo("res/short.bin").file_size += 7
            archive.getinfo("res/cut.bin").compress_size -= 4
            archive.getinfo("res/long.bin").file_size -= 1
    return out.getvalue()


_folders: dict[tuple, str] = {}


def written(v, make=None) -> str:
    """A folder with the packages of the views as files, in the shared folder; written once a session for each set of tables."""
    make = make or packages
    spark = v("fx_classes").sparkSession
    key = (spark.sparkContext.applicationId, make.__name__, tuple(v("fx_classes").inputFiles()[:1]))
    if key not in _folders:
        folder = re.sub("^file:/+", "/", f"{shared_folder(spark)}/packages-{uuid.uuid4().hex}")
        system, top = fs.FileSystem.from_uri(folder)
        system.create_dir(top)

        def put(batches):
            (store, _), made = fs.FileSystem.from_uri(folder), {top}
            for batch in batches:
                for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if (own := f"{top}/{path}".rpartition("/")[0]) not in made:
                        store.create_dir(own)
                        made.add(own)
                    with store.open_output_stream(f"{top}/{path}") as file:
                        file.write(content.as_buffer())
                yield batch.select(["path"])

        make(v, put).count()
        _folders[key] = folder
    return _folders[key]


#: What an image holds, by kind: view, whole numbers and texts of its rows, which are in the order of their numbers.
_KINDS = {
    "classes": ("fx_classes", ["class_def_idx", "access_flags"], ["descriptor", "superclass", "iface1", "iface2", "dex_id"]),
    "types": ("fx_types", ["type_index"], ["descriptor"]),
    "strings": ("fx_strings", ["string_index"], ["value"]),
    "fields": ("fx_fields", ["field_index", "class_def_idx", "access_flags"], ["owner", "name", "type"]),
    "methods": ("fx_methods", ["method_index", "class_def_idx", "access_flags"], ["owner", "name", "proto"]),
    "refs": ("fx_code_refs", ["method_index", "pc", "kind_index", "target_index"], []),
    "tries": ("fx_try_handlers", ["method_index", "start_addr", "end_addr", "handler_addr"], ["catch_type"]),
    "annotations": ("fx_annotations", ["class_def_idx"], ["visibility", "type"]),
    "throws": ("fx_throws", ["method_index"], ["exception"]),
    "values": ("fx_static_values", ["class_def_idx", "value"], []),
    "encoded": ("fx_encoded_values", ["class_def_idx", "number"], ["descriptor", "tag"]),
    "nests": ("fx_nest_marks", ["class_def_idx"], ["superclass", "nest"]),
}
_NUMBERS, _TEXTS = ([f"{letter}{k}" for k in range(max(len(of[at]) for of in _KINDS.values()))] for at, letter in ((1, "n"), (2, "t")))
_REF_KINDS = sorted(_CODE)


def _rows(v, only: str = "true") -> DataFrame:
    """What all images hold, one row each, dealt out and sorted once: rows of a package follow each other.

    They do so by `place`, a number made from the package's name, since numbers sort faster than names that begin alike; packages of
    one place may be mixed.
    """
    spark = v("fx_classes").sparkSession
    ship(spark)
    refs = v("fx_code_refs").unionByName(v("fx_type_refs")).withColumn("kind_index", F.array_position(F.lit(_REF_KINDS), F.col("ref_kind")) - 1)
    parts = []
    for kind, (name, (view, numbers, texts)) in enumerate(_KINDS.items()):
        own = (refs if name == "refs" else v(view)).where(only)
        filled = [*(F.col(c).cast("long") for c in numbers), *[F.lit(0).cast("long")] * (len(_NUMBERS) - len(numbers)), *(F.col(c) for c in texts), *[F.lit(None).cast("string")] * (len(_TEXTS) - len(texts))]
        key = [F.xxhash64("package_id").alias("place"), "package_id", F.col("entry_index").cast("long").alias("entry_index"), F.lit(kind).cast("long").alias("kind")]
        parts.append(own.select(*key, *(c.alias(to) for c, to in zip(filled, _NUMBERS + _TEXTS))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return reduce(DataFrame.unionAll, parts).repartition(tasks, "place").sortWithinPartitions("place")


def _whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows as tables that end where a place does."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.column("place").to_numpy()
        if held and held[-1].column("place")[-1].as_py() != place[0]:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if last := int(np.searchsorted(place, place[-1])):
            yield pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _images(found: pa.Table) -> Iterator[tuple[str, int, str, dict]]:
    """(package_id, entry_index, dex_id, row) of each image in these rows, in order; what has no class is no image."""
    packages = found.column("package_id").combine_chunks().dictionary_encode()
    entry, kind, *numbers = (found.column(c).to_numpy() for c in ("entry_index", "kind", *_NUMBERS))
    many = int(entry.max()) + 1
    keys, image = np.unique(packages.indices.to_numpy() * np.int64(many) + entry, return_inverse=True)
    order = np.lexsort((*numbers[::-1], image, kind))
    bounds, rows = np.searchsorted(kind[order], np.arange(len(_KINDS) + 1)), [dict.fromkeys(_KINDS, ()) for _ in keys]
    for (name, (_, whole, texts)), low, high in zip(_KINDS.items(), bounds, bounds[1:]):
        at = order[low:high]
        # by way of numpy, which makes lists of texts many times faster than to_pylist
        columns = [own[at].tolist() for own, _ in zip(numbers, whole)] + [found.column(c).take(pa.array(at)).to_numpy().tolist() for c, _ in zip(_TEXTS, texts)]
        names, of = whole + texts, image[at]
        ends = [*(np.flatnonzero(np.diff(of)) + 1).tolist(), len(at)] if len(at) else []
        for start, end in zip([0, *ends], ends):
            own = [column[start:end] for column in columns]
            rows[of.item(start)][name] = dict(zip(names, own)) if name == "refs" else [dict(zip(names, values)) for values in zip(*own)]
    package = packages.dictionary.to_pylist()
    for key, row in zip(keys.tolist(), rows):
        if row["classes"]:
            if refs := row["refs"]:
                refs["ref_kind"] = [_REF_KINDS[k] for k in refs.pop("kind_index")]
            yield package[key // many], key % many, row["classes"][0]["dex_id"], row


def _batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = iter(rows)
    while some := list(islice(rows, 100)):
        yield pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*some), schema)], schema=schema)


def _packed(rows: DataFrame, ending: str, make, then=None) -> DataFrame:
    """(path, content) of each package: make(package, its images in their order). With `then`, the paths that it gives for batches of such.

    Images are encoded and packed, and taken by `then`, where their rows are; a task holds the images of one package at a time.
    """
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = groupby((image for table in _whole(batches) for image in _images(table)), itemgetter(0))
        made = _batched(((package + ending, make(package, (own for _, *own in images))) for package, images in found), schema)
        yield from made if then is None else then(made)

    return rows.mapInArrow(pack, "path string, content binary" if then is None else "path string")


def packages(v, then=None) -> DataFrame:
    """(path, content), one archive for each package of the views; with `then` see `_packed`."""
    return _packed(_rows(v), ".apk", lambda package, images: encode_archive(package, ((k, name, encode_dex(row)) for k, name, row in images)), then)


def bare_images(v, then=None) -> DataFrame:
    """(path, content): archives, and the first image of each package as a file of its own."""
    return packages(v, then).unionByName(_packed(_rows(v, "entry_index = 0"), "/classes.dex", lambda _, images: encode_dex(next(images)[-1]), then))


def containers(v, then=None) -> DataFrame:
    """(path, content): the images of a package, in their order, as one version 041 container, which is a package of its own."""
    return _packed(_rows(v), ".dex", lambda _, images: encode_container(row for *_, row in images), then)

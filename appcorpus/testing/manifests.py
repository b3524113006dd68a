"""Manifests as bytes, made by Spark from the catalog views: every other package has binary XML."""

import io
import struct
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appcorpus.shipping import ship

URI = "http://schemas.android.com/apk/res/android"


def _chunk(kind: int, head: bytes, body: bytes = b"") -> bytes:
    return struct.pack("<HHI", kind, 8 + len(head), 8 + len(head) + len(body)) + head + body


def encode_axml(elements: list, wide: bool, ids: dict[str, int] | None = None) -> bytes:
    """`ids` names the resource ids of attributes whose names are left out of the string pool. elements: (tag, attributes, children); an attribute: (in the namespace?, name, kind, value); a child that is a text: CDATA."""
    ids = ids or {}
    pool: dict[str, int] = {name: k for k, name in enumerate(ids)}
    none = 0xFFFFFFFF

    def index(text: str) -> int:
        return pool.setdefault(text, len(pool))

    def node(kind: int, body: bytes) -> bytes:
        return _chunk(kind, struct.pack("<II", 1, none), body)

    def element(tag, attrs, children) -> bytes:
        body = struct.pack("<2I6H", none, index(tag), 20, 20, len(attrs), 0, 0, 0)
        for spaced, name, kind, value in attrs:
            value = index(value) if isinstance(value, str) else value
            body += struct.pack("<3IHBBI", index(URI) if spaced else none, index(name), value if kind == 3 else none, 8, 0, kind, value)
        inner = b"".join(node(0x0104, struct.pack("<IHBBI", index(c), 8, 0, 3, index(c))) if isinstance(c, str) else element(*c) for c in children)
        return node(0x0102, body) + inner + node(0x0103, struct.pack("<2I", none, index(tag)))

    space = struct.pack("<2I", index("android"), index(URI))
    nodes = node(0x0100, space) + b"".join(element(*e) for e in elements) + node(0x0101, space)
    data, offsets = b"", []
    for text in pool:
        text = "" if text in ids else text
        offsets.append(len(data))
        raw, units = text.encode("utf-16-le" if wide else "utf-8"), len(text.encode("utf-16-le")) // 2
        if wide:
            data += (struct.pack("<H", units) if units < 0x8000 else struct.pack("<HH", units >> 16 | 0x8000, units & 0xFFFF)) + raw + b"\0\0"
        else:
            data += b"".join(bytes([n]) if n < 0x80 else bytes([n >> 8 | 0x80, n & 0xFF]) for n in (units, len(raw))) + raw + b"\0"
    data += b"\0" * (-len(data) % 4)
    head = struct.pack("<5I", len(pool), 0, 0 if wide else 0x100, 28 + 4 * len(pool), 0)
    strings = _chunk(0x0001, head, struct.pack(f"<{len(pool)}I", *offsets) + data)
    return _chunk(0x0003, b"", strings + _chunk(0x0180, b"", struct.pack(f"<{len(ids)}I", *ids.values())) + nodes)


def _archive(package: str, number: int, activities) -> bytes:
    if number % 2:
        rows = [("activity", [(True, "name", 3, a["name"]), (True, "exported", 0x12, a["exported"]), (True, "icon", 1, 0x7F000000 + a["size"]), (True, "label", 3, f"R&D {a['size']}")], []) for a in activities]
        manifest = encode_axml([("manifest", [(False, "package", 3, package), (True, "versionCode", 0x10, len(activities))], rows)], wide=number % 4 == 1, ids={"name": 0x01010003, "icon": 0x01010002} if number % 3 == 0 else None)
    else:
        manifest = f'<manifest package="{package}"><application/></manifest>'.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("ANDROIDMANIFEST.xml", b"junk")  # renamed below, so that the package has two of that name
        archive.writestr("AndroidManifest.xml", manifest)
    return out.getvalue().replace(b"ANDROIDMANIFEST.xml", b"AndroidManifest.xml")


def packages_with_manifests(v, then=None) -> DataFrame:
    """(path, content), one archive for each package of the views; of its two manifests the last counts. With `then`, the paths that it gives for batches of such."""
    classes = v("fx_classes")
    ship(classes.sparkSession)
    name = F.replace(F.expr("substring(descriptor, 2, length(descriptor) - 2)"), F.lit("/"), F.lit("."))
    one = F.struct("entry_index", "class_def_idx", name.alias("name"), (F.col("access_flags") % 2).cast("int").alias("exported"), F.col("p_size").cast("int").alias("size"))
    rows = classes.groupBy("package_id").agg(F.array_sort(F.collect_list(one)).alias("activities"))
    number = F.expr("cast(substring(package_id, 4) as int)")
    made = rows.select(F.concat("package_id", F.lit(".apk")).alias("path"), F.udf(_archive, "binary")("package_id", number, "activities").alias("content"))
    return made if then is None else made.mapInArrow(then, "path string")

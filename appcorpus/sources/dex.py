"""Facts of one DEX image as Arrow columns: id tables are read in bulk, names are taken by index from whole columns.

What has to be walked (members, code, annotations, values) is gathered as numbers and named at the end. Every offset is
checked by what reads it, so one outside the image is an error.
"""

import json
import math
import struct
import sys
import zlib
from array import array
from collections.abc import Collection, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

NO_INDEX = 0xFFFFFFFF
#: Arrays and annotations inside values, at most.
MAX_DEPTH = 100
# Opcodes by instruction width in code units, as (first, last); 00 is a nop or a payload, all others are errors.
WIDTHS = {
    1: [(0x01, 0x01), (0x04, 0x04), (0x07, 0x07), (0x0A, 0x12), (0x1D, 0x1D), (0x1E, 0x1E), (0x21, 0x21), (0x27, 0x27), (0x28, 0x28), (0x7B, 0x8F), (0xB0, 0xCF)],
    2: [(0x02, 0x02), (0x05, 0x05), (0x08, 0x08), (0x13, 0x13), (0x15, 0x15), (0x16, 0x16), (0x19, 0x19), (0x1A, 0x1A), (0x1C, 0x1C), (0x1F, 0x1F), (0x20, 0x20), (0x22, 0x22), (0x23, 0x23), (0x29, 0x29), (0x2D, 0x3D), (0x44, 0x6D), (0x90, 0xAF), (0xD0, 0xE2), (0xFE, 0xFE), (0xFF, 0xFF)],
    3: [(0x03, 0x03), (0x06, 0x06), (0x09, 0x09), (0x14, 0x14), (0x17, 0x17), (0x1B, 0x1B), (0x24, 0x26), (0x2A, 0x2C), (0x6E, 0x72), (0x74, 0x78), (0xFC, 0xFC), (0xFD, 0xFD)],
    4: [(0xFA, 0xFA), (0xFB, 0xFB)],
    5: [(0x18, 0x18)],
}
# Opcodes whose index refers to a string, type, field or method, as (first, last).
REFERENCES = {
    "string": [(0x1A, 0x1A), (0x1B, 0x1B)],
    "type": [(0x1C, 0x1C), (0x1F, 0x1F), (0x20, 0x20), (0x22, 0x25)],
    "field": [(0x52, 0x6D)],
    "method": [(0x6E, 0x72), (0x74, 0x78), (0xFA, 0xFA), (0xFB, 0xFB)],
}
# Tags of encoded values.
TAGS = {0x00: "byte", 0x02: "short", 0x03: "char", 0x04: "int", 0x06: "long", 0x10: "float", 0x11: "double", 0x15: "methodtype", 0x16: "methodhandle", 0x17: "string", 0x18: "type", 0x19: "field", 0x1A: "method", 0x1B: "enum", 0x1C: "array", 0x1D: "annotation", 0x1E: "null", 0x1F: "bool"}
# Visibilities of annotations, by number.
VISIBILITIES = ["build", "runtime", "system"]


def _by_opcode(groups: dict) -> dict[int, object]:
    return {op: key for key, spans in groups.items() for first, last in spans for op in range(first, last + 1)}


_WIDTHS = [_by_opcode(WIDTHS).get(op, 0) for op in range(256)]
_KINDS = [list(REFERENCES).index(kind) if (kind := _by_opcode(REFERENCES).get(op)) else -1 for op in range(256)]
LITTLE = sys.byteorder == "little"


def u16(data: bytes, at: int) -> int:
    return struct.unpack_from("<H", data, at)[0]


def u32(data: bytes, at: int) -> int:
    return struct.unpack_from("<I", data, at)[0]


def uleb(data: bytes, at: int) -> tuple[int, int]:
    if (value := data[at]) < 0x80:
        return value, at + 1
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value & NO_INDEX, at
        if shift > 28:
            raise ValueError("number of more than five bytes")


def sleb(data: bytes, at: int) -> tuple[int, int]:
    start = at
    value, at = uleb(data, at)
    bits = 7 * (at - start)
    return (value - (1 << bits) if bits < 32 and value >> (bits - 1) & 1 else value), at


def mutf8(raw: bytes) -> str:
    """Modified UTF-8: NUL as C0 80, surrogates one by one; invalid bytes are replaced."""
    try:
        return raw.replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    except UnicodeDecodeError:
        return raw.decode("utf-8", "replace")


def members_of(data: bytes) -> list[int]:
    """Offsets of the logical images: one, or those of a version 041 container, which must fill it."""
    if data[:8] != b"dex\n041\0" or len(data) < 0x78:
        return [0]
    at, out = 0, []
    while at < len(data):
        if data[at : at + 8] != b"dex\n041\0" or u32(data, at + 0x70) != len(data) or u32(data, at + 0x74) != at or not 0x78 <= u32(data, at + 0x20) <= len(data) - at:
            raise ValueError(f"malformed container at {at}")
        out.append(at)
        at += u32(data, at + 0x20)
    return out


#: Columns of facts, without the key of the image.
FACT = pa.schema([("fact", pa.string()), ("idx", pa.int64()), ("sub", pa.int64()), ("a", pa.string()), ("b", pa.string()), ("c", pa.string()), ("n", pa.int64()), ("m", pa.int64()), ("items", pa.list_(pa.string())), ("json", pa.string()), ("error", pa.string())])
MEMBERS = ["static_field", "instance_field", "direct_method", "virtual_method"]


#: Facts of one kind: their number, and the columns that they have, as lists or arrays.
Block = tuple[str, int, dict[str, list | np.ndarray | pa.Array]]
_KIND_NAMES = list(REFERENCES)
#: Columns that only some facts of a kind have.
_OPTIONAL = {"sub", "n"}


def columns(fact: str, size: int, **of) -> pa.Table:
    """Facts of one kind from whole columns; those that aren't given are null."""
    own = {"fact": pa.repeat(fact, size), **of}
    arrays = [pa.nulls(size, f.type) if (x := own.get(f.name)) is None else x if isinstance(x, pa.Array | pa.ChunkedArray) else pa.array(x, f.type) for f in FACT]
    return pa.Table.from_arrays(arrays, schema=FACT)


def taken(values: list | pa.Array, at: np.ndarray) -> list | pa.Array:
    """The values at these places, null where there is no index."""
    if isinstance(values, pa.Array):
        return values.take(pa.array(at, mask=at == NO_INDEX))
    return [None if k == NO_INDEX else values[k] for k in at.tolist()]


def _gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all runs, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def texts_at(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The strings whose items begin there: a length of up to five bytes, then bytes up to a zero."""
    at, more = at.astype(np.int64), np.ones(len(at), bool)
    for _ in range(5):
        high = data[at] >= 0x80
        at, more = at + more, more & high
    if more.any():
        raise ValueError("number of more than five bytes")
    zeros = np.flatnonzero(data == 0)
    sizes = zeros[np.searchsorted(zeros, at)] - at
    offsets = np.zeros(len(at) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data[_gathered(at, sizes)].tobytes())])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # zeros or surrogates as modified UTF-8 has them, or no UTF-8 at all
        return pa.array([mutf8(x) for x in raw.to_pylist()], pa.string())


def text_list_at(data: bytes, at: list[int]) -> list[str]:
    """What `texts_at` gives, string by string: for a few strings that takes less than whole columns do."""
    out = []
    for start in at:
        if data[start] >= 0x80:
            start = uleb(data, start)[1]
        else:
            start += 1
        raw = data[start : data.index(0, start)]
        try:
            out.append(raw.decode())
        except UnicodeDecodeError:
            out.append(mutf8(raw))
    return out


#: Id tables: place of their size in the header, and their rows.
IDS = {name: (at, np.dtype(shape)) for name, at, shape in (("string", 56, "<u4"), ("type", 64, "<u4"), ("proto", 72, "<u4,<u4,<u4"), ("field", 80, "<u2,<u2,<u4"), ("method", 88, "<u2,<u2,<u4"), ("class", 96, ",".join(["<u4"] * 8)))}
#: Up to so many strings an image's names are taken one by one, which costs less than whole columns; results are the same.
FEW = 500
_CODE_HEAD = struct.Struct("<H4xI")
_TRY = struct.Struct("<IHH")


def _check(ids: np.ndarray, size: int) -> None:
    if len(ids) and ids.max() >= size:
        raise IndexError("index outside its table")


class Image:
    """One logical image; offsets in it count from the start of `data`."""

    def __init__(self, data: bytes, base: int = 0):
        if data[base : base + 4] != b"dex\n" or not data[base + 4 : base + 7].isdigit():
            raise ValueError("not a DEX image")
        self.data, self.base = data, base
        tables = {name: self._ids(name, base + at, shape) for name, (at, shape) in IDS.items()}
        self.class_ids, self.proto_ids, self.field_ids, self.method_ids = (tables[k] for k in ("class", "proto", "field", "method"))
        self.few = len(tables["string"]) <= FEW
        self.asked = {"annotation", "member", "ref", "static", "try"}
        if self.few:
            self.string_list = text_list_at(data, tables["string"].tolist())
            self.type_list = [self.string_list[k] for k in tables["type"].tolist()]
        else:
            self.strings = texts_at(np.frombuffer(data, np.uint8), tables["string"])
            self.types = self.strings.take(pa.array(tables["type"]))
        self.proto_list = self._protos(self.proto_ids)
        self.sizes = {kind: len(ids) for kind, ids in tables.items()}
        for ids, kinds in ((self.field_ids, "type"), (self.method_ids, "proto")):
            for column, of in (("f0", "type"), ("f1", kinds), ("f2", "string")):
                _check(ids[column], self.sizes[of])
        self.owners = {"field": self.field_ids["f0"].tolist(), "method": self.method_ids["f0"].tolist()}

    def _ids(self, name: str, at: int, shape: np.dtype) -> np.ndarray:
        count, start = u32(self.data, at), u32(self.data, at + 4)
        if count and start + count * shape.itemsize > len(self.data):
            raise ValueError(f"{name} table outside the image")
        return np.frombuffer(self.data, shape, count, start) if count else np.zeros(0, shape)

    # names as columns and one by one: what is asked for is made
    @cached_property
    def strings(self) -> pa.Array:
        return pa.array(self.string_list, pa.string())

    @cached_property
    def types(self) -> pa.Array:
        return pa.array(self.type_list, pa.string())

    @cached_property
    def protos(self) -> pa.Array:
        return pa.array(self.proto_list, pa.string())

    @cached_property
    def string_list(self) -> list[str]:
        return self.strings.to_pylist()

    @cached_property
    def type_list(self) -> list[str]:
        return self.types.to_pylist()

    def _member(self, kind: str, index: int) -> str:
        owner, of, name = (self.field_ids if kind == "field" else self.method_ids)[index].item()
        return f"{self.type_list[owner]}->{self.string_list[name]}:{(self.type_list if kind == 'field' else self.proto_list)[of]}"

    def _listed(self, at: int) -> list[str]:
        """The types of a list; none at 0."""
        if not at:
            return []
        names = self.type_list
        return [names[k] for k in struct.unpack_from(f"<{u32(self.data, at)}H", self.data, at + 4)]

    def _protos(self, ids: np.ndarray) -> list[str]:
        names, lists = self.type_list, {0: ""}
        for at in set(ids["f2"].tolist()) - {0}:
            lists[at] = "".join(self._listed(at))
        return [f"({lists[at]}){names[ret]}" for at, ret in zip(ids["f2"].tolist(), ids["f1"].tolist())]

    def _named(self, kind: str) -> list:
        """Owner, name and type of all fields or methods: columns, or lists where the image has few names."""
        ids, last = (self.field_ids, "type") if kind == "field" else (self.method_ids, "proto")
        return [taken(self._names(of), ids[column]) for of, column in (("type", "f0"), ("string", "f2"), (last, "f1"))]

    def _names(self, kind: str) -> list[str] | pa.Array:
        return getattr(self, f"{kind}_list" if self.few else f"{kind}s")

    def blocks(self, only: Collection[str] | None = None) -> Iterator[Block]:
        """Facts: header, string, type, proto, field, method, class, member, annotation, static, ref, try; with `only` those kinds.

        The whole image is walked in any case, so what is wrong with it is an error whatever is asked for.
        """
        data, base = self.data, self.base
        wanted = lambda fact: only is None or fact in only
        size, version = u32(data, base + 32), data[base + 4 : base + 7].decode()
        if wanted("header"):
            good = int(zlib.adler32(data[base + 12 : base + size]) == u32(data, base + 8))
            yield "header", 1, {"a": [version], "n": [size], "m": [good]}
        for fact in ("string", "type", "proto"):
            if wanted(fact):
                yield fact, self.sizes[fact], {"idx": np.arange(self.sizes[fact]), "a": self._names(fact)}
        named = {fact: self._named(fact) for fact in ("field", "method") if wanted(fact) or wanted("member")}
        for fact in ("field", "method"):
            if wanted(fact):
                yield fact, self.sizes[fact], {"idx": np.arange(self.sizes[fact]), **dict(zip("abc", named[fact]))}
        c = self.class_ids
        interfaces = [self._listed(at) for at in c["f3"].tolist()]
        _check(c["f0"], self.sizes["type"])
        for ids, of in ((c["f2"], "type"), (c["f4"], "string")):
            _check(ids[ids != NO_INDEX], self.sizes[of])
        if wanted("class"):
            types, strings = self._names("type"), self._names("string")
            yield "class", len(c), {"idx": np.arange(len(c)), "sub": c["f0"], "a": taken(types, c["f0"]), "b": taken(types, c["f2"]), "c": taken(strings, c["f4"]), "n": c["f1"], "items": interfaces}
        # members: class, kind, ordinal, index, flags; refs: method, place, opcode, kind, index
        members, refs, rest = array("q"), array("q"), []
        self.asked = {fact for fact in ("annotation", "member", "ref", "static", "try") if wanted(fact)}
        for k, (own, marks, body, values) in enumerate(zip(*(c[f].tolist() for f in ("f0", "f5", "f6", "f7")))):
            if body:
                rest += self._members(k, own, body, members, refs)
            if marks:
                rest += self._annotations(k, marks)
            if values:
                rest += self._static_values(k, values)
        if wanted("member"):
            found = np.frombuffer(members, np.int64).reshape(-1, 5)
            for low, kind in ((0, "field"), (2, "method")):
                own = found[(found[:, 1] >= low) & (found[:, 1] < low + 2)]
                _, names, kinds = named[kind]
                yield "member", len(own), {"idx": own[:, 0], "a": taken(MEMBERS, own[:, 1]), "sub": own[:, 2], "n": own[:, 3], "b": taken(names, own[:, 3]), "c": taken(kinds, own[:, 3]), "m": own[:, 4]}
        if wanted("ref"):
            found = np.frombuffer(refs, np.int64).reshape(-1, 5)
            yield "ref", len(found), {"idx": found[:, 0], "sub": found[:, 1], "m": found[:, 2], "a": taken(_KIND_NAMES, found[:, 3]), "n": found[:, 4]}
        for fact in ("annotation", "static", "try"):
            if own := [row for row in rest if row["fact"] == fact]:
                yield fact, len(own), {name: [row.get(name) for row in own] for name in own[0].keys() | own[-1].keys() | _OPTIONAL if name != "fact"}

    def table(self, only: Collection[str] | None = None) -> pa.Table:
        """The blocks as one table."""
        found = [columns(fact, size, **of) for fact, size, of in self.blocks(only)]
        return pa.concat_tables(found) if found else FACT.empty_table()

    def _members(self, number: int, owner: int, at: int, members: array, refs: array) -> list[dict]:
        data, asked, counts, rest = self.data, "member" in self.asked, [], []
        for _ in range(4):
            count, at = uleb(data, at)
            counts.append(count)
        for kind, count in enumerate(counts):
            index, owners = 0, self.owners["field" if kind < 2 else "method"]
            for k in range(count):
                step, at = uleb(data, at)
                flags, at = uleb(data, at)
                index += step
                if owners[index] != owner:
                    raise ValueError(f"member {index} belongs to another class")
                if asked:
                    members.extend((number, kind, k, index, flags))
                if kind > 1:
                    code, at = uleb(data, at)
                    if code:
                        rest += self._code(index, code, refs)
        return rest

    def _code(self, method: int, at: int, refs: array) -> list[dict]:
        tries, units = _CODE_HEAD.unpack_from(self.data, at + 6)
        code, pc = self.data[at + 16 : at + 16 + 2 * units], 0
        if len(code) < 2 * units:
            raise ValueError("code outside the image")
        widths = _WIDTHS
        if "ref" in self.asked:
            words, kinds = memoryview(code).cast("H") if LITTLE else struct.unpack(f"<{units}H", code), _KINDS
            while pc < units:
                op = words[pc] & 0xFF
                width = widths[op] or self._payload(code, pc)
                if pc + width > units:
                    raise ValueError("instruction outside its method")
                kind = kinds[op]
                if kind >= 0:
                    refs.extend((method, pc, op, kind, words[pc + 1] | words[pc + 2] << 16 if op == 0x1B else words[pc + 1]))
                pc += width
        else:  # only the last instruction can end outside
            low = code[::2]
            while pc < units:
                pc += widths[low[pc]] or self._payload(code, pc)
            if pc > units:
                raise ValueError("instruction outside its method")
        rest = []
        if tries:
            start = at + 16 + 2 * (units + units % 2)
            for k in range(tries):
                first, count, handler = _TRY.unpack_from(self.data, start + 8 * k)
                rest += self._handlers(method, first, first + count, start + 8 * tries + handler)
        return rest

    def _payload(self, code: bytes, pc: int) -> int:
        if code[2 * pc]:
            raise ValueError(f"unknown opcode {code[2 * pc]:#04x}")
        shape, at = u16(code, 2 * pc), 2 * pc + 2
        if shape == 0x0100:
            return 4 + 2 * u16(code, at)
        if shape == 0x0200:
            return 2 + 4 * u16(code, at)
        return 4 + (u16(code, at) * u32(code, at + 2) + 1) // 2 if shape == 0x0300 else 1

    def _handlers(self, method: int, first: int, end: int, at: int) -> Iterator[dict]:
        count, at = sleb(self.data, at)
        for k in range(abs(count) + (count <= 0)):
            caught = None
            if k < abs(count):
                index, at = uleb(self.data, at)
                caught = self.type_list[index]
            target, at = uleb(self.data, at)
            if "try" in self.asked:
                yield {"fact": "try", "idx": method, "sub": first, "a": caught, "b": str(k), "n": end, "m": target}

    def _annotations(self, number: int, at: int) -> Iterator[dict]:
        own, *counts = struct.unpack_from("<4I", self.data, at)
        yield from self._annotation_set(own, {"idx": number, "a": "class"})
        at += 16
        for kind, count in zip(("field", "method", "parameter"), counts):
            for _ in range(count):
                index, where = struct.unpack_from("<2I", self.data, at)
                at += 8
                key = {"idx": number, "a": kind, "sub": index}
                if kind == "parameter":
                    for ordinal, one in enumerate(self._offsets(where)):
                        yield from self._annotation_set(one, {**key, "n": ordinal})
                else:
                    yield from self._annotation_set(where, key)

    def _offsets(self, at: int) -> tuple[int, ...]:
        return struct.unpack_from(f"<{u32(self.data, at)}I", self.data, at + 4)

    def _annotation_set(self, at: int, key: dict) -> Iterator[dict]:
        """One row for each annotation; an element gives one `name=value`, an array one for each of its values, null none; json has the elements by name."""
        asked = "annotation" in self.asked
        for ordinal, where in enumerate(self._offsets(at) if at else ()):
            kind, place = uleb(self.data, where + 1)
            count, place = uleb(self.data, place)
            items, elements = [], {}
            for _ in range(count):
                name, place = uleb(self.data, place)
                value, place = self._value(place)
                name = self.string_list[name]
                elements[name] = value
                if asked:
                    items += [f"{name}={said}" for x in (value["value"] if value["tag"] == "array" else [value]) if (said := text(x)) is not None]
            visibility, kind = VISIBILITIES[self.data[where]], self.type_list[kind]
            if asked:
                yield {"fact": "annotation", **key, "b": visibility, "c": kind, "m": ordinal, "items": items, "json": json.dumps(elements)}

    def _static_values(self, number: int, at: int) -> Iterator[dict]:
        count, at = uleb(self.data, at)
        for k in range(count):
            value, at = self._value(at)
            if "static" in self.asked:
                yield {"fact": "static", "idx": number, "sub": k, "a": value["tag"], "b": text(value), "json": json.dumps(value)}

    def _value(self, at: int, depth: int = 0) -> tuple[dict, int]:
        """An encoded value as {tag, value}; an array's is a list of such, an annotation has its type and elements by name."""
        if depth > MAX_DEPTH:
            raise ValueError("values are nested too deep")
        head, at = self.data[at], at + 1
        tag, extra = TAGS.get(head & 31), head >> 5
        if tag is None:
            raise ValueError("unknown value")
        if tag in ("null", "bool"):
            return {"tag": tag, "value": None if tag == "null" else bool(extra)}, at
        if tag == "array":
            count, at = uleb(self.data, at)
            parts = []
            for _ in range(count):
                one, at = self._value(at, depth + 1)
                parts.append(one)
            return {"tag": tag, "value": parts}, at
        if tag == "annotation":
            kind, at = uleb(self.data, at)
            count, at = uleb(self.data, at)
            elements = {}
            for _ in range(count):
                name, at = uleb(self.data, at)
                elements[self.string_list[name]], at = self._value(at, depth + 1)
            return {"tag": tag, "type": self.type_list[kind], "value": elements}, at
        raw, at = self.data[at : at + extra + 1], at + extra + 1
        number = int.from_bytes(raw, "little", signed=tag in ("byte", "short", "int", "long"))
        if tag in ("float", "double"):
            width, shape = (4, "<f") if tag == "float" else (8, "<d")
            found = struct.unpack(shape, raw.rjust(width, b"\0"))[0]
            return {"tag": tag, "value": found if math.isfinite(found) else repr(found)}, at
        lists = {"string": "string_list", "type": "type_list", "methodtype": "proto_list"}
        if tag in lists:
            return {"tag": tag, "value": getattr(self, lists[tag])[number]}, at
        if tag in ("field", "enum", "method"):
            return {"tag": tag, "value": self._member("method" if tag == "method" else "field", number)}, at
        return {"tag": tag, "value": number}, at


def text(value: dict) -> str | None:
    """A value on one line."""
    own = value["value"]
    if value["tag"] == "array":
        return f"[{', '.join(map(_inside, own))}]"
    if value["tag"] == "annotation":
        return f"{value['type']}({', '.join(f'{name}={_inside(x)}' for name, x in own.items())})"
    return None if own is None else str(own).lower() if value["tag"] == "bool" else str(own)


def _inside(value: dict) -> str:
    return "null" if (own := text(value)) is None else own

import json
import struct
import zlib
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from appcorpus.sources import dex
from appcorpus.sources import packages as p
from appcorpus.streaming.ingest import CHANGED, ingest
from appcorpus.testing.packages import encode_archive, encode_container, encode_dex

ROW = {
    "types": [{"descriptor": "La/B;"}], "strings": [{"value": "Authorization"}, {"value": "\0\U0001f600"}], "tries": [], "values": [], "encoded": [], "nests": [], "annotations": [], "throws": [],
    "fields": [{"field_index": 0, "class_def_idx": 0, "owner": "La/B;", "name": "x", "type": "I", "access_flags": 18}],
    "methods": [{"method_index": 0, "class_def_idx": 0, "owner": "La/B;", "name": "run", "proto": "(I[La/B;)V", "params": ["I", "[La/B;"], "ret": "V", "access_flags": 1}],
    "classes": [{"class_def_idx": 0, "descriptor": "La/B;", "superclass": None, "iface1": None, "iface2": None, "access_flags": 1}],
    "refs": [{"method_index": 0, "ref_kind": "string", "target_index": 0}] * 2,
}


def rows_of(spark, *files):
    return p.facts(spark.createDataFrame(list(files), "path string, content binary"))


def test_image_round_trip():
    rows = dex.Image(encode_dex(ROW)).table().to_pylist()
    pick = lambda fact, *keys: [tuple(r.get(k) for k in keys) for r in rows if r["fact"] == fact]
    assert pick("method", "a", "b", "c") == [("La/B;", "run", "(I[La/B;)V")]
    assert pick("class", "a", "b", "items") == [("La/B;", None, [])]
    assert pick("ref", "sub", "a", "n") == [(0, "string", 0), (2, "string", 0)]
    assert pick("header", "a", "m") == [("035", 1)]
    assert pick("string", "a")[:2] == [("Authorization",), ("\0\U0001f600",)]


def test_values_of_every_kind():
    """Nested values as text and as JSON; numbers that JSON lacks become text; too deep nesting is an error."""
    image = dex.Image(encode_dex(ROW))
    image.data = b"\x1c\x02\x1c\x01\x1e\x70" + struct.pack("<f", float("inf"))
    value, end = image._value(0)
    assert (dex.text(value), end) == ("[[null], inf]", len(image.data)) and json.loads(json.dumps(value, allow_nan=False)) == value
    image.data = b"\x1c\x01" * 200 + b"\x1e"
    with pytest.raises(ValueError, match="too deep"):
        image._value(0)


def test_texts_in_bulk():
    """As one by one: lengths of several bytes, empty texts, zeros and surrogates in modified UTF-8, no UTF-8 at all."""
    plain = ["", "a", "ünï" * 60, "x" * 20_000, "\U00010000"[:0]]
    for raws in ([t.encode() for t in plain], [b"a", b"\xc0\x80b", b"\xed\xa0\xbd\xed\xb8\x80", b"\xff\xfe", b""]):
        data, at = bytearray(b"\x01junk"), []
        for raw in raws:
            at.append(len(data))
            n, head = len(raw), b""
            while n > 127:
                n, head = n >> 7, head + bytes([n & 127 | 128])
            data += head + bytes([n]) + raw + b"\0"
        found = dex.texts_at(np.frombuffer(bytes(data), np.uint8), np.array(at[::-1], np.uint32)).to_pylist()
        assert found == [dex.mutf8(raw) for raw in raws][::-1]
    with pytest.raises(IndexError):
        dex.texts_at(np.frombuffer(b"\x01ab", np.uint8), np.array([0]))
    with pytest.raises(ValueError):
        dex.texts_at(np.frombuffer(b"\xff" * 9 + b"\0", np.uint8), np.array([0]))


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_damaged_images_never_crash(data):
    image = bytearray(encode_dex(ROW))
    for _ in range(data.draw(st.integers(1, 6))):
        image[data.draw(st.integers(8, len(image) - 1))] = data.draw(st.integers(0, 255))
    facts = p.image_facts("x", 0, "classes.dex", bytes(image[: data.draw(st.integers(9, len(image)))]))
    assert set(facts["fact"].to_pylist()) == {"error"} or "error" not in facts["fact"].to_pylist()


def test_names_as_surrogates():
    assert dex.mutf8(b"\xed\xa0\xbd\xed\xb8\x80\xc0\x80") == "\U0001f600\0"
    assert dex.mutf8(b"\xff") == "�"


def test_payloads_are_passed_over():
    image = dex.Image(encode_dex(ROW))
    body = struct.pack("<4H", 0x0100, 1, 0, 0) + b"\0" * 4 + b"\x1a\0\x05\0" + b"\x0e\0"
    item = struct.pack("<4H2I", 1, 0, 0, 0, 0, len(body) // 2) + body
    image.data = item
    refs = array("q")
    assert image._code(0, 0, refs) == [] and list(refs) == [0, 6, 0x1A, 0, 5]
    image.data = struct.pack("<4H2I", 1, 0, 0, 0, 0, 1) + b"\x3e\0"
    with pytest.raises(ValueError, match="unknown opcode"):
        image._code(0, 0, array("q"))


def test_container_members():
    assert dex.members_of(encode_dex(ROW)) == [0]
    one = lambda at, total: b"dex\n041\0".ljust(0x20, b"\0") + struct.pack("<I", 0x78) + bytes(0x4C) + struct.pack("<II", total, at)
    assert dex.members_of(one(0, 0xF0) + one(0x78, 0xF0)) == [0, 0x78]
    with pytest.raises(ValueError, match="malformed"):
        dex.members_of(one(0, 0xF0) + one(0, 0xF0))


def test_container_of_images(spark):
    both = encode_container([ROW, {**ROW, "refs": []}])
    cut = bytearray(both)
    struct.pack_into("<I", cut, 0x70, len(both) - 4)
    found = rows_of(spark, ("both", both), ("one", encode_container([ROW])), ("cut", bytes(cut))).cache()
    assert sorted((r.path, r.logical_index, r.dex_id, r.version, r.checksum_ok) for r in p.table(found, "header").collect()) == [
        ("both", 0, "classes.dex!classes1.dex", "041", True), ("both", 1, "classes.dex!classes2.dex", "041", True), ("one", 0, "classes.dex", "041", True)]
    assert [(r.path, r.logical_index) for r in p.table(found, "ref").orderBy("path").collect()] == [("both", 0), ("both", 0), ("one", 0), ("one", 0)]
    assert [r.path for r in p.table(found, "error").collect()] == ["cut"] and zlib.adler32(both[12 : dex.u32(both, 32)]) == dex.u32(both, 8)
    found.unpersist()


def test_bad_files_give_error_rows_and_good_ones_stay(spark):
    image = encode_dex(ROW)
    good = encode_archive("pkg000001", [(0, "classes.dex", image), (1, "classes2.dex", image), (1, "classes2.dex", b"later")])
    found = rows_of(spark, ("good", good), ("bare", image), ("cut", image[:200]), ("junk", b"junk"), ("empty", b""), ("null", None), ("none", encode_archive("pkg000002", []))).cache()
    assert {r.path for r in p.table(found, "error").collect()} == {"cut", "junk", "empty", "null", "none"}
    assert sorted((r.path, r.entry_index) for r in p.table(found, "class").collect()) == [("bare", 0), ("good", 0), ("good", 1)]
    assert p.table(found, "entry").where("path = 'good'").count() == 5
    found.unpersist()


def test_catalog_on_disk(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.dex").write_bytes(encode_dex(ROW))
    packages = p.read_packages(spark, str(tmp_path / "in"))
    assert [r.kind for r in p.scan(packages).collect()] == ["dex"]
    p.write_catalog(p.facts(packages), str(tmp_path / "out"))
    assert p.table(spark.read.parquet(str(tmp_path / "out")), "string").where("value = 'Authorization'").count() == 1
    large = p.read_packages(spark, str(tmp_path / "in"), max_bytes=10)
    assert large.where("content is not null").count() == 0
    assert [(r.fact, r.error) for r in p.facts(large).collect()] == [("error", p.TOO_LARGE)]


def test_ingest_of_repeated_and_changed_paths(spark, tmp_path):
    image, other = encode_dex(ROW), encode_dex({**ROW, "refs": []})
    home, schema = str(tmp_path), "path string, content binary"

    def take(*files):
        spark.createDataFrame(list(files), schema).write.mode("append").parquet(f"{home}/in")
        ingest(spark.readStream.schema(schema).parquet(f"{home}/in"), f"{home}/catalog", f"{home}/state").awaitTermination()

    take(("a", image), ("a", image), ("b", image), ("c", image), ("c", other))
    take(("a", other), ("b", image), ("d", other), ("e", None))
    seen = {(r.batch, r.path): r.status for r in spark.read.parquet(f"{home}/catalog/packages").collect()}
    assert seen == {(0, "a"): "new", (0, "b"): "copy", (0, "c"): "changed", (1, "a"): "changed", (1, "b"): "copy", (1, "d"): "new", (1, "e"): "new"}
    found = spark.read.parquet(f"{home}/catalog/facts")
    assert sorted((r.batch, r.path) for r in found.where("fact = 'class'").collect()) == [(0, "a"), (1, "d")]
    assert sorted((r.batch, r.path, r.error) for r in found.where("fact = 'error'").collect()) == [(0, "c", CHANGED), (1, "a", CHANGED), (1, "e", p.TOO_LARGE)]

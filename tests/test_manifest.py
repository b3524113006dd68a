import io
import struct
import zipfile

import pytest

from appcorpus.operators.annotations import metadata
from appcorpus.sources import archives
from appcorpus.sources import manifest as m
from appcorpus.testing.manifests import URI, encode_axml
from appcorpus.testing.packages import encode_archive

TREE = [("manifest", [(False, "package", 3, "a&\"'b"), (True, "debuggable", 0x12, 1)], [("application", [], ["x ]]> y"]), ("activity", [(True, "name", 3, "n" * 300)], [])])]


# Texts of typed values that must equal the reference's.
@pytest.mark.parametrize("kind, value, text", [(0x10, 42, "42"), (0x10, 0xFFFFFFFF, "-1"), (0x01, 0x7F0D0001, "@7F0D0001"), (0x01, 0x01030007, "@android:01030007"), (0x11, 0x40003FB4, "0x40003FB4"), (0x05, 0x1001, "16.000000dip"), (0x04, 0x40000000, "2.000000"), (0x1C, 0xFF112233, "#FF112233"), (0x12, 1, "true"), (0x07, 0x7F0D0001, "<0x7F0D0001, type 0x07>"), (0x13, 1, "<0x1, type 0x13>"), (0x06, 0x4010, "50.000000%")])
def test_typed_values(kind, value, text):
    assert m.typed_value(kind, value, []) == text


def decode(spark, data):
    """(text, nodes in order, problem) of one manifest."""
    found = m.events_of(spark.createDataFrame([("x", data)], "path string, content binary"))
    row, nodes = m.manifests(found).first(), m.manifest_nodes(found).orderBy("node_id").collect()
    return row.xml, nodes, row.error


@pytest.mark.parametrize("wide", [False, True])
def test_binary_manifest(spark, wide):
    text, nodes, problem = decode(spark, encode_axml(TREE, wide))
    assert problem is None
    assert text.split("\n") == [
        '<?xml version="1.0" encoding="utf-8"?>',
        f'<manifest xmlns:android="{URI}" package="a&amp;&quot;&apos;b" android:debuggable="true">',
        "    <application>",
        "        <![CDATA[x ]] ]]><![CDATA[> y]]>",
        "    </application>",
        f'    <activity android:name="{"n" * 300}" />',
        "</manifest>",
    ]
    assert [(n["node_id"], n["parent_id"], n["depth"], n["tag"]) for n in nodes] == [(0, None, 0, "manifest"), (1, 0, 1, "application"), (2, 1, 2, None), (3, 0, 1, "activity")]


@pytest.mark.parametrize("wide", [False, True])
def test_attribute_names_by_resource_id(spark, wide):
    tree = [("activity", [(True, "name", 3, "a.B"), (True, "own", 0x10, 7), (True, "exported", 0x12, 1)], [])]
    text, nodes, problem = decode(spark, encode_axml(tree, wide, {"name": 0x01010003, "own": 0x7F010001}))
    assert problem is None and f'<activity xmlns:android="{URI}" android:name="a.B" android:attr_7F010001="7" android:exported="true" />' in text


def test_every_cut_is_an_error():
    whole = encode_axml(TREE, False)
    for size in range(len(whole)):
        assert [e["kind"] for e in m.events(whole[:size])][-1] == "error"
    styled = bytearray(whole)
    struct.pack_into("<I", styled, 8 + 12, 1)
    assert [e["text"] for e in m.events(bytes(styled))] == ["malformed string pool"]


def test_deep_nesting_is_an_error(spark):
    tree = ("a", [], [])
    for _ in range(200):
        tree = ("a", [], [tree])
    assert decode(spark, encode_axml([tree], False))[1][-1]["depth"] == 200
    text, nodes, problem = decode(spark, b"<a>" * 2000 + b"</a>" * 2000)
    assert (len(text), nodes, problem) == (14_000, [], "elements are nested too deep")


def test_rows(spark, tmp_path):
    """The last manifest entry counts; files without one give no row, unreadable ones an error and no nodes."""
    twice = io.BytesIO(encode_archive("pkg000001", []))
    with zipfile.ZipFile(twice, "a") as archive:
        archive.writestr(m.NAME, "<later><x/>said</later>")
    for name, data in (("plain", encode_archive("pkg000001", [])), ("twice", twice.getvalue()), ("junk", b"junk"), ("bare", b"dex\n035\0" + bytes(200))):
        (tmp_path / name).write_bytes(data)
    found = m.manifest_events(archives.list_entries(spark, str(tmp_path)))
    texts = {r.path.rpartition("/")[2]: r for r in m.manifests(found).collect()}
    assert set(texts) == {"plain", "twice", "junk"}
    assert texts["plain"].xml == '<manifest package="pkg000001"/>' and texts["junk"].error
    assert texts["twice"].xml == "<later><x/>said</later>"
    nodes = [(r.node_id, r.parent_id, r.depth, r.tag, r.text) for r in m.manifest_nodes(found).orderBy("node_id").collect() if r.path.endswith("twice")]
    assert nodes == [(0, None, 0, "later", None), (1, 0, 1, "x", None), (2, 0, 1, None, "said")]
    broken = decode(spark, b"<a><b></a>")
    assert broken[0] == "<a><b></a>" and broken[1] == [] and "mismatched" in broken[2]


def test_metadata(spark):
    kind = lambda name: f"Ldalvik/annotation/{name};"
    rows = [
        ("p", 0, "class", None, 0, kind("Signature"), ["value=<T:", "value=Lx;>"]),
        ("p", 0, "class", None, 1, kind("Signature"), ["value=later"]),
        ("p", 0, "class", None, 2, kind("MemberClasses"), ["value=La$1;"]),
        ("p", 0, "class", None, 3, kind("MemberClasses"), ["value=La$2;"]),
        ("p", 0, "class", None, 4, kind("InnerClass"), ["accessFlags=9", "name=In"]),
        ("p", 0, "method", 3, 0, kind("Throws"), ["value=Le;", "value=Lf;"]),
        ("p", 0, "parameter", 3, 0, "Lother;", []),
    ]
    made = spark.createDataFrame(rows, "package_id string, class_def_idx long, target_kind string, target_index long, ordinal long, type string, elements array<string>")
    found = {r.target_kind: r for r in metadata(made, ["package_id"]).collect()}
    own = found["class"]
    assert (own.signature, own.inner_name, own.inner_flags, own.member_classes, own.throws, own.enclosing_class) == ("<T:Lx;>", "In", 9, ["La$1;", "La$2;"], None, None)
    assert found["method"].throws == ["Le;", "Lf;"] and set(found) == {"class", "method"}

"""Fixture packages from rows in one order: the same images whatever batches and tasks the rows come in."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from appcorpus.testing import packages as made
from appcorpus.testing.fixtures import view

SCHEMA = pa.schema([("place", pa.int64()), ("package_id", pa.string()), ("entry_index", pa.int64()), ("kind", pa.int64()), *((c, pa.int64()) for c in made._NUMBERS), *((c, pa.string()) for c in made._TEXTS)])


def row(place, package, entry, kind, numbers, texts):
    pad = lambda values, names, empty: dict(zip(names, [*values, *[empty] * (len(names) - len(values))]))
    return {"place": place, "package_id": package, "entry_index": entry, "kind": list(made._KINDS).index(kind), **pad(numbers, made._NUMBERS, 0), **pad(texts, made._TEXTS, None)}


def package(place, name):
    """Two images, one of them without anything but its class, and rows of an entry that has no class."""
    own = [row(place, name, k, "classes", [0, 1], [f"L{name};", None, None, None, f"classes{k}.dex"]) for k in (0, 2)] + [row(place, name, 1, "types", [0], ["Llost;"])]
    own += [row(place, name, 2, "refs", [m, pc, kind, 7], []) for m, pc, kind in ((0, 0, 3), (0, 0, 1), (0, 9, 0), (10, 3, 2), (2, 3, 2))]
    own += [row(place, name, k, "types", [0], [f"L{name};"]) for k in (0, 2)]
    return own + [row(place, name, 2, "strings", [k], [f"text {k}"]) for k in range(12)]


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_rows_in_any_batches(size):
    """Packages of one place are mixed, those of several batches whole; numbers are in order, not their digits."""
    groups = [package(-5, "a") + package(-5, "b"), package(0, "c"), package(3, "d") + package(3, "e")]
    rows = [r for group in groups for r in random.Random(size).sample(group, len(group))]
    batches = [pa.RecordBatch.from_pylist(rows[at : at + size], SCHEMA) for at in range(0, len(rows), size)]
    found = [image for table in made._whole([*batches, pa.RecordBatch.from_pylist([], SCHEMA)]) for image in made._images(table)]
    assert sorted((p, k, d) for p, k, d, _ in found) == [(p, k, f"classes{k}.dex") for p in "abcde" for k in (0, 2)]
    assert [p for n, (p, *_) in enumerate(found) if not n or found[n - 1][0] != p] == list(dict.fromkeys(p for p, *_ in found))
    for p, k, _, own in found:
        assert own["classes"][0]["descriptor"] == f"L{p};" and [t["descriptor"] for t in own["types"]] == [f"L{p};"]
        assert [s["value"] for s in own["strings"]] == ([f"text {n}" for n in range(12)] if k else [])
        if k:
            assert list(zip(*(own["refs"][c] for c in ("method_index", "pc", "ref_kind", "target_index")))) == [(0, 0, "method", 7), (0, 0, "type", 7), (0, 9, "field", 7), (2, 3, "string", 7), (10, 3, "string", 7)]
        made.encode_dex({**own, "refs": ()})


def test_packages_are_dealt_out_once(spark):
    """Rows of images are shuffled and sorted by a number once, not joined by image; files have the bytes that packages have as rows."""
    v = lambda name: view(spark, "/root/testdata/sf0.001", name)
    plan = made.packages(v)._jdf.queryExecution().optimizedPlan().toString()
    assert "place" in plan and "collect_list" not in plan and plan.count("RepartitionByExpression") == 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(made.written(v))
    found = {r.name: (r.length, r.n) for r in files.groupBy(F.substring_index("path", "/", -1).alias("name")).agg(F.max("length").alias("length"), F.count("*").alias("n")).collect()}
    assert found == {r.path: (r.size, 1) for r in made.packages(v).select("path", F.length("content").alias("size")).collect()} and found

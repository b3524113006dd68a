"""Small images: names one by one, facts gathered over images; the same rows as by whole columns."""

import random

import pytest
from pyspark.sql import functions as F

from appcorpus.plans import packages as plans
from appcorpus.sources import dex
from appcorpus.sources import packages as p
from appcorpus.testing.packages import encode_dex
from test_sources import ROW

LONG = {**ROW, "strings": [{"value": f"text {k:05d} é"} for k in range(700)]}


def rows_of(image, only=None):
    """Errors without their words."""
    found = p.image_facts("x", 0, "classes.dex", image, only).to_pylist()
    return sorted(repr({**row, "error": row["error"] is not None}) for row in found)


@pytest.mark.parametrize("only", [None, ["member"], ["class", "string"], ["ref"], []])
def test_lists_and_whole_columns_say_the_same(monkeypatch, only):
    for row in (ROW, LONG):
        image = encode_dex(row)
        damaged = image[:0x70] + b"\xff" * 8 + image[0x78:]
        monkeypatch.setattr(dex, "FEW", 10**6)
        lists = rows_of(image, only), rows_of(damaged, only)
        monkeypatch.setattr(dex, "FEW", 0)
        assert (rows_of(image, only), rows_of(damaged, only)) == lists and "'fact': 'error'" in lists[1][0]


def test_images_share_their_columns(monkeypatch):
    """Blocks of many images come out together, without columns of their own; large ones still as columns."""
    image, made = encode_dex(ROW), []
    whole = sorted(map(repr, p.image_facts("x", 0, "classes.dex", image).to_pylist()))
    columns = p.columns
    monkeypatch.setattr(p, "columns", lambda fact, size, **of: made.append(size) or columns(fact, size, **of))
    batches = list(p.batches_of(b for _ in range(50) for b in p.image_blocks("x", 0, "classes.dex", image)))
    assert not made and len(batches) == 1 and sorted(map(repr, batches[0].to_pylist())) == sorted(whole * 50)
    monkeypatch.setattr(p, "_CHUNK", 30)
    batches = list(p.batches_of(b for _ in range(50) for b in p.image_blocks("x", 0, "classes.dex", image)))
    assert made and max(b.num_rows for b in batches) <= 60 and sorted(repr(r) for b in batches for r in b.to_pylist()) == sorted(whole * 50)


def test_references_as_rows_and_as_columns():
    columns = {name: [r[name] for r in ROW["refs"]] for name in ("method_index", "ref_kind", "target_index")}
    assert encode_dex({**ROW, "refs": columns}) == encode_dex(ROW)


def test_package_of_a_path(spark):
    """From the last part of the path alone: a pattern over all of it takes a row longer than its facts."""
    paths = ["file:/tmp/a.b/pkg000001.apk", "pkg000002.v2.apk", "/x.y/none", "s3://b/pkg000003/classes.dex"]
    found = plans._named(spark.createDataFrame([(x,) for x in paths], "path string").withColumn("own", F.col("path")))
    assert [r.package_id for r in found.collect()] == ["pkg000001", "pkg000002.v2", "", "classes"]
    assert "substring_index" in found._jdf.queryExecution().optimizedPlan().toString()


def test_only_what_is_asked_for_is_gathered(monkeypatch):
    """Members and references are walked, but kept only where they are asked for; what is wrong with them is an error all the same."""
    gathered = []

    class Counted(dex.array):
        def extend(self, values):
            gathered.append(tuple(values))
            super().extend(gathered[-1])

    monkeypatch.setattr(dex, "array", Counted)
    image, counts = encode_dex(ROW), []
    for only in (["header", "annotation"], ["ref"], ["member"], None):
        gathered.clear()
        assert "error" not in p.image_facts("x", 0, "classes.dex", image, only)["fact"].to_pylist()
        counts.append(len(gathered))
    assert counts == [0, 2, 2, 4]
    rng, wrong = random.Random(7), 0
    for _ in range(1_500):
        damaged = bytearray(image)
        for _ in range(rng.randint(1, 3)):
            damaged[rng.randrange(0x70, len(image))] = rng.randrange(256)
        errors = [[x for x in p.image_facts("x", 0, "classes.dex", bytes(damaged), only)["error"].to_pylist() if x] for only in (None, ["header"], ["annotation"], ["ref"])]
        assert all(x == errors[0] for x in errors)
        wrong += bool(errors[0])
    assert 300 < wrong < 1_400

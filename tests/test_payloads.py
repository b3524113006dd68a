import hashlib
import io
import struct
import zipfile

from pyspark.sql import functions as F

from appcorpus.sources import archives
from appcorpus.sources import packages as p
from appcorpus.testing.packages import encode_archive, encode_dex
from test_sources import ROW


def test_every_payload_or_its_error(spark, tmp_path):
    out, texts = io.BytesIO(), {"classes.dex": b"a" * 900, "b.txt": b"deflated " * 90, "empty": b"", "lib/x.so": bytes(range(256)) * 9, "short": b"size " * 40, "packed": b"bzip " * 40, "damaged": b"stream " * 60}
    with zipfile.ZipFile(out, "w") as archive:
        for k, (name, data) in enumerate(texts.items()):
            archive.writestr(name, data, zipfile.ZIP_BZIP2 if name == "packed" else zipfile.ZIP_DEFLATED if k % 2 or name == "damaged" else zipfile.ZIP_STORED)
    content = bytearray(out.getvalue())
    infos = zipfile.ZipFile(io.BytesIO(bytes(content))).infolist()
    at = {i.filename: i.header_offset for i in infos}
    content[at["damaged"] + 30 + len("damaged")] |= 7  # no such block type
    struct.pack_into("<H", content, at["short"] + 28, 60_000)  # the data would begin beyond the end
    for name, data in (("a.apk", bytes(content)), ("junk.apk", b"junk"), ("plain.apk", plain()), ("none.apk", b"PK\5\6" + bytes(18))):
        (tmp_path / name).write_bytes(data)
    entries = archives.list_entries(spark, str(tmp_path))
    assert sorted((r.path.rpartition("/")[2], r.error is None, r.entry_index is None) for r in entries.where("error is not null or entry_index is null").collect()) == [("junk.apk", False, True), ("none.apk", True, True)]
    found = {(r.path.rpartition("/")[2], r.entry_index): r for r in archives.verdicts(entries).collect()}
    assert len(found) == len(texts) + 1
    wrong = {"short": "truncated", "packed": "unsupported method", "damaged": "damaged"}
    for k, (name, data) in enumerate(texts.items()):
        row = found["a.apk", k]
        assert (row.name, row.verdict) == (name, wrong.get(name, "ok"))
        assert (row.sha256, row.size) == ((None, None) if name in wrong else (hashlib.sha256(data).hexdigest(), len(data)))
    assert found["plain.apk", 0].verdict == "ok"
    errors = {r.path.rpartition("/")[2]: r.error for r in p.table(archives.read_facts(entries), "error").collect()}
    assert set(errors) == {"a.apk", "junk.apk", "plain.apk", "none.apk"} and errors["plain.apk"] == errors["none.apk"] == p.NO_IMAGE


def test_images_of_one_archive_go_to_tasks_of_their_own(spark, tmp_path):
    """Files and rows of bytes give the same facts; an archive's images are dealt out."""
    image = encode_dex(ROW)
    content = encode_archive("pkg000001", [(k, f"classes{k + 1 if k else ''}.dex", image) for k in range(12)])
    (tmp_path / "pkg000001.apk").write_bytes(content)
    entries = archives.list_entries(spark, str(tmp_path))
    facts = archives.read_facts(entries)
    columns = [c for c in facts.columns if c not in ("path", "items")]
    of_bytes = p.facts(spark.createDataFrame([("pkg000001.apk", content)], "path string, content binary"))
    both = [sorted(map(repr, df.select(*columns).collect())) for df in (facts, of_bytes)]
    assert both[0] == both[1] and len(both[0]) > 12 * 20
    tasks = facts.where("fact = 'header'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 4 and "BatchEvalPython" not in facts._jdf.queryExecution().toString()
    assert p.table(archives.read_facts(archives.list_entries(spark, str(tmp_path), max_bytes=10)), "error").first().error == p.TOO_LARGE


def test_only_the_kinds_asked_for_leave_a_task(spark, tmp_path):
    """Errors always do, and those of an image don't depend on what is asked for."""
    image = encode_dex(ROW)
    (tmp_path / "pkg000001.apk").write_bytes(encode_archive("pkg000001", [(0, "classes.dex", image), (1, "classes2.dex", image[:-40])]))
    entries = archives.list_entries(spark, str(tmp_path))
    every = archives.read_facts(entries)
    for kinds in (["class"], ["ref", "member"], ["annotation"], []):
        found = archives.read_facts(entries, kinds).where("fact <> 'entry'")
        same = every.where(F.col("fact").isin("error", *kinds))
        assert sorted(map(repr, found.collect())) == sorted(map(repr, same.collect()))
    assert every.where("fact = 'error'").count() == 1


def test_directories_of_many_small_files_are_read_by_few_tasks(spark, tmp_path):
    content = plain()
    for k in range(400):
        (tmp_path / f"{k}.apk").write_bytes(content)
    entries = archives.list_entries(spark, str(tmp_path))
    assert entries.count() == 400 and entries.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def plain():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("only.txt", "no image")
    return out.getvalue()


def test_root_images_from_one_shuffle(spark, tmp_path):
    """The images of the root by one pass over the directories; of equal names the first, others only where none is named classes*."""
    names = {"a": ["b.dex", "x/classes.dex", "classes2.dex", "classes2.dex", "classes.dex"], "b": ["z.dex", "y.dex", "z.dex"], "c": ["x/classes.dex", "classes.txt"]}
    for name, own in names.items():
        with zipfile.ZipFile(tmp_path / f"{name}.apk", "w") as archive:
            for k, entry in enumerate(own):
                archive.writestr(entry, bytes(k + 1))
    found = archives.root_images(archives.list_entries(spark, str(tmp_path)))
    assert sorted((r.path[-5], r.name, r.entry_index, r.uncompressed_size) for r in found.collect()) == [("a", "classes.dex", 4, 5), ("a", "classes2.dex", 2, 3), ("b", "y.dex", 1, 2), ("b", "z.dex", 0, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan and "parquet" in plan

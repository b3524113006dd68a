import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from appcorpus.llm import fingerprint

from test_operators import TEXTS, docs


def hashed(value, seed=42):
    return xxhash.xxh64_intdigest(value if isinstance(value, bytes) else struct.pack("<Q", value), seed)


def both(x, y):
    return hashed(y, hashed(x))


def sketch_by_hand(text):
    """(kept hashes in signed order, least of all): five words from those of 1, 2 and 4; one hash in eight is kept."""
    words = [hashed(w.encode()) for w in (text or "").lower().translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    grams = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    # a shorter text is one shingle; its missing words are null, which a hash passes over
    hash_of = lambda x, y: both(x, y) if None not in (x, y) else hashed(x if y is None else y) if (x, y) != (None, None) else 42
    out = set()
    for g in grams:
        g = g + [None] * (5 - len(g))
        out.add(hash_of(hash_of(hash_of(g[0], g[1]), hash_of(g[2], g[3])), g[4]))
    signed = sorted(h - (1 << 64) if h >> 63 else h for h in out)
    return [h for h in signed if 0 <= h < 1 << 61], min(signed, default=None)


def test_kept_hashes_and_likeness_by_hand(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 3)
    texts = TEXTS + [f"w{i} common words of all texts number {i % 4} and more of them " * (i % 3 + 1) for i in range(30)]
    rows = docs(spark, texts)
    for r in fingerprint.fingerprints(rows).select("text", "sketch", "least").collect():
        if len((r.text or "").split()) >= 5 or not (r.text or "").split():
            assert (r.sketch, r.least) == sketch_by_hand(r.text)
    order = [(r.doc_id, r.text or "") for r in rows.collect() if r.doc_id is not None and len((r.text or "").split()) >= 5]
    unique = [x for x in sorted(order) if [o[0] for o in order].count(x[0]) == 1]
    every = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.text or "") for r in rows.collect())
    found = {r.id: r.near_next for r in fingerprint.compared(rows).collect()}
    for i, text in unique:
        after = every[(every.index((i, text)) + 1) % len(every)]
        if [e[0] for e in every].count(after[0]) > 1 or len(after[1].split()) < 5:
            continue
        (a, a0), (b, b0) = sketch_by_hand(text), sketch_by_hand(after[1])
        a, b = set(a), set(b)
        assert found[i] == (len(a & b) / len(a | b) if a or b else float(a0 == b0))


@pytest.mark.parametrize("names", [[f"https://www.example.org/p/{k}" for k in range(20_000)] + ["http://x", None, ""], list(range(-9_000, 11_000)), ["same"] * 20_000])
def test_ids_of_any_look_are_dealt_evenly(spark, names):
    frame = spark.createDataFrame([(n, f"text {k}") for k, n in enumerate(names)], f"doc_id {'long' if isinstance(names[0], int) else 'string'}, text string")
    keyed = frame.withColumn("_key", fingerprint._order_key(frame, "doc_id", "text"))
    bucket, firsts = fingerprint._ranges(keyed)
    sizes = {r.b: r["count"] for r in keyed.groupBy(bucket.alias("b")).count().collect()}
    assert sorted(sizes) == list(range(5)) == list(range(len(firsts))) and max(sizes.values()) < 2 * fingerprint.RANGE_ROWS
    ordered = keyed.orderBy("_key").select("doc_id", bucket.alias("b")).collect()
    assert [r.b for r in ordered] == sorted(r.b for r in ordered)
    text = lambda n: "" if n is None else n
    assert [text(r.doc_id) for r in ordered][3:] == sorted(map(text, names))[3:]


def test_many_ranges(spark, monkeypatch):
    """Two steps of lookup over some hundred edges."""
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 10)
    keys = spark.range(3_000).select(F.concat(F.lit("1"), F.lpad(F.hex("id"), 16, "0"), F.lit("-x")).alias("_key"))
    bucket, firsts = fingerprint._ranges(keys)
    found = {r._key: r.b for r in keys.select("_key", bucket.alias("b")).collect()}
    assert len(firsts) > 200 and all(firsts[b] <= k and (b + 1 == len(firsts) or k < firsts[b + 1]) for k, b in found.items())

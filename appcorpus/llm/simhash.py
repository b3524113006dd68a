"""SimHash near-duplicates: distances to reference fingerprints discard pairs, survivors are verified."""

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, cut, dealt_anew, free, hex64, lower_tokens, ref, utf8
from .components import components

BITS = 64
#: Reference fingerprint j has its lowest j bits set. The step from one distance to the next is 1 or -1 as bit j is
#: clear or set, so the table of these 65 short numbers places a fingerprint exactly.
PIVOTS = [(1 << j) - 1 for j in range(BITS + 1)]
#: The 64 steps in six groups. Two flipped bits change two groups at most, so linked fingerprints agree on four: at
#: least 42 steps, so that buckets of unrelated fingerprints stay small for any number of documents.
GROUPS = [range(0, 11), range(11, 22), range(22, 33), range(33, 44), range(44, 54), range(54, 64)]
MAX_BITS = 2
#: Buckets of more fingerprints (dense neighbourhoods) meet at references of their own instead; both ways find every link.
MAX_BUCKET = 32
_CHUNK = 1 << 16


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Majority vote of the shingles' XXH64 bits, as an unsigned number; zero without words."""
    tokens = lower_tokens(text or b"")
    if not tokens:
        return 0
    if len(tokens) < shingle:
        grams, n = [b" ".join(tokens)], 1
    else:
        grams, n = map(b" ".join, zip(*(tokens[i:] for i in range(shingle)))), len(tokens) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64, n)
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int, seed: int):
    def batch(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t, shingle, seed) for t in utf8(texts)], np.uint64).view(np.int64))

    return lambda: batch


def fingerprint_column(text: str | Column, shingle: int = 3, seed: int = 42) -> Column:
    return arrow_column(_fingerprints(shingle, seed), "long", text)


def _pivots() -> Column:
    return F.array(*(F.lit(_signed(p)).cast("long") for p in PIVOTS))


def pivot_distances(fp: Column) -> Column:
    """The row of the distance table: one Hamming distance for each reference fingerprint, a byte each."""
    return F.transform(_pivots(), lambda p: F.bit_count(fp.bitwiseXOR(p)).cast("tinyint"))


def _dealt(table: DataFrame) -> DataFrame:
    """(fp, d, band, key) for each four of the six groups; key: the steps between the distances there, a bit each."""
    step = lambda x, y: F.shiftright((y - x + 1).cast("int"), 1)
    steps = table.select("fp", "d", F.zip_with(F.slice("d", 1, BITS), F.slice("d", 2, BITS), step).alias("steps"))
    code = [F.aggregate(F.slice("steps", g[0] + 1, len(g)), F.lit(0).cast("long"), lambda k, s: k * 2 + s).alias(f"g{i}") for i, g in enumerate(GROUPS)]
    keys = []
    for n, four in enumerate(combinations(range(len(GROUPS)), 4)):
        key = F.lit(0).cast("long")
        for g in four:
            key = key * 2 ** len(GROUPS[g]) + F.col(f"g{g}")
        keys.append(F.struct(F.lit(n).alias("band"), key.alias("key")))
    return steps.select("fp", "d", *code).select("fp", "d", F.explode(F.array(*keys)).alias("k")).select("fp", "d", "k.band", "k.key")


def _near(a: Column, b: Column) -> Column:
    """a, b: struct(fp, d). No coordinate of the table differs by more than the limit (discards); no more bits differ (decides)."""
    apart = F.array_max(F.zip_with(a["d"], b["d"], lambda x, y: F.abs(x - y)))
    return (apart <= MAX_BITS) & (F.bit_count(a["fp"].bitwiseXOR(b["fp"])) <= MAX_BITS)


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct `fp`. Returns (a, b) links, enough to join what any chain of links joins.

    The distance table is made once and kept. Fingerprints of equal distance steps in four groups share a bucket; its
    pairs are discarded by their largest coordinate difference, survivors are verified. In a bucket of over MAX_BUCKET,
    pairs would grow with its square: there each fingerprint goes to the references within one bit of it. Two differ
    in at most two bits exactly if they share such a reference (their distances to it add up to two at most), and
    each has 65 of them, whatever the skew.
    """
    table = cut(fps.select("fp", pivot_distances(F.col("fp")).alias("d")))
    dealt = _dealt(table)
    size = dealt.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", dealt_anew("key").alias("key"), "n")
    shared = cut(dealt.join(size, ["band", "key"]))
    small = shared.where(F.col("n") <= MAX_BUCKET).groupBy("band", "key").agg(F.array_sort(F.collect_list(F.struct("fp", "d"))).alias("own"))
    pair = small.select("own", F.posexplode("own").alias("i", "a")).select("a", F.explode(F.expr("slice(own, i + 2, size(own))")).alias("b"))
    pairs = pair.where(_near(F.col("a"), F.col("b"))).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)).cast("long") for i in range(BITS)))
    crowded = shared.where(F.col("n") > MAX_BUCKET).select("fp").distinct()
    met = crowded.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("reference"))
    met = met.groupBy("reference").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    met = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(met)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """Per row of docs: doc_id, text_hash, fp (long), component_id (smallest doc_id reachable), is_first.

    Null, empty and blank texts have fingerprint zero and link like any other; very long texts are read whole. Repeated
    rows and equal texts share a fingerprint and so a component. Null ids are never a component's smallest unless it
    has no other. Other columns of docs are ignored, whatever their names. No documents give no rows. is_first: the row
    has the smallest (id, text_hash) of its component; rows repeated whole are all first, or none is.
    """
    rows = cut(docs.select(ref(doc_id).alias("doc_id"), F.xxhash64(ref(text)).alias("text_hash"), fingerprint_column(ref(text), shingle, seed).alias("fp")))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))).alias("first")
    fps = cut(rows.groupBy("fp").agg(first, F.min("text_hash").alias("any_hash")))
    joined = components(links(fps.select("fp")))
    root = F.coalesce(joined["b"], fps["fp"])
    rooted = fps.join(joined, fps["fp"] == joined["a"], "left").select(fps["fp"], "first", "any_hash", root.alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"), F.min("any_hash").alias("any_hash"))
    known = rooted.select("fp", "root").join(least.withColumn("root", dealt_anew("root")), "root").select("fp", "least", "any_hash")
    is_first = F.when(F.col("least").isNull(), F.col("text_hash") == F.col("any_hash")).otherwise(
        F.coalesce((F.col("doc_id") == F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash")), F.lit(False))
    )
    return rows.join(known, "fp").select("doc_id", "text_hash", "fp", F.col("least.doc_id").alias("component_id"), is_first.alias("is_first"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, that come first in their component; of rows repeated whole, one.

    Texts are shuffled once: the join and the removal of repeated rows take the same keys.
    """
    name, absent, own = free(docs, "_id", "_null", "_hash")
    key = lambda c: {name: F.coalesce(c.cast("string"), F.lit("")), absent: c.isNull()}
    found = near_duplicates(docs, doc_id, text, **how).where("is_first")
    keep = found.select(*(c.alias(k) for k, c in key(F.col("doc_id")).items()), F.col("text_hash").alias(own)).distinct()
    keyed = docs.withColumns({**key(ref(doc_id)), own: F.xxhash64(ref(text))})
    return keyed.join(keep, [name, absent, own], "left_semi").dropDuplicates([name, absent, own]).drop(name, absent, own)


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")

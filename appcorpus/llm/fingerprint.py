"""Document fingerprints: threshold-scaled sketches of word shingles, in JVM expressions only."""

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import free, ref, table

#: Words of a shingle: its hash is put together from those of 1, 2 and 4 words.
SHINGLE = 5
#: One shingle hash in 2**SCALE_BITS is kept: the fixed fraction, the same for every document and corpus.
SCALE_BITS = 3
#: Neighbours are found in ranges of about so many documents.
RANGE_ROWS = 4_000
#: Ranges at most; a row for each is broadcast. Beyond that, ranges grow and their sorts spill.
MAX_RANGES = 50_000
_LEAST = -(1 << 63)


def with_sketch(df: DataFrame, text: str, name: str, least: str) -> DataFrame:
    """df with the sketch of a text column: its shingles' hashes below the threshold, distinct and sorted.

    Shingles are runs of five words (lower case, split at ASCII white space); a shorter text is one shingle. Sketches
    merge by array_union: the union is the sketch of all shingles of both. A column `least` of its own has the text's
    smallest hash, null without words: it tells short texts apart of which no hash is below the threshold, and is never
    part of a sketch. Each step is a column of its own, so that no step is computed twice.
    """
    h, p, q, g = free(df, "_h", "_p", "_q", "_g")
    tokens = F.array_remove(F.split(F.lower(ref(text)), r"[\x20\x09-\x0D]+"), "")
    df = df.withColumn(h, F.transform(tokens, lambda w: F.xxhash64(w)))
    rest = lambda c, at: F.slice(c, at, F.greatest(F.size(c), F.lit(1)))
    df = df.withColumn(p, F.zip_with(h, rest(h, 2), lambda x, y: F.xxhash64(x, y)))  # words i, i + 1
    df = df.withColumn(q, F.zip_with(p, rest(p, 3), lambda x, y: F.xxhash64(x, y)))  # words i to i + 3
    five = F.zip_with(q, rest(h, SHINGLE), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn(g, F.slice(five, 1, F.greatest(F.size(h) - SHINGLE + 1, F.lit(1))))
    low = F.filter(g, lambda x: F.shiftrightunsigned(x, 64 - SCALE_BITS) == 0)
    return df.withColumn(name, F.array_sort(F.array_distinct(low))).withColumn(least, F.array_min(g)).drop(h, p, q, g)


def encoded(own: Column, least: Column) -> Column:
    """The sketch in hex; for a text with words and an empty sketch its smallest hash behind a dash."""
    one = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, one), "")).otherwise(F.coalesce(F.concat(F.lit("-"), one(least)), F.lit("")))


def likeness(a: Column, least_a: Column, b: Column, least_b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two texts without words. Of two empty sketches the smallest hashes decide."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), least_a.eqNullSafe(least_b).cast("double")).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, least_a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, whatever b's length; 1 for a without words, null where a's sketch is empty all the same."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).when(least_a.isNull(), 1.0)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs, all columns, with `sketch` (array of long), `least` (see with_sketch) and `fingerprint` (hex).

    Null and empty texts have an empty sketch and fingerprint; very long texts are read whole; repeated rows are alike;
    no documents give no rows. Columns of docs with these three names give way.
    """
    (own,) = free(docs, "_text")
    found = with_sketch(docs.withColumn(own, F.coalesce(ref(text), F.lit(""))), own, "sketch", "least")
    return found.withColumn("fingerprint", encoded(F.col("sketch"), F.col("least"))).drop(own)


def _order_key(docs: DataFrame, doc_id: str, text: str) -> Column:
    """A string that sorts as ids do: null ids first, whole numbers by value, other ids as strings by their bytes; then by a hash of the text."""
    ordered = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(_LEAST).cast("long"))), 16, "0")
    own = ref(doc_id)
    whole = isinstance(docs.schema[doc_id].dataType, IntegralType)
    at = ordered(own.cast("long")) if whole else F.hex(own.cast("string").cast("binary"))
    return F.concat(F.when(own.isNull(), "0").otherwise(F.concat(F.lit("1"), at)), F.lit("-"), ordered(F.xxhash64(F.coalesce(ref(text), F.lit("")))))


def _ranges(keys: DataFrame) -> tuple[Column, list[str]]:
    """The number of the range that `_key` is in, and each range's first key, in order (MAX_RANGES at most).

    Spark's own range partitioner deals the keys out by a sample of them, whatever they look like; the least one of each
    partition is an edge. A row's range is looked up in two steps, each over about the root of their number.
    """
    k = max(1, min(MAX_RANGES, keys.count() // RANGE_ROWS))
    dealt = keys.select("_key").repartitionByRange(k, "_key").select("_key", F.spark_partition_id().alias("p"))
    firsts = sorted(r.first for r in dealt.groupBy("p").agg(F.min("_key").alias("first")).collect()) or [""]
    each = math.isqrt(len(firsts) - 1) + 1
    groups = [firsts[i : i + each] for i in range(0, len(firsts), each)]
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    below = lambda edges: F.size(F.filter(edges, lambda x: x <= F.col("_key")))
    group = below(constant([g[0] for g in groups], "array<string>")) - 1
    return (group * each + below(F.get(constant(groups, "array<array<string>>"), group)) - 1).cast("long"), firsts


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, sketch, least, next: struct(text, sketch, least)); next: the document after it by id, after the last the first.

    Ids are dealt into ranges; the first document of each is also a guest at the end of the range before, so that a
    window over one range finds every successor. Whole numbers go by value, other ids as strings by their bytes, null
    ids first; equal ids go by a hash of the text, so no id is too frequent to be dealt out unless its rows are equal.
    """
    whole = isinstance(docs.schema[doc_id].dataType, IntegralType)
    own = docs.select((ref(doc_id) if whole else ref(doc_id).cast("string")).alias("id"), F.coalesce(ref(text), F.lit("")).alias("text"), _order_key(docs, doc_id, text).alias("_key"))
    bucket, firsts = _ranges(own.select("_key"))
    guests = [(first, (i - 1) % len(firsts), 1 if i else 2) for i, first in enumerate(firsts)]
    guest = docs.sparkSession.createDataFrame(guests, "_key string, _before long, _guest int")
    placed = with_sketch(own, "text", "sketch", "least").withColumn("_bucket", bucket).join(F.broadcast(guest), "_key", "left")
    seats = F.array_compact(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("g")), F.when(F.col("_before").isNotNull(), F.struct(F.col("_before").alias("b"), F.col("_guest").alias("g")))))
    seated = placed.select("id", "text", "sketch", "least", "_key", F.explode(seats).alias("_s"))
    order = Window.partitionBy("_s.b").orderBy("_s.g", "_key")
    return seated.withColumn("next", F.lead(F.struct("text", "sketch", "least")).over(order)).where("_s.g = 0").select("id", "text", "sketch", "least", "next")


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its fingerprint beside those of its edited text and of the next document.

    Edited: the last quarter of the code points (rounded down) gives way to as many of the next document's first ones.
    Null and empty texts have empty fingerprints; two of those are alike (1). Very long texts are read whole. Repeated
    rows follow each other. Other columns of docs are ignored, whatever their names; no documents give no rows, and a
    single one follows itself. Ids that aren't whole numbers come back as strings.
    """
    own = with_next(docs, doc_id, text).withColumn("n_chars", F.length("text"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    own = with_sketch(own.withColumn("edited", edited), "edited", "edited_sketch", "edited_least")
    a, b = (F.col("sketch"), F.col("least")), (F.col("edited_sketch"), F.col("edited_least"))
    return own.select(
        "id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encoded(*a).alias("fingerprint"), encoded(*b).alias("edited_fingerprint"),
        likeness(*a, *b).alias("near_edited"), likeness(*a, F.col("next.sketch"), F.col("next.least")).alias("near_next"),
        containment(*a, b[0]).alias("kept_share"),
    )


def op2(spark, sf_dir: str) -> DataFrame:
    return compared(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")

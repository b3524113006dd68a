"""Exact substring dedup: Rabin-Karp hashes of every window of words, counted over the whole corpus."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, dealt_anew, free, ref, table
from .tokens import SPACES, Rolling, Words, parts

WINDOW = 35
#: Words of the short grams that sort windows into comparable groups.
GRAM = 10


def _sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    width = 1
    while width * 2 <= size:
        x, width = np.minimum(x[:-width], x[width:]), width * 2
    return np.minimum(x[: len(x) - (size - width)], x[size - width :]) if size > width else x


def _lows(rolling: Rolling, window: int, gram: int) -> np.ndarray:
    """The smallest gram hash of the window at each word; equal windows have equal ones."""
    grams = rolling.windows(gram)
    return _sliding_min(grams, window - gram + 1) if len(grams) > window - gram else np.zeros(0, np.uint64)


def segments(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows of one text whose smallest gram hash is the same: (that hash, hash of the run's words, first word, windows).

    A window can only repeat in a run of the same hash.
    """
    rolling = Rolling(words.hashes)
    low = _lows(rolling, window, gram)
    whole = words.whole(window)[: len(low)]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | ~whole[:-1]
    first = np.zeros(len(low), bool)
    begins = words.offsets[:-1]
    first[begins[begins < len(low)]] = True
    start = np.flatnonzero(whole & (new | first))
    last = np.zeros(len(low), bool)
    last[:-1] = ~whole[1:] | (new | first)[1:]
    last[-1:] = True
    end = np.flatnonzero(whole & last) + 1
    return low[start], rolling.spans(start, end + window - 1), start, end - start


def _list(values: pa.Array, counts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum(np.concatenate(counts) if counts else np.zeros(0, np.int64))))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _whole(arrays: list[np.ndarray], kind=np.int64) -> pa.Array:
    return pa.array(np.concatenate(arrays).view(kind) if arrays else np.zeros(0, kind))


def _runs(window: int, gram: int):
    def batch(texts: pa.Array) -> pa.Array:
        keys, bodies, places, counts = [], [], [], []
        for _, _, words in parts(texts, SPACES == 0):
            key, body, start, length = segments(words, window, gram)
            owner = words.owner(start)
            keys.append(key)
            bodies.append(body)
            places.append((start - words.offsets[owner]) << 32 | length << 1)
            counts.append(np.bincount(owner, minlength=len(words.bounds) - 1))
        return _list(pa.StructArray.from_arrays([_whole(keys), _whole(bodies), _whole(places)], ["gram", "body", "place"]), counts)

    return lambda: batch


def _flat(lists: pa.Array, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and their row in the slice of a list column; null lists have none."""
    part = lists.slice(low, high - low)
    counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(high - low), counts)


def _covered(words: Words, start: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """Mask over `size` places of what the intervals cover."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, np.minimum(start + length, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _window_hashes(window: int, gram: int):
    """Of the windows in the doubtful runs: (first word, half the smallest gram hash, hash): 96 bits tell windows apart."""

    def batch(texts: pa.Array, runs: pa.Array) -> pa.Array:
        at, lows, found, counts = [], [], [], []
        for low, high, words in parts(texts, SPACES == 0):
            rolling = Rolling(words.hashes)
            own, least = rolling.windows(window), _lows(rolling, window, gram)
            places, row = _flat(runs, low, high)
            doubt = (places & 1) == 1
            places, row = places[doubt], row[doubt]
            where = np.flatnonzero(_covered(words, words.offsets[row] + (places >> 32), (places & 0xFFFFFFFF) >> 1, len(own)))
            owner = words.owner(where)
            at.append((where - words.offsets[owner]).astype(np.int32))
            lows.append((least[where] >> np.uint64(32)).astype(np.uint32).view(np.int32))
            found.append(own[where])
            counts.append(np.bincount(owner, minlength=high - low))
        return _list(pa.StructArray.from_arrays([_whole(at, np.int32), _whole(lows, np.int32), _whole(found, np.int64)], ["at", "gram", "hash"]), counts)

    return lambda: batch


def _repeated_inside(words: Words, window: int) -> np.ndarray:
    """First words of the windows that stand twice in one text."""
    where = np.flatnonzero(words.whole(window))
    if not len(where):
        return where
    owner = words.owner(where)
    own = Rolling(words.hashes).windows(window)[where] + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(own, kind="stable")
    same = (own[order[1:]] == own[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    twice = np.zeros(len(where), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return where[twice]


def cut_words(text: bytes, begins: list[int], intervals: list[int]) -> bytes:
    """The text without the words of the intervals; what stands between other words stays as it was. begins: of each word."""
    begins = [*begins, len(text)]
    out, at = [], 0
    for i, j in zip(intervals[::2], intervals[1::2]):
        out.append(text[at : begins[i]])
        at = begins[j]
    return b"".join((*out, text[at:]))


def _result(window: int, with_text: bool):
    def batch(texts: pa.Array, runs: pa.Array, singles: pa.Array) -> pa.Array:
        counts, gone_counts, digests, spans, kept = [], [], [], [], []
        known = texts.is_valid().to_pylist()
        for low, high, words in parts(texts, SPACES == 0):
            places, row = _flat(runs, low, high)
            sure = (places & 1) == 0
            places, row = places[sure], row[sure]
            alone, of = _flat(singles, low, high)
            inside = _repeated_inside(words, window)
            start = np.concatenate([words.offsets[row] + (places >> 32), words.offsets[of] + alone, inside])
            length = np.concatenate([((places & 0xFFFFFFFF) >> 1) + window - 1, np.full(len(alone) + len(inside), window)])
            gone = _covered(words, start, length, len(words.hashes))
            before = np.concatenate(([0], np.cumsum(gone)))
            removed = before[words.offsets[1:]] - before[words.offsets[:-1]]
            for i, n in enumerate(removed.tolist()):
                text, own = words.text(i), []
                left = tokens = text.split()
                if n:
                    a, b = words.offsets[i], words.offsets[i + 1]
                    mask = gone[a:b]
                    left = [t for t, g in zip(tokens, mask.tolist()) if not g]
                    own = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()
                    if with_text:
                        text = cut_words(text, (words.starts[a:b] - words.bounds[i]).tolist(), own)
                spans.append(own)
                counts.append(len(tokens))
                gone_counts.append(n)
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
                if with_text:
                    kept.append(text if known[low + i] else None)
        columns = [pa.array(counts, pa.int64()), pa.array(gone_counts, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.int64()))]
        names = ["n_words", "n_removed", "kept_sha256", "spans"]
        if with_text:
            columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
            names.append("kept_text")
        return pa.StructArray.from_arrays(columns, names)

    return lambda: batch


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, with_text: bool = False, out: str = "dedup") -> DataFrame:
    """docs with a struct column `dedup` (n_words, n_removed, kept_sha256, spans and, if asked for, kept_text).

    spans: maximal removal intervals as word positions (start, end, start, end, ...), end exclusive. Every window of
    the corpus is judged. (1) Runs of windows are keyed by their smallest gram hash and counted by key in Spark, with
    partial sums. A key that occurs once can't hold a repeat. (2) If all runs of a key have the same words, all their
    windows repeat. (3) Where they differ, the windows' own hashes are counted, told apart by 96 bits. (4) Windows
    that repeat within one text are found in its task. The verdicts go back to the runs by joins whose sides are both dealt
    out for them, so that adaptive execution splits the key of a passage that stands in a third of all rows.

    Null, empty and short texts lose nothing, and a null text stays null; very long texts are read whole; repeated rows
    and rows with one id are copies like any other; no documents give no rows. All columns are kept, whatever their
    names; one called as the result (`out`) gives way to it.
    """
    own, one, two, runs_, single_, a, b = free(docs, "_hash", "_k1", "_k2", "_runs", "_single", "_s1", "_s2")
    keyed = docs.withColumn(own, F.xxhash64(ref(text)))
    run = arrow_column(_runs(window, gram), "array<struct<gram:long,body:long,place:long>>", ref(text))
    dealt = keyed.select(ref(doc_id).alias(one), F.col(own).alias(two), run.alias("_r")).select(one, two, F.explode("_r").alias("_r")).select(one, two, "_r.*")
    again = dealt.groupBy("gram").agg(F.count("*").alias("n"), F.min("body").alias("low"), F.max("body").alias("high")).where("n > 1")
    again = again.select(dealt_anew("gram").alias("gram"), (F.col("low") != F.col("high")).cast("long").alias("doubt"))
    marked = dealt.select("gram", one, two, "place").join(again, "gram").select(one, two, F.col("place").bitwiseOR(F.col("doubt")).alias("place"))
    runs = marked.groupBy(one, two).agg(F.collect_set("place").alias(runs_))

    # both joins with the texts take the same columns of docs by the same keys, so that the texts are shuffled once
    def of(flags: DataFrame) -> Column:
        return keyed[f"`{doc_id}`"].eqNullSafe(flags[one]) & (keyed[own] == flags[two])

    doubtful = runs.where(F.exists(runs_, lambda p: p.bitwiseAND(F.lit(1).cast("long")) == 1))
    hashes = arrow_column(_window_hashes(window, gram), "array<struct<at:int,gram:int,hash:long>>", keyed[f"`{text}`"], doubtful[runs_])
    each = keyed.join(doubtful, of(doubtful)).select(one, two, hashes.alias("_w")).select(one, two, F.explode("_w").alias("_w")).select(one, two, "_w.*")
    often = each.groupBy("hash", "gram").agg(F.count("*").alias("n")).where("n > 1").select(dealt_anew("hash").alias("hash"), "gram")
    single = each.join(often, ["hash", "gram"], "left_semi").groupBy(one, two).agg(F.collect_set("at").alias(single_))
    single = single.select(F.col(one).alias(a), F.col(two).alias(b), single_)

    schema = "struct<n_words:long,n_removed:long,kept_sha256:string,spans:array<long>" + (",kept_text:string>" if with_text else ">")
    flags = runs.join(single, runs[one].eqNullSafe(single[a]) & (runs[two] == single[b]), "left").drop(a, b)
    rows = keyed.join(flags, of(flags), "left").drop(one, two, own)
    result = arrow_column(_result(window, with_text), schema, ref(text), F.col(runs_), F.col(single_))
    return rows.withColumn(out, result).drop(runs_, single_)


def op6(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_sha256")


def oracle_sql() -> str:
    return r"""
with t as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
w as (select r, unnest(range(1, len(w) - 33)) as p, w from t where len(w) >= 35),
g as (select r, p, array_to_string(w[p:p + 34], ' ') as s from w),
d as (select s from g group by s having count(*) > 1),
hit as (select distinct r, p + o.range as pos from g join d using (s) cross join range(0, 35) o),
gone as (select r, list(pos) as poss, count(*) as n from hit group by r),
k as (select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, case when n is null then w else list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(poss, x[2])), lambda x: x[1]) end as kept from t left join gone using (r))
select doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from k
"""

"""Phrase collocation mining: Rabin-Karp fingerprints of all n-grams, counted level by level; only frequent phrases become text."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from appcorpus.shipping import ship

from .common import cut, ref, table
from .tokens import LOWER, Rolling, Words, mixed, parts

LONGEST = 5
MIN_COUNT = 100
TOP = 2_000
#: A phrase goes if a longer one has so many hundredths of its occurrences at least.
COVERED = 100
UNKNOWN = "und"

# Bytes that end a piece (. , ; : ! ? and line ends) and those that end a word only.
BREAKS = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
INSIDE = ~(BREAKS | np.isin(np.arange(256), [0x20, 0x09]))
_TO_SPACE = np.where(INSIDE, np.arange(256), 0x20).astype(np.uint8)
#: 64-bit words of a filter at most (64 MB); with more frequent n-grams than about four a word it lets more pass, which costs rows only.
MAX_FILTER_WORDS = 1 << 23
#: Fingerprints that a task holds before it sums them up, and sums that it holds before it sends them on.
HELD, SENT = 2_000_000, 1_000_000
#: Phrases that a task of the last pass holds as text, and splits of the input that it reads once every core has some.
HELD_PHRASES, SPLITS_OF_TASK = 250_000, 16


class Filter:
    """Bits of frequent fingerprints: never misses one, lets few others pass. Each has three bits in one 64-bit word."""

    def __init__(self, words: np.ndarray):
        self.words, self.shift = words, np.uint64(64 - (len(words).bit_length() - 1))

    def passes(self, prints: np.ndarray) -> np.ndarray:
        found = self.words[(prints >> self.shift).astype(np.int64)]
        ok = np.ones(len(prints), bool)
        for k in range(3):
            ok &= (found >> ((prints >> np.uint64(6 * k)) & np.uint64(63))) & np.uint64(1) > 0
        return ok


def _filter(prints: DataFrame, n: int) -> Filter:
    """prints: n rows of `fp`. Words are put together in Spark; of fixed size at most, whatever n, they come to the driver."""
    size = min(MAX_FILTER_WORDS, 1 << max(1, (n // 4).bit_length()))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("fp", 6 * k).bitwiseAND(63).cast("int"))
    at = F.shiftrightunsigned("fp", 64 - (size.bit_length() - 1)).alias("at")
    own = prints.select(at, bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2)).alias("bits")).groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size, np.uint64)
    words[own["at"].to_numpy()] = own["bits"].to_numpy().view(np.uint64)
    return Filter(words)


class Grams:
    """n-grams of some texts' words that lie in one piece of one text, told apart by language too."""

    def __init__(self, words: Words, langs: np.ndarray, bits: int):
        self.words, self.rolling, self.spare = words, Rolling(words.hashes), np.uint64(64 - bits)
        mark = BREAKS[words.data].astype(np.int32)
        begins = words.bounds[:-1]
        mark[begins[begins < len(mark)]] += 1
        self.piece = np.cumsum(mark, dtype=np.int32)[words.starts]
        self.owner = words.owner(np.arange(len(words.hashes)))
        self.lang = langs[self.owner] if len(self.owner) else np.zeros(0, np.uint64)

    def starts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1]) if len(self.piece) >= n else np.zeros(0, np.int64)

    def prints(self, n: int, at: np.ndarray) -> np.ndarray:
        return mixed(self.rolling.spans(at, at + n) ^ self.lang[at]) >> self.spare << self.spare

    def frequent(self, n: int, known: Filter | None) -> np.ndarray:
        """Fingerprints of the n-grams of which both (n - 1)-grams pass."""
        at = self.starts(n)
        if known is not None and len(at):
            shorter = self.starts(n - 1)
            ok = np.zeros(len(self.piece) + 1, bool)
            ok[shorter] = known.passes(self.prints(n - 1, shorter))
            at = at[ok[at] & ok[at + 1]]
        return self.prints(n, at)


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), 13)


def _grams(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[Grams, list[str]]]:
    langs, seeds = batch.column(0).to_pylist(), {}
    for low, high, words in parts(batch.column(1), INSIDE, LOWER):
        own = langs[low:high]
        yield Grams(words, np.array([seeds.setdefault(x, _seed(x)) for x in own], np.uint64), bits), own


_COUNTS = pa.schema([("fp", pa.int64()), ("c", pa.int64())])


def _summed(prints: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    whole, which = np.unique(np.concatenate(prints), return_inverse=True)
    return whole, np.bincount(which, np.concatenate(counts), len(whole)).astype(np.int64)


def _count_level(n: int, sent, bits: int):
    """Sums of fingerprints, a task's own together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value if sent is not None else None
        prints, counts, held = [], [], 0
        for batch in batches:
            for grams, _ in _grams(batch, bits):
                found = grams.frequent(n, known)
                prints.append(found)
                counts.append(np.ones(len(found), np.int64))
                held += len(found)
                if held >= HELD:
                    prints, counts = ([x] for x in _summed(prints, counts))
                    held = len(prints[0])
                    if held >= SENT:
                        yield pa.record_batch([pa.array(prints[0].view(np.int64)), pa.array(counts[0])], _COUNTS)
                        prints, counts, held = [], [], 0
        if held:
            whole, sums = _summed(prints, counts)
            yield pa.record_batch([pa.array(whole.view(np.int64)), pa.array(sums)], _COUNTS)

    return run


_TEXTS = pa.schema([("lang", pa.string()), ("size", pa.int64()), ("phrase", pa.string()), ("c", pa.int64())])


def _verified(grams: Grams, known: Filter, longest: int) -> Iterator[tuple[int, int, int]]:
    """(n, place of one occurrence, occurrences) of each n-gram of a frequent fingerprint, told apart by its words.

    Pointers to all occurrences of a fingerprint are followed: their words are compared with those at the first. Words
    are numbered by their bytes for that. Occurrences that say something else are counted by themselves. As in the passes
    before, an n-gram one of whose shorter ones doesn't pass isn't frequent, whatever the filter says of it.
    """
    texts = [grams.words.text(i).translate(_TO_SPACE.tobytes()).split() for i in range(len(grams.words.bounds) - 1)]
    flat = [w for t in texts for w in t]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in flat), np.int64, len(flat))
    grams.flat = flat
    shorter = np.ones(len(grams.piece) + 1, bool)
    for n in range(1, longest + 1):
        at = grams.starts(n)
        at = at[shorter[at] & shorter[at + 1]]
        prints = grams.prints(n, at)
        ok = known.passes(prints)
        at, prints = at[ok], prints[ok]
        if not len(at):
            return
        shorter = np.zeros(len(grams.piece) + 1, bool)
        shorter[at] = True
        first, which = np.unique(prints, return_index=True, return_inverse=True)[1:]
        same = np.ones(len(at), bool)
        for k in range(n):
            same &= ids[at + k] == ids[at[first] + k][which]
        same &= grams.lang[at] == grams.lang[at[first]][which]
        counts = np.bincount(which[same], minlength=len(first))
        yield from ((n, int(at[f]), int(c)) for f, c in zip(first, counts))
        others = Counter((int(grams.lang[i]), *(ids[i : i + n].tolist())) for i in at[~same])
        places = {(int(grams.lang[i]), *(ids[i : i + n].tolist())): int(i) for i in at[~same]}
        yield from ((n, places[key], c) for key, c in others.items())


def _phrase_counts(sent, longest: int, bits: int):
    """(lang, size, phrase, c) of every phrase of a frequent fingerprint in a task's texts; size 0: all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out(keys: list) -> pa.RecordBatch:
            return pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2].decode() for k in keys], pa.string()), pa.array([found.pop(k) for k in keys], pa.int64())], _TEXTS)

        for batch in batches:
            for grams, langs in _grams(batch, bits):
                for lang, words in zip(langs, grams.words.counts().tolist()):
                    found[lang, 0, b""] += words
                for n, at, c in _verified(grams, sent.value, longest):
                    found[langs[grams.owner[at]], n, b" ".join(grams.flat[at : at + n])] += c
                if len(found) >= HELD_PHRASES:  # the rarer half goes on; what is frequent here comes again
                    most = sorted(found.values())[len(found) // 2]
                    yield out([k for k, c in found.items() if c <= most])
        if found:
            yield out(list(found))

    return run


def _few_tasks(docs: DataFrame) -> DataFrame:
    """Every task sends each frequent phrase that it has, so rows would grow with splits times phrases: a task reads several splits."""
    return docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // SPLITS_OF_TASK))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT, bits: int = 64) -> DataFrame:
    """(lang, size, phrase, c): exact counts of all phrases of up to `longest` words that occur `min_count` times in a language; size 0, an empty phrase: all its words.

    One pass for each length: tasks hash every n-gram of which both shorter ones are frequent and sum up what is the same; the
    shuffle adds the sums by fingerprint. What is frequent goes to the next pass as a filter of bounded size, which misses
    nothing. A last pass goes back to the text: occurrences of frequent fingerprints are compared word by word and counted as
    what they say, so a collision of fingerprints never changes a count. `bits`: width of the fingerprints.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.coalesce(ref(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), ref(text).alias("text"))
    frequent, sent, broadcasts = [], None, []
    for n in range(1, longest + 1):
        rows = own.mapInArrow(_count_level(n, sent, bits), "fp long, c long")
        level = cut(rows.groupBy("fp").agg(F.sum("c").alias("c")).where(F.col("c") >= min_count).select("fp"))
        size = level.count()
        if not size:
            break
        frequent.append((level, size))
        if n < longest:
            sent = spark.sparkContext.broadcast(_filter(level, size))
            broadcasts.append(sent)
    every, total = None, 0
    for level, size in frequent:
        every, total = (level if every is None else every.unionByName(level)), total + size
    if every is None:
        every = spark.createDataFrame([], "fp long")
    sent = spark.sparkContext.broadcast(_filter(every, total))
    broadcasts.append(sent)
    said = _few_tasks(own).mapInArrow(_phrase_counts(sent, longest, bits), "lang string, size long, phrase string, c long")
    counts = cut(said.groupBy("lang", "size", "phrase").agg(F.sum("c").alias("c")).where((F.col("size") == 0) | (F.col("c") >= min_count)))
    for b in broadcasts:
        b.destroy()
    return counts


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, min_count: int = MIN_COUNT, covered: int = COVERED, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` phrases of two words or more of each language.

    a: the phrase's occurrences; its score is the least of floor(1000 a n / (l r)) over all cuts into a first part (l occurrences)
    and a rest (r), n being all words of the language. A phrase goes if a longer frequent one holds it and has `covered` hundredths
    of its occurrences or more; as counts only fall with length, those of one word more decide. Order: score, then a, both
    falling, then the phrase by its bytes. The ranking first takes the top of 64 parts of a language.

    Null and empty texts have no words; a null language is `und`; very long texts are mined whole; repeated rows count as often as they
    stand; of cuts with one score the shortest first part counts; languages without a frequent phrase, and no documents, give no
    rows. Other columns of docs are ignored, whatever their names.
    """
    counts = phrase_counts(docs, text, lang, longest, min_count, bits)
    total = counts.where("size = 0").select("lang", F.col("c").alias("n"))
    known = counts.where("size > 0").select("lang", "phrase", "size", "c")
    words = F.split("phrase", " ", -1)
    part = lambda low, size: F.array_join(F.slice(F.col("w"), low, size), " ")
    long = known.where("size > 1").withColumn("w", words)
    # a phrase's two parts of one word less
    inner = long.where("size > 2").select("lang", "c", F.explode(F.array(part(F.lit(1), F.col("size").cast("int") - 1), part(F.lit(2), F.col("size").cast("int") - 1))).alias("phrase"))
    over = inner.groupBy("lang", "phrase").agg(F.max("c").alias("longer"))
    kept = long.join(over, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(covered) * F.col("c")))
    cuts = kept.select("lang", "phrase", F.col("c").alias("a"), "w", "size", F.explode(F.sequence(F.lit(1), F.col("size").cast("int") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("size").cast("int") - F.col("k")).alias("tail"))
    heads, tails = known.select("lang", F.col("phrase").alias("head"), F.col("c").alias("l")), known.select("lang", F.col("phrase").alias("tail"), F.col("c").alias("r"))
    scored = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(F.broadcast(total) if total.count() <= 10_000 else total, "lang")
    score = F.expr("1000 * cast(a as decimal(19,0)) * cast(n as decimal(16,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = scored.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("_at", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_at") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def oracle_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
with p as (select coalesce(lang, '{UNKNOWN}') as lang, unnest(regexp_split_to_array({lower}, '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
t as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, s, w[i:i + s - 1] as x from (select lang, w, s, unnest(range(1, len(w) - s + 2)) as i from (select lang, w, unnest(range(1, {LONGEST + 1})) as s from w) where len(w) >= s)),
f as (select lang, s, x, count(*) as c from g group by all having count(*) >= {MIN_COUNT}),
o as (select lang, x, max(c) as c from (select lang, x[1:s - 1] as x, c from f where s > 2 union all select lang, x[2:s] as x, c from f where s > 2) group by all),
k as (select f.* from f left join o using (lang, x) where s > 1 and (o.c is null or 100 * o.c < {COVERED} * f.c)),
c as (select k.lang, k.x, k.c as a, k.s, unnest(range(1, k.s)) as k from k),
j as (select c.lang, c.x, c.a, c.k, l.c as l, r.c as r, t.n, ((1000::hugeint * c.a * t.n) // (l.c::hugeint * r.c))::bigint as score
  from c join f l on l.lang = c.lang and l.x = c.x[1:c.k] join f r on r.lang = c.lang and r.x = c.x[c.k + 1:c.s] join t on t.lang = c.lang),
b as (select *, array_to_string(x, ' ') as phrase from j qualify row_number() over (partition by lang, x order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from b
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {TOP}
"""

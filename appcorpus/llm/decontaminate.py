"""Benchmark decontamination: a hash set of the benchmark's n-grams goes to every task, which scans its documents."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, free, ref, table
from .tokens import LETTERS, LOWER, Rolling, Words, parts

WINDOW = 10
#: Words of benchmark text in one broadcast set; a larger benchmark is scanned in several sets, one after another. A word
#: takes about 50 bytes there (measured: 50.6 MB for a million), so a set is about 100 MB in the driver and in each Python worker.
MAX_SET_WORDS = 2_000_000


class WindowSet:
    """Windows of a block of items as sorted hashes, with the words to verify hits by and the items that they belong to."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        texts = pa.array([text for _, text in items], pa.large_binary())
        vocabulary, blob, starts, ends, found = [np.zeros(0, np.uint64)], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        at = n_words = 0
        for low, _, words in parts(texts, LETTERS, LOWER):
            vocabulary.append(words.hashes)
            rolling, counts = Rolling(words.hashes), words.counts()
            blob.append(words.data)
            starts.append(words.starts + at)
            ends.append(words.ends + at)
            for n in np.unique(np.minimum(counts[counts > 0], window)).tolist():
                whole = words.whole(n)
                if n < window:
                    whole[np.repeat(counts, counts) != n] = False
                first = np.flatnonzero(whole)
                owner = np.array([number[items[low + i][0]] for i in words.owner(first).tolist()], np.int32)
                found.append((n, rolling.windows(n)[first], first + n_words, owner))
            at, n_words = at + len(words.data), n_words + len(words.hashes)
        self.vocabulary = np.unique(np.concatenate(vocabulary))
        self.data = np.concatenate(blob) if blob else np.zeros(0, np.uint8)
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        self.sizes = sorted({n for n, *_ in found})
        self.windows = {n: self._index(n, *(np.concatenate([f[k] for f in found if f[0] == n]) for k in (1, 2, 3))) for n in self.sizes}

    def words(self, first: int, n: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[first : first + n].tolist(), self.ends[first : first + n].tolist())]

    def _index(self, n: int, hashes: np.ndarray, first: np.ndarray, owner: np.ndarray):
        """(hashes, first word, where its items begin, items), a row for each different window, by hash."""
        order = np.lexsort((owner, hashes))
        hashes, first, owner = hashes[order], first[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        for k in np.flatnonzero(~new).tolist():  # equal hashes of different words stay apart
            new[k] = self.words(first[k - 1], n) != self.words(first[k], n)
        own = np.flatnonzero(new)
        return hashes[own], first[own], np.append(own, len(hashes)), owner

    def scan(self, words: Words) -> tuple[list[list[int]], list[list[str]]]:
        """For each text the word intervals of the occurrences, flat, and the items they belong to."""
        texts = len(words.bounds) - 1
        spans, items = [[] for _ in range(texts)], [set() for _ in range(texts)]
        place = np.minimum(np.searchsorted(self.vocabulary, words.hashes), max(len(self.vocabulary) - 1, 0))
        known = np.concatenate(([0], np.cumsum(self.vocabulary[place] == words.hashes))) if len(self.vocabulary) else np.zeros(len(words.hashes) + 1)
        rolling = None
        for n in self.sizes:
            start = np.flatnonzero(known[n:] - known[:-n] == n) if len(words.hashes) >= n else np.zeros(0, np.int64)
            if not len(start):
                continue
            hashes, first, begins, owner = self.windows[n]
            rolling = rolling or Rolling(words.hashes)
            own = rolling.windows(n)[start]
            row = np.searchsorted(hashes, own)
            hit = hashes[np.minimum(row, len(hashes) - 1)] == own
            start, row = start[hit], row[hit]
            inside = words.whole(n)[start]
            start, row = start[inside], row[inside]
            for at, k, text in zip(start.tolist(), row.tolist(), words.owner(start).tolist()):
                said = [words.data[a:b].tobytes() for a, b in zip(words.starts[at : at + n].tolist(), words.ends[at : at + n].tolist())]
                value = hashes[k]
                while k < len(hashes) and hashes[k] == value:
                    if self.words(first[k], n) == said:
                        low = at - int(words.offsets[text])
                        spans[text] += [low, low + n]
                        items[text].update(owner[begins[k] : begins[k + 1]].tolist())
                        break
                    k += 1
        return spans, [sorted(self.names[k] for k in own) for own in items]


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _cut_bytes(text: bytes, words: Words, i: int, spans: list[int]) -> bytes:
    a, base = int(words.offsets[i]), int(words.bounds[i])
    begins, ends = words.starts[a : int(words.offsets[i + 1])] - base, words.ends[a : int(words.offsets[i + 1])] - base
    out, at = [], 0
    for x, y in zip(spans[::2], spans[1::2]):
        out.append(text[at : begins[x]])
        at = int(begins[y]) if y < len(begins) else int(ends[y - 1])
    return b"".join((*out, text[at:]))


_KINDS = {"n_words": pa.int64(), "n_hit": pa.int64(), "items": pa.list_(pa.string()), "items_sha256": pa.string(), "spans": pa.list_(pa.int64()), "clean_text": pa.string()}


def _scan(broadcast, with_text: bool, earlier: bool):
    """One set's scan of whole texts. earlier: the struct column of the sets before comes too and is added to."""

    def make():
        windows = broadcast.value

        def batch(texts: pa.Array, before: pa.Array | None = None) -> pa.Array:
            rows, valid = {k: [] for k in _KINDS}, texts.is_valid().to_pylist()
            old = before.to_pylist() if before is not None else None
            raw = texts.cast(pa.large_binary()) if with_text else None
            for low, high, words in parts(texts, LETTERS, LOWER):
                for i, (n, spans, items) in enumerate(zip(words.counts().tolist(), *windows.scan(words))):
                    if old:
                        spans, items = spans + old[low + i]["spans"], sorted({*items, *old[low + i]["items"]})
                    spans = _merged(spans)
                    rows["n_words"].append(n)
                    rows["n_hit"].append(sum(spans[1::2]) - sum(spans[::2]))
                    rows["items"].append(items)
                    rows["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
                    rows["spans"].append(spans)
                    if with_text:
                        text = raw[low + i].as_py()
                        rows["clean_text"].append(_cut_bytes(text, words, i, spans) if valid[low + i] and spans else text)
            names = list(_KINDS)[: 5 + with_text]
            columns = [pa.array(rows[k], pa.binary()).cast(pa.string()) if k == "clean_text" else pa.array(rows[k], _KINDS[k]) for k in names]
            return pa.StructArray.from_arrays(columns, names)

        return batch

    return make


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_set_words: int = MAX_SET_WORDS, with_text: bool = False, out: str = "hit") -> DataFrame:
    """docs, all columns, with a struct column `hit`: n_words, n_hit, items, items_sha256, spans and, if asked for, clean_text.

    spans: merged word intervals (start, end, ...) of the occurrences, each found by its hash and verified by its words. The
    documents are read once and never shuffled. The benchmark's size is counted first; beyond max_set_words it is dealt by a hash
    of item_id into as many sets as keep to that bound, each broadcast to a scan of its own that adds to the same row.

    Null texts have no words and stay null; very long texts are scanned whole; empty items have no windows; items of fewer words than
    the window are one window; a null item_id reads as an empty string; repeated items are one, repeated rows are alike. An
    empty benchmark hits nothing; no documents give no rows. All columns are kept, whatever their names; one called as the result (`out`) gives
    way to it.
    """
    items = benchmark.select(F.coalesce(ref(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(ref(item_text), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 2 + 1  # a word and its end take two characters at least
    sets, session = -(-size // max_set_words), docs.sparkSession
    schema = "struct<n_words:long,n_hit:long,items:array<string>,items_sha256:string,spans:array<long>" + (",clean_text:string>" if with_text else ">")
    (found,) = free(docs, "_found")
    rows = docs
    for k in range(sets):
        block = items if sets == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(sets)) == k)
        shared = session.sparkContext.broadcast(WindowSet([(r.item, r.text.encode()) for r in block.toLocalIterator()], window))
        columns = (ref(text), F.col(found)) if k else (ref(text),)
        rows = rows.withColumn(found, arrow_column(_scan(shared, with_text, k > 0), schema, *columns))
    return rows.withColumn(out, F.col(found)).drop(found)


def op3(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "hit.n_words", "hit.n_hit", F.size("hit.items").cast("long").alias("n_items"), "hit.items_sha256", (F.col("hit.n_hit") > 0).alias("contaminated"))


def oracle_sql() -> str:
    return r"""
with low as (select row_number() over () as r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as s from documents),
t as (select r, doc_id, regexp_extract_all(s, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from low),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct cast(item_id as varchar) as item, least(len(w), 10) as n, array_to_string(w[p:p + 9], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from b where len(w) > 0)),
tw as (select r, p, n.n as n, array_to_string(w[p:p + n.n - 1], ' ') as g from (select r, w, unnest(range(1, len(w) + 1)) as p from t) cross join (select distinct n from bw) n where p + n.n - 1 <= len(w)),
hit as (select r, p, tw.n as n, item from tw join bw on tw.g = bw.g and tw.n = bw.n),
c as (select r, count(distinct pos) as n_hit from (select r, unnest(range(p, p + n)) as pos from hit) group by r),
i as (select r, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct r, item from hit) group by r)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from t left join c using (r) left join i using (r)
"""

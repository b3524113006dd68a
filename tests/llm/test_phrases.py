import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from appcorpus.llm import phrases

from test_operators import TEXTS, docs, empty


def by_hand(rows, longest=5, min_count=100, covered=100, top=2000):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            counts.update((lang, tuple(w[i : i + n])) for n in range(1, longest + 1) for i in range(len(w) - n + 1))
    frequent = {k: c for k, c in counts.items() if c >= min_count}
    covers = defaultdict(int)
    for (lang, w), c in frequent.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if j - i < len(w):
                    covers[lang, w[i:j]] = max(covers[lang, w[i:j]], c)
    out = defaultdict(list)
    for (lang, w), a in frequent.items():
        if len(w) > 1 and not 100 * covers[lang, w] >= covered * a:
            cuts = [(1000 * a * total[lang] // (frequent[lang, w[:k]] * frequent[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), frequent[lang, w[:k]], frequent[lang, w[k:]]))
    return {(lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1)}


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["New", "york", "the", "of", "machine", "learning", "über", "ß", "a b", "x" * 40, "１", "the"]
    out = []
    for _ in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        for _ in range(3):
            w[rng.randrange(len(w) + 1) : 0] = rng.choice([["new", "york", "city", "hall"], ["machine", "learning"], ["in", "terms", "of", "the", "law"]])
        out.append("".join(x + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "! "]) for x in w))
    return out


@pytest.mark.parametrize("how", [{"min_count": 20}, {"min_count": 5, "covered": 60, "top": 7, "longest": 3}, {"min_count": 3, "bits": 9}, {"min_count": 10**6}])
def test_same_as_by_hand(spark, how):
    texts = TEXTS + made(1)
    rows = docs(spark, texts).unionByName(docs(spark, made(2)).withColumn("lang", F.lit("fr"))).repartition(5)
    expected = by_hand([(r.lang, r.text) for r in rows.select("lang", "text").collect()], **{k: v for k, v in how.items() if k != "bits"})
    got = [tuple(r) for r in phrases.collocations(rows, **how).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and (expected or how["min_count"] > 1000)
    assert phrases.collocations(empty(spark), **how).count() == 0


def test_a_task_s_sums_are_sent_on(spark, monkeypatch):
    """What a task holds is bounded; smaller bounds give the same rows."""
    rows = [("en", t) for t in made(3, 40)]
    batch = phrases.pa.record_batch([phrases.pa.array([r[0] for r in rows]), phrases.pa.array([r[1] for r in rows])], ["lang", "text"])
    whole = list(phrases._count_level(1, None, 64)([batch]))
    monkeypatch.setattr(phrases, "HELD", 5)
    monkeypatch.setattr(phrases, "SENT", 3)
    parts = list(phrases._count_level(1, None, 64)([batch, batch]))
    sums = lambda x, times: {k: times * v for k, v in Counter({p: sum(c for b in x for q, c in zip(*(y.to_pylist() for y in b.columns)) if q == p) for b in x for p in b.column(0).to_pylist()}).items()}
    assert len(parts) > 1 and sums(parts, 1) == sums(whole, 2)


def test_long_language_key_and_products_beyond_64_bits(spark):
    """1000 a n passes 64 bits; the quotient is exact."""
    counts = spark.createDataFrame([("en", 0, "", 9 * 10**15), ("en", 1, "a", 3 * 10**12), ("en", 1, "b", 7 * 10**12), ("en", 2, "a b", 10**12 + 1)], "lang string, size long, phrase string, c long")
    original = phrases.phrase_counts
    phrases.phrase_counts = lambda *a, **k: counts
    try:
        (row,) = phrases.collocations(empty(spark)).collect()
    finally:
        phrases.phrase_counts = original
    assert row.score == 1000 * (10**12 + 1) * 9 * 10**15 // (3 * 10**12 * 7 * 10**12)


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_filter_misses_nothing(spark, n):
    prints = np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
    found = phrases._filter(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long"), n)
    assert found.passes(prints).all()
    if n == 1000:
        others = np.random.default_rng(99).integers(0, 1 << 63, 100_000, np.uint64) * np.uint64(2) + np.uint64(1)
        assert found.passes(others).mean() < 0.1


def batch_of(rows):
    return phrases.pa.record_batch([phrases.pa.array([r[0] for r in rows]), phrases.pa.array([r[1] for r in rows])], ["lang", "text"])


class Sent:
    def __init__(self, value):
        self.value = value


def test_last_pass_takes_no_phrase_without_its_parts():
    """A filter may let an n-gram through by accident; its row goes only if both shorter n-grams pass too."""
    ((grams, _),) = phrases._grams(batch_of([("en", "one two three")]), 64)
    prints = [int(x) for n, at in ((1, 0), (1, 1), (2, 0), (2, 1)) for x in grams.prints(n, np.array([at]))]

    class Exactly:
        def passes(self, found):
            return np.isin(found, np.array(prints, np.uint64))

    assert {(n, at) for n, at, _ in phrases._verified(grams, Exactly(), 5)} == {(1, 0), (1, 1), (2, 0)}


def test_last_pass_reads_many_splits_in_few_tasks(spark):
    rows = docs(spark, made(5, 64)).repartition(64)
    tasks = phrases._few_tasks(rows.select("lang", "text")).rdd.getNumPartitions()
    assert tasks <= max(spark.sparkContext.defaultParallelism, 4) < 64


def test_last_pass_keeps_what_is_frequent(monkeypatch):
    """With little room the rarer half is sent on; sums stay the same, and fewer rows go than if all went."""
    monkeypatch.setattr(phrases, "HELD_PHRASES", 20)
    monkeypatch.setattr("appcorpus.llm.tokens.PART_BYTES", 200)
    everything = phrases.Filter(np.full(2, 2**64 - 1, np.uint64))
    texts = [("en", f"always here {i} {i + 1} {i + 2}") for i in range(200)]
    rows = [r for b in phrases._phrase_counts(Sent(everything), 2, 64)([batch_of(texts)]) for r in b.to_pylist()]
    sums = Counter()
    for r in rows:
        sums[r["size"], r["phrase"]] += r["c"]
    expected = Counter({(0, ""): 5 * len(texts)})
    for _, text in texts:
        w = text.split()
        expected.update((n, " ".join(w[i : i + n])) for n in (1, 2) for i in range(len(w) - n + 1))
    assert sums == expected
    assert sum(r["phrase"] == "always here" for r in rows) == 1

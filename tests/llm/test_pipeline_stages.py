"""Each stage on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, against brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from appcorpus.llm import mixing, simhash

from test_operators import TEXTS, docs, empty, wordlist

STAGES = dict(corpus_pipeline.STAGES)
ITEMS = [(1, " ".join(f"shared{i}" for i in range(20, 40))), (2, "two words"), (3, None)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, [*TEXTS, "12 34 !!", LAST]).withColumn("n_chars", F.length("text").cast("long")).cache()


LAST = "the same text twice over " * 20


def rows_of(df):
    return Counter(map(str, df.collect()))


@pytest.mark.parametrize("name", STAGES)
def test_empty_table(spark, sf_dir, name):
    out = STAGES[name](spark, empty(spark).drop("size"), sf_dir)
    assert out.count() == 0 and out.columns[: len(empty(spark).columns) - 1] == empty(spark).drop("size").columns


def test_language(spark, sf_dir, table):
    kept = rows_of(STAGES["language"](spark, table, sf_dir))
    assert kept == Counter(str(r) for r in table.collect() if any(c.isalpha() for c in r.text or ""))


def test_near_duplicates(spark, sf_dir, table):
    kept, rows = STAGES["near_duplicates"](spark, table, sf_dir).collect(), table.collect()
    fp = {t: simhash.fingerprint((t or "").encode()) for t in {r.text for r in rows}}
    group = {f: f for f in fp.values()}
    for _ in group:
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[group[fp[r.text]]] = min(least.get(group[fp[r.text]], r.doc_id), r.doc_id)
    # one row of each component, of its smallest id (null if none has an id); every column as it was
    assert Counter(group[fp[r.text]] for r in kept) == Counter({group[fp[r.text]] for r in rows}) and all(r.doc_id == least.get(group[fp[r.text]]) for r in kept)
    assert rows_of(spark.createDataFrame(kept, table.schema)) <= rows_of(table)


def test_substrings(spark, sf_dir, table):
    counts = Counter(tuple(t[i : i + 35]) for r in table.collect() for t in [(r.text or "").split()] for i in range(len(t) - 34))
    expected = Counter()
    for r in table.collect():
        t = (r.text or "").split()
        gone = {j for i in range(len(t) - 34) if counts[tuple(t[i : i + 35])] > 1 for j in range(i, i + 35)}
        expected[r.doc_id, r.text is None, " ".join(w for j, w in enumerate(t) if j not in gone)] += 1
    out = STAGES["substrings"](spark, table, sf_dir).collect()
    assert Counter((r.doc_id, r.text is None, " ".join((r.text or "").split())) for r in out) == expected
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


def test_benchmark(spark, sf_dir, table):
    expected = Counter()
    for r in table.collect():
        t, gone = wordlist(r.text), set()
        for _, item in ITEMS:
            own = wordlist(item)
            for w in {tuple(own[i : i + 10]) for i in range(max(len(own) - 9, 1))} if own else ():
                gone |= {j for i in range(len(t) - len(w) + 1) if tuple(t[i : i + len(w)]) == w for j in range(i, i + len(w))}
        expected[r.doc_id, r.text is None, " ".join(w for j, w in enumerate(t) if j not in gone)] += 1
    out = STAGES["benchmark"](spark, table, sf_dir).collect()
    assert Counter((r.doc_id, r.text is None, " ".join(wordlist(r.text))) for r in out) == expected
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


def test_mixture(spark, sf_dir, table):
    rows, sizes = table.collect(), Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").split())
    targets = mixing.source_targets(dict(sizes), sum(sizes.values()))
    out = STAGES["mixture"](spark, table.drop("size"), sf_dir).collect()
    taken = Counter()
    for r in out:
        assert r["size"] == len(r.text.split()) and r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 and 0 < r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    largest = {s: max(len((r.text or "").split()) for r in rows if r.source == s) for s in sizes}
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)


def test_whole_pipeline_matches_brute_force_of_its_stages(spark, sf_dir, table):
    """run() over a small corpus is its stages one after another, each on what the one before kept."""
    table.drop("size").write.mode("overwrite").parquet(f"{sf_dir}/documents.parquet")
    now = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for stage in STAGES.values():
        now = spark.createDataFrame(stage(spark, now, sf_dir).collect(), stage(spark, now, sf_dir).schema)
    assert rows_of(corpus_pipeline.run(spark, sf_dir)) == rows_of(now)

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from appcorpus.llm import infill

from test_operators import SCHEMA, TEXTS, docs, empty

TOKENS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MORE = ["ünïcode çuts über  allés\t\n ", " lead", "a <P> b c", "a<S>b", "x<M>", "<P", "<P <S <M > a b c d e f g h", "emoji 😀 𝒳 \U0001f600 end", "\x0b\x0c", "nb sp a b"]


def by_hand(doc_id, text, rate=50, suffix_first=80, marks=("<P>", "<S>", "<M>"), seed=42):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = re.findall(TOKENS, text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return n, "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


@pytest.mark.parametrize("how", [{}, {"rate": 100}, {"rate": 100, "suffix_first": 0, "seed": 7, "marks": ("<|pre|>", "<|suf|>", "<|mid|>")}])
def test_same_as_by_hand(spark, how):
    rows = docs(spark, TEXTS + MORE).withColumn("infill", F.lit("mine"))
    found = infill.fill_in_middle(rows, **how)
    back = infill.restored(F.col("infill.output"), F.col("infill.form"), how.get("marks", infill.MARKS))
    got = found.select("doc_id", "text", "size", "infill", back.alias("back")).collect()
    assert len(got) == rows.count() and set(found.columns) == set(rows.columns)
    assert [r.size for r in sorted(got, key=lambda r: repr(r[:3]))] == [r.size for r in sorted(rows.select("doc_id", "text", "size").collect(), key=lambda r: repr(r[:3]))]
    for r in got:
        assert tuple(r.infill[:5]) == by_hand(r.doc_id, r.text, **how)
        assert r.back == (r.text or "") and r.infill.largest_residual <= infill.BOUND
    assert infill.fill_in_middle(empty(spark)).count() == 0


def test_other_names_and_very_long_text(spark):
    long = "\n".join(f"wörd{i} " + "x" * (i % 700) for i in range(120_000))
    rows = spark.createDataFrame([("k", long, "z")], "key string, body string, text string")
    r = infill.fill_in_middle(rows, "key", "body", rate=100, out="body_").first()
    assert tuple(r.body_[:5]) == by_hand("k", long, rate=100) and r.body_.segments > 1


@given(st.lists(st.integers(1, 5000), max_size=300), st.integers(1, 126))
@settings(max_examples=150, deadline=None)
def test_index_gives_every_offset(steps, bound):
    offsets = np.concatenate(([0], np.cumsum(np.array(steps, np.int64))))
    index = infill.RankIndex(offsets, bound)
    assert (index.offsets(np.arange(len(offsets))) == offsets).all()
    assert np.abs(index.residuals.astype(int)).max() <= bound + 1


def test_index_is_short_on_even_text():
    even = np.arange(0, 700_000, 7)
    assert len(infill.RankIndex(even).firsts) == 1
    rough = np.cumsum(np.random.default_rng(1).integers(1, 12, 100_000))
    assert len(infill.RankIndex(np.concatenate(([0], rough))).firsts) < 400


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", "x<P>y", "<M>"), ("ab", "bc", "<M>")])
def test_marks_that_overlap_are_refused(spark, marks):
    with pytest.raises(ValueError):
        infill.fill_in_middle(spark.createDataFrame([], SCHEMA), marks=marks)

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from appcorpus.llm import chat, components, decontaminate, fingerprint, language, licenses, mixing, quality, simhash, substring, toxicity

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(6000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [None, "", "   \n", "one", "Two words", LONG, f"intro a {PASSAGE} end", f"{PASSAGE}", f"other start {PASSAGE} other end", "the same text twice over " * 20, "abc def ghi jkl " + PASSAGE.upper()]
#: Names that operators use inside or for their results.
CLASHES = ["size", "_hash", "_k1", "_k2", "_runs", "_single", "_id", "_null", "_spans", "_items", "_found", "_stats", "_size", "_pattern", "_slot", "_more", "_order", "_h", "_p", "_text", "t", "fp", "i", "y", "gram", "_s"]
RESULTS = ["dedup", "mix", "hit", "license", "language", "quality_score", "toxicity", "sketch", "fingerprint", "least"]
SCHEMA = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES + RESULTS)


def docs(spark, texts=TEXTS, extra=()):
    """Null in any column, repeated rows, equal ids and columns named like the operators' own."""
    rest = lambda i: tuple(None if (i + k) % 5 == 0 else f"{c}{i}" for k, c in enumerate(CLASHES + RESULTS))
    values = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    values += [*values[6:7] * 2, (None, "a null id", "en", "s1"), (3, "an id again", "en", "s1"), *extra]
    return spark.createDataFrame([v + rest(k) for k, v in enumerate(values)], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def wordlist(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def license_brute_force(text):
    """(blocks, labels): every block and template by containment of word pairs; a match gives no label if another label's better one has a place for each of its pairs."""
    tokens, matches = wordlist(text), []
    two = lambda w: [(w[i], w[i + 1]) for i in range(len(w) - 1)]
    for label, t in licenses.TEMPLATES:
        own, n = set(two(wordlist(t))), len(wordlist(t))
        half = 8
        while half < n:
            half *= 2
        for first in range(0, len(tokens), half):
            here = {(i, p) for i, p in enumerate(two(tokens[first : first + 2 * half]), first) if p in own}
            share = len({p for _, p in here}) / len(own)
            if share >= licenses.THRESHOLD:
                matches.append((label, first, share, len(own), here))
    stay = lambda m: not any((o[2], o[3]) > (m[2], m[3]) and o[0] != m[0] and {w for _, w in m[4]} == {w for _, w in m[4] & o[4]} for o in matches)
    base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in f" {' '.join(tokens)} "}
    return {(m[0], m[1]) for m in matches}, ",".join(sorted({m[0] for m in matches if stay(m)} | base)), ",".join(sorted(base))


FILL = " ".join(f"filler{i}" for i in range(23))
NOTES = [
    ("Released under the MIT License. under the mit license", "mit"),
    ("Apache License, Version 2.0", "apache-2"),
    ("mit dem under", ""),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    ("Code released under the GPL license by us", ""),
    ("Released under the BSD license by staff at MIT.", ""),
    ("The album was released at the club under the bridge. License plates by MIT students", ""),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public licence as published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
    ("Permission is hereby granted, without charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction", "mit"),
    ("free software under the terms of the GNU General Public License version 3", "gpl-3"),
    ("licensed under the GNU Lesser General Public License, version 2.1", "lgpl-2-1"),
    ("It was released under the proprietary license yesterday", ""),
    ("under the license the film was released in cinemas", ""),
    ("This work is licensed under the GNU Lesser General Public License version 3", "lgpl-3"),
    ("released under the MIT license, or creative commons attribution noncommercial 4 0 international licence", "cc-by-nc,mit"),
    ("Released under MIT License; images are licensed under CC BY-NC 4.0.", "cc-by-nc,mit"),
    ("Licensed under the Apache License, Version 2.0, or released under MIT license", "apache-2,mit"),
    (f"{FILL} This work is licensed under the GNU General Public License, version 3. {FILL} the {FILL}", "gpl-3"),
    (f"Released under MIT license. {FILL} {FILL} This work is licensed under the GNU General Public License, version 3", "gpl-3,mit"),
]


@pytest.mark.parametrize("shift", [0, 5, 14])
def test_licenses(spark, shift):
    lead = " ".join(f"lead{i}" for i in range(shift))
    texts = TEXTS + [f"{lead} {t}".strip() for t, _ in NOTES] + [t for _, t in licenses.TEMPLATES]
    rows = licenses.scan_licenses(docs(spark, texts)).select("text", "license.*").collect()
    for row in rows:
        tokens, starts = wordlist(row.text), []
        for phrase in licenses.PHRASES:
            own = phrase.split()
            starts += [i for i in range(len(tokens)) if tokens[i : i + len(own)] == own]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(tokens), len(starts), min(starts, default=None), max(starts, default=None))
        blocks, labels, base = license_brute_force(row.text)
        assert {(b.label, b.first) for b in row.blocks} == blocks and (row.labels, row.base_labels) == (labels, base)
        assert row.score == (1.0 if starts else max((b.containment for b in row.blocks), default=0.0))
    if not shift:
        found = {r.text: r.labels for r in rows}
        assert [found[t] for t, _ in NOTES] == [labels for _, labels in NOTES]
        assert all(label in found[t].split(",") for label, t in licenses.TEMPLATES)
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_fingerprint(spark):
    rows = fingerprint.compared(docs(spark)).collect()
    assert len(rows) == docs(spark).count()
    order = sorted(((-(1 << 63) if i is None else i), t or "") for i, t in ((r.doc_id, r.text) for r in docs(spark).collect()))
    by_id = Counter((r.id, r.edited_sha256) for r in rows)
    ids = [i for i, _ in order]
    for k, (i, text) in enumerate(order):
        if ids.count(i) == 1 and ids.count(order[(k + 1) % len(order)][0]) == 1:
            cut, after = len(text) // 4, order[(k + 1) % len(order)][1]
            assert by_id[None if i < 0 else i, hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()] == 1
    same = {}
    for r in fingerprint.fingerprints(docs(spark)).collect():
        assert same.setdefault(r.text, r.fingerprint) == r.fingerprint
    assert same[""] == same[None] == "" and same["one"] != same["Two words"]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    long, text, after = [r for r in rows if r.id == 5][0], TEXTS[5], TEXTS[6]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    own, edited = shingles(text), shingles(text[: len(text) - len(text) // 4] + after[: len(text) // 4])
    assert abs(long.near_edited - len(own & edited) / len(own | edited)) < 0.05 and abs(long.kept_share - len(own & edited) / len(own)) < 0.05
    assert fingerprint.compared(empty(spark)).count() == 0
    assert fingerprint.compared(docs(spark).where("doc_id = 4")).first().near_next == 1.0


def test_sketches_are_pure_and_merge(spark):
    parts = ["a b c d e f g h i j k l m n", "n o p q r s t u v w x y z " * 3, "one two"]
    rows = {r.text: r for r in fingerprint.fingerprints(docs(spark, [*parts, LONG, *(f"s{i}" for i in range(30))])).collect()}
    assert all(0 <= h < 1 << 61 for r in rows.values() for h in r.sketch)  # one in eight
    assert all((r.least is None) == (not (r.text or "").split()) for r in rows.values())
    assert any(not r.sketch and r.fingerprint.startswith("-") for r in rows.values())
    assert len({r.fingerprint for t, r in rows.items() if (t or "").split()}) == len({tuple(t.lower().split()) for t in rows if (t or "").split()})
    half = len(LONG.split()) // 2
    one, two = " ".join(LONG.split()[:half]), " ".join(LONG.split()[half - 4 :])
    both = {r.text: set(r.sketch) for r in fingerprint.fingerprints(docs(spark, [one, two])).collect()}
    assert both[one] | both[two] == set(rows[LONG].sketch)


def test_next_document_by_other_ids(spark):
    names = [f"document-{k:03d}" for k in range(60)] + ["document-é", "document", None]
    table = spark.createDataFrame([(n, f"text of {n} with words {k}") for k, n in enumerate(names)], "doc_id string, text string")
    found = {r.id: r.edited_sha256 for r in fingerprint.compared(table).collect()}
    order = sorted(names, key=lambda n: (n is not None, (n or "").encode()))
    text = {n: f"text of {n} with words {k}" for k, n in enumerate(names)}
    for k, n in enumerate(order):
        cut, after = len(text[n]) // 4, text[order[(k + 1) % len(order)]]
        assert found[n] == hashlib.sha256((text[n][: len(text[n]) - cut] + after[:cut]).encode()).hexdigest()


def test_decontaminate(spark):
    items = [(1, " ".join(f"shared{i}" for i in range(5, 20))), (2, "one"), (3, None), (None, "!!"), (4, "not there at all"), (1, " ".join(f"shared{i}" for i in range(5, 20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = {}
    for text in {r.text for r in docs(spark).collect()}:
        tokens, hit, names = wordlist(text), set(), set()
        for item, t in items:
            own = wordlist(t)
            for w in {tuple(own[i : i + 10]) for i in range(max(len(own) - 9, 1))} if own else ():
                for i in range(len(tokens) - len(w) + 1):
                    if tuple(tokens[i : i + len(w)]) == w:
                        hit |= set(range(i, i + len(w)))
                        names.add(str(item))
        expected[text] = (len(tokens), len(hit), sorted(names))
    for most in (1_000_000, 12):  # one broadcast set, and several
        rows = decontaminate.decontaminate(docs(spark), bench, max_set_words=most, with_text=True).select("text", "hit.*").collect()
        for r in rows:
            assert (r.n_words, r.n_hit, r["items"]) == expected[r.text]
            assert len(wordlist(r.clean_text)) == r.n_words - r.n_hit and (r.n_hit or r.clean_text == r.text)
    assert decontaminate.decontaminate(docs(spark), bench.limit(0)).where("hit.n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0


def test_substring_dedup(spark):
    stutter = "ab " * 50
    tail = " ".join(f"tail{i}" for i in range(40))
    found = substring.substring_dedup(docs(spark, [*TEXTS, stutter, f"x {tail} y", f"z {tail}", " ".join(f"u{i}" for i in range(35))]), with_text=True).select("text", "dedup.*").collect()
    counts, texts = Counter(), [r.text for r in found]
    for t in texts:
        tokens = (t or "").split()
        counts.update(tuple(tokens[i : i + 35]) for i in range(len(tokens) - 34))
    for r in found:
        tokens = (r.text or "").split()
        gone = {j for i in range(len(tokens) - 34) if counts[tuple(tokens[i : i + 35])] > 1 for j in range(i, i + 35)}
        kept = [w for j, w in enumerate(tokens) if j not in gone]
        assert (r.n_words, r.n_removed) == (len(tokens), len(gone))
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert (r.kept_text or "").split() == kept and (gone or r.kept_text == r.text)
    assert substring.substring_dedup(empty(spark)).count() == 0


def test_language(spark):
    en, de = "the house of the king and the river that was there with them ", "das haus und der fluss der nicht mit dem alten mann ging "
    labelled = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de", None) for i in range(100, 140)]
    rows = language.identify(docs(spark, extra=labelled)).collect()
    for r in rows:
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert (r.language.lang_pred, r.language.score) == ("und", 0.0)
        elif r.doc_id and r.doc_id >= 100:
            assert r.language.lang_pred == r.lang
        assert 0 <= r.language.score <= 1
    unlabelled = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.language.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}
    assert language.identify(empty(spark)).count() == 0


def phrases_brute_force(text, sample):
    phrases, now = 0, ""
    for c in text:
        if now and now + c in sample:
            now += c
        else:
            phrases, now = phrases + 1, c if c in sample else ""
    return phrases


def test_cross_parsing_is_greedy(monkeypatch):
    pick = random.Random(1)
    for block in (3, 7, 2048):  # phrases go on from block to block
        monkeypatch.setattr(language, "BLOCK", block)
        for _ in range(60):
            sample = "".join(pick.choice("abcd") for _ in range(pick.randrange(1, 40)))
            texts = ["", *("".join(pick.choice("abcde") for _ in range(pick.randrange(60))) for _ in range(5))]
            model = language.Languages({"x": sample})
            found = model.phrases([model.encode(t, model.lookup()) for t in texts])[:, 0].tolist()
            assert found == [phrases_brute_force(t, sample) for t in texts]


def test_winning_language_matches_brute_force():
    pick = random.Random(2)
    samples = {name: "".join(pick.choice(letters) for _ in range(300)) for name, letters in (("a", "abcdef"), ("b", "defghi"), ("c", "ghiabc"))}
    model = language.Languages(samples)
    for _ in range(50):
        text = "".join(pick.choice("abcdefghiz") for _ in range(40))
        counts = [phrases_brute_force(text, samples[n]) for n in model.names]
        names, scores = model.winners([text], model.lookup())
        assert names == [model.names[counts.index(min(counts))]]
        assert abs(scores[0] - sorted(counts)[1] / (sorted(counts)[0] + sorted(counts)[1])) < 1e-12


def test_long_texts_and_many_letters_are_whole():
    pick = random.Random(3)
    sample = "".join(chr(0x4E00 + pick.randrange(2500)) for _ in range(12_000))
    model = language.Languages({"x": sample, "y": sample[::-1]})
    assert len(model.letters) > 2000 and len(set(map(int, model.lookup()[model.letters]))) == len(model.letters)
    counts = model.phrases([model.encode(sample[500:8000], model.lookup())])[0]
    assert counts[0] == 1 and counts[1] == phrases_brute_force(sample[500:8000], sample[::-1])


def test_mixing(spark):
    rows = mixing.mix(docs(spark)).select("text", "source", "mix.*").collect()
    assert len(rows) == docs(spark).count()
    sizes = Counter()
    for r in rows:
        assert r.size == len((r.text or "").split()) and r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        sizes[r.source] += r.size
    targets = mixing.source_targets(dict(sizes), sum(sizes.values()))
    assert all(abs(r.target - targets[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in rows)
    again = mixing.mix(docs(spark)).select("doc_id", "mix.taken").collect()
    assert Counter(map(str, again)) == Counter(map(str, mixing.mix(docs(spark)).select("doc_id", "mix.taken").collect()))
    assert mixing.mix(empty(spark)).count() == 0


def test_taken_words_come_near_every_target(spark):
    pick = random.Random(4)
    values = [(i, " ".join(["w"] * pick.randrange(1, 40)), pick.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    rows = mixing.mix(spark.createDataFrame(values, "doc_id long, text string, source string")).select("source", "mix.*").collect()
    taken, targets, largest = Counter(), {}, max(r.size for r in rows)
    for r in rows:
        taken[r.source] += r.taken
        targets[r.source] = r.target
    assert len(targets) == 4 and all(abs(taken[s] - t) <= largest for s, t in targets.items())


def test_overlapping_sources(spark):
    values = [(i, "w " * (1 + i % 7), s) for i, s in enumerate([["x"], ["y", "x"], ["x", "y"], ["x", "x"], [], None, ["z"], ["y", None], ["z", "x"]] * 40)]
    table = spark.createDataFrame(values, "doc_id long, text string, own array<string>").withColumn("_size", F.lit("q"))
    rows = mixing.mix(table, sources="own").select("doc_id", "own", "_size", "mix.*").collect()
    member = lambda own: sorted(set(own or [None]), key=lambda s: (s is None, s or ""))
    sizes, totals = Counter(), Counter()
    for _, text, own in values:
        totals[tuple(member(own))] += len(text.split())
        for s in member(own):
            sizes[s] += len(text.split())
    targets, taken = mixing.source_targets(dict(sizes), sum(totals.values())), Counter()
    for r in rows:
        first = member(r.own)[0]
        assert (r.size, r.source_size, r["_size"]) == (1 + r.doc_id % 7, sizes[first], "q") and abs(r.target - targets[first]) < 1e-6 and r.taken <= 3 * r.size
        taken[tuple(member(r.own))] += r.taken
    routed = mixing.route(dict(totals), {s: round(t) for s, t in targets.items()})
    assert all(abs(taken[p] - routed[p]) <= 7 for p in totals)


def test_mixing_targets_and_flow():
    assert mixing.source_targets({"a": 10, "b": 1000, None: 90}, 1100) == {"a": 30.0, "b": 800.0, None: 270.0}
    # the overlap is used where it is needed, fresh words before repeated ones
    assert mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 20, "b": 10}) == {("a",): 10, ("a", "b"): 10, ("b",): 10}


def test_flow_is_cheapest_of_all():
    """Against every way to take words of three patterns by hand."""
    pick = random.Random(6)
    for _ in range(12):
        sizes = {("a",): pick.randrange(1, 5), ("a", "b"): pick.randrange(1, 5), ("b",): pick.randrange(1, 5)}
        quotas = {"a": pick.randrange(0, 13), "b": pick.randrange(0, 13)}
        cost = lambda n, size: sum(min(max(n - r * size, 0), size) * r for r in range(3))
        best = None
        for x in range(3 * sizes["a",] + 1):
            for y in range(3 * sizes["b",] + 1):
                for z in range(3 * sizes["a", "b"] + 1):
                    for to_a in range(z + 1):
                        if x + to_a <= quotas["a"] and y + z - to_a <= quotas["b"]:
                            key = (-(x + y + z), cost(x, sizes["a",]) + cost(y, sizes["b",]) + cost(z, sizes["a", "b"]))
                            best = key if best is None else min(best, key)
        taken = mixing.route(sizes, quotas)
        assert best == (-sum(taken.values()), sum(cost(n, sizes[p]) for p, n in taken.items()))


def test_simhash(spark):
    base = " ".join(f"k{i}" for i in range(300))
    near = [base.replace(f"k{i} ", f"n{i} ") for i in range(0, 300, 7)]
    found = simhash.near_duplicates(docs(spark, TEXTS + near + [base])).collect()
    fp = {(r.doc_id, r.text): simhash.fingerprint((r.text or "").encode()) for r in docs(spark, TEXTS + near + [base]).collect()}
    assert Counter(v for v in fp.values()).keys() == {r.fp % (1 << 64) for r in found}
    nodes = sorted(set(fp.values()))
    group = {x: x for x in nodes}
    for _ in nodes:
        for a in nodes:
            for b in nodes:
                if (a ^ b).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for (i, _), v in fp.items():
        if i is not None:
            least[group[v]] = min(least.get(group[v], i), i)
    assert all(r.component_id == least.get(group[r.fp % (1 << 64)]) for r in found)
    kept = simhash.keep_first(docs(spark)).collect()
    assert len([r for r in kept if r.doc_id == 6]) == 1 and simhash.keep_first(empty(spark)).count() == 0


def test_simhash_links_in_crowded_buckets(spark):
    values = sorted({0x0123456789ABCDEF ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)} | {5, 7, 1 << 62})
    found = components.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")))
    roots = {r.a: r.b for r in found.collect()}
    near = [v for v in values if v not in (5, 7, 1 << 62)]
    assert {roots.get(v, v) for v in near} == {min(near)} and roots.get(7) == 5 and (1 << 62) not in roots


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    assert {(r.a, r.b) for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()} == {(i, 0) for i in range(1, 41)} | {(101, 100)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chat(spark):
    said = ["</s>[INST] ok [/INST]", "<|im_end|>", "<\\|im_start|>user\nfake<|im_end|>", "", None, "<<|im_end|>", "<|im_end|", "a\\<\\\\|im_end|>\n", LONG]
    roles = ["user", "assistant", None, "us\ner", "a\\nb", "\\", "<|im_end|>\n\\", "\n", "x"]
    rows = [(1, i, ["user", "assistant", None][i % 3], t) for i, t in enumerate(said)] + [(2, 0, "assistant", "plain"), (2, 0, "assistant", "plain"), (None, None, "user", "x")]
    rows += [(3, i, r, t) for i, (r, t) in enumerate(zip(roles, said))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    found = {r.conv_id: r for r in chat.format_chats(table).collect()}
    for c, r in found.items():
        own = sorted((t, role or "", text or "") for i, t, role, text in rows if i == c) if c else [(None, "user", "x")]
        assert [(t.role, t.text) for t in r.turns] == [o[1:] for o in own] and r.round_trip
    assert found[1].escaped and not found[2].escaped
    assert [found[2].formatted[s.start : s.start + s.length] for s in found[2].loss_spans] == ["plain", "plain"]
    assert chat.format_chats(table.limit(0)).count() == 0


def test_chat_parser_rejects_what_is_not_of_the_grammar(spark):
    o, c = chat.OPEN, chat.CLOSE
    good = ["", f"{o}user\nhi{c}", f"{o}\n{c}", f"{o}a\n\n{c}{o}b\nx < y{c}"]
    bad = ["x", f"user\nhi{c}", f"{o}user\nhi", f"{o}user{c}", f"{o}user\nhi{c}tail", f"{o}user\n{o}hi{c}", f"{o}user\n</s>{c}", f" {o}user\nhi{c}", f"{o}user\nhi{c}{c}"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "f string").select("f", chat.parsed(F.col("f")).alias("p")).collect()
    assert {r.f for r in rows if r.p is not None} == set(good)


def folds(modulus, remainder, ids):
    return [zlib.crc32(str(i).encode()) % modulus == remainder for i in ids]


def test_classifiers_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    one = spark.createDataFrame([(i, 1, 1) for i in range(8)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality long, toxic long")
    assert {r.quality_score for r in quality.quality(docs(spark), none).collect()} == {0.5}
    assert {r.toxicity for r in toxicity.toxicity(docs(spark), none).collect()} == {0.5}
    assert all(r.quality_score > 0.5 for r in quality.quality(docs(spark), one).collect())
    assert all(r.toxicity > 0.5 for r in toxicity.toxicity(docs(spark), one).collect())
    assert quality.quality(empty(spark), one).count() == 0


def test_rules_compile_to_what_they_say(spark):
    """A fixed rule set as one column against plain Python, on null, empty and long texts."""
    rules = {(("distinct", True, 0.5), ("log_chars", False, 3.0)): 1.5, (("upper", False, 0.02),): -2.0, (("word_length", True, 5.0),): 0.75, (("line", False, 0.0), ("stop", True, 0.01)): 0.3}
    table = docs(spark, TEXTS + ["ÄÖ Üx 12 3? a.\nb", "THE " * 50, "one\none\ntwo"])
    score = quality.Rules(rules, -0.25).column({k: F.col("s")[k] for k in quality.STATISTICS})
    rows = quality.with_statistics(table.select("text"), "text", "s").withColumn("score", score).collect()
    for r in rows:
        text = r.text or ""
        tokens, lines, n = text.split(), text.split("\n"), len(text)
        share = lambda k: k / n if n else 0.0
        own = {
            "log_chars": math.log1p(n), "word_length": n / len(tokens) if tokens else 0.0, "distinct": len(set(tokens)) / len(tokens) if tokens else 0.0, "distinct_lines": len(set(lines)) / len(lines),
            "upper": share(sum(c.isupper() for c in text)), "symbol": share(sum(not (c.isalnum() or c.isspace() or c in ".,;:'\"?()-") for c in text)), "digit": share(sum(c.isnumeric() for c in text)),
            "stop": share(sum(c in ".?" for c in text)), "line": share(text.count("\n")),
        }
        assert all(abs(r.s[k] - v) < 1e-12 for k, v in own.items())
        z = -0.25 + sum(w for rule, w in rules.items() if all((own[k] <= at) == low for k, low, at in rule))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-12


def test_toxicity_fit_matches_plain_loops():
    pick = random.Random(8)
    rows = [np.array(sorted(pick.sample(range(12), pick.randrange(0, 6))), np.int32) for _ in range(40)]
    y = np.array([float(3 in r or pick.random() < 0.1) for r in rows])
    ratio = np.array([pick.uniform(-2, 2) for _ in range(12)])
    weight, bias = toxicity.fit(rows, y, ratio, rounds=20_000)
    # at the minimum no small step in any direction lowers the balanced, penalised loss
    share = {1.0: 0.5 / sum(y), 0.0: 0.5 / (len(y) - sum(y))}

    def loss(w, b):
        out = toxicity.PENALTY / 2 * sum(x * x for x in w)
        for r, own in zip(rows, y):
            z = b + sum(w[k] * ratio[k] for k in r)
            out += share[own] * math.log1p(math.exp(-z if own else z))
        return out

    least = loss(weight, bias)
    for k in range(12):
        for step in (1e-3, -1e-3):
            moved = weight.copy()
            moved[k] += step
            assert loss(moved, bias) >= least - 1e-9
    assert min(loss(weight, bias + 1e-3), loss(weight, bias - 1e-3)) >= least - 1e-9


def test_log_count_ratios(spark):
    n1, n0 = np.array([5, 0, 9, 3]), np.array([0, 7, 9, 3])
    ratio, errors = toxicity.ratios(n1, n0, 10, 20)
    for k in range(4):
        p, q = (n1[k] + 1) / 12, (n0[k] + 1) / 22
        assert abs(ratio[k] - math.log(p / q)) < 1e-12
        assert abs(errors[k] - abs(math.log(p / q)) / math.sqrt((1 - p) / (n1[k] + 1) + (1 - q) / (n0[k] + 1))) < 1e-12


@pytest.mark.parametrize("name", ["licenses", "decontaminate", "quality", "substring", "language", "mixing", "toxicity", "fingerprint", "simhash"])
def test_other_columns_stay_as_they_are(spark, name):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(11)], "doc_id long, quality long, toxic long")
    bench = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    run, result = {
        "licenses": (licenses.scan_licenses, "license"), "decontaminate": (lambda d: decontaminate.decontaminate(d, bench), "hit"), "quality": (lambda d: quality.quality(d, labels), "quality_score"),
        "substring": (substring.substring_dedup, "dedup"), "language": (language.identify, "language"), "mixing": (mixing.mix, "mix"), "toxicity": (lambda d: toxicity.toxicity(d, labels), "toxicity"),
        "fingerprint": (fingerprint.fingerprints, "fingerprint"), "simhash": (simhash.keep_first, None),
    }[name]
    gone = {"fingerprint": {"sketch", "least", "fingerprint"}}.get(name, {result})
    columns = [c for c in docs(spark).columns if c not in gone]
    before, out = Counter(map(str, docs(spark).select(*columns).collect())), run(docs(spark))
    after = Counter(map(str, out.select(*columns).collect()))
    assert set(out.columns) == set(docs(spark).columns) and (after == before if result else after <= before)
    assert run(empty(spark)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for op, label, least in ((quality.op4, "quality", 0.97), (toxicity.op9, "toxic", 0.9)):
        rows = [r for r in op(spark, sf).collect() if r.held_out and r.doc_id in labels]
        assert sum(r.predicted == labels[r.doc_id][label] for r in rows) / len(rows) >= least
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = language.op7(spark, sf).collect()
    assert [r.held_out for r in rows] == folds(5, 0, [r.doc_id for r in rows])
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) >= 0.99

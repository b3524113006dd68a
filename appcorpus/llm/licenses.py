"""License scans: an exact set-similarity join of text blocks with license templates."""

import math
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, ref, table, utf8, words

# The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Notices that the method looks for, with their labels; near relatives stand beside each other, so that each text has its own.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "released under mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "licensed under mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-2-1", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("gpl-2", "free software under the terms of the gnu general public license version 2"),
    ("gpl-3", "free software under the terms of the gnu general public license version 3"),
    ("lgpl-2-1", "free software under the terms of the gnu lesser general public license version 2 1"),
    ("lgpl-3", "free software under the terms of the gnu lesser general public license version 3"),
    ("agpl-3", "free software under the terms of the gnu affero general public license version 3"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl-2-1", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("mpl-1-1", "subject to the terms of the mozilla public license version 1 1"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-1", "made available under the terms of the eclipse public license v1 0"),
    ("epl-2", "made available under the terms of the eclipse public license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8
#: Words of all templates together, at most: they go to every task.
MAX_TEMPLATE_WORDS = 200_000


def pairs(tokens: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Each word with the one after it: the tokens of the sets, so that the words' order counts."""
    return list(zip(tokens, tokens[1:]))


class TemplateIndex:
    """Templates as sets of word pairs ordered from the rarest pair of the corpus on, with the pairs of their prefixes inverted."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[tuple[bytes, bytes], int], threshold: float):
        sets = [(label, own, set(pairs(own))) for label, text in templates if len(own := words(text.encode())) > 1]
        order = sorted({t for _, _, own in sets for t in own}, key=lambda t: (frequency.get(t, 0), t))
        self.rank = {t: i for i, t in enumerate(order)}
        self.first_words = {a for a, _ in order}
        self.templates, self.prefix = [], {}
        for label, text, own in sets:
            ranks = sorted(self.rank[t] for t in own)
            need = math.ceil(threshold * len(ranks) - 1e-9)
            # blocks of at least twice the notice, half overlapping: any passage as long as the notice lies whole in one
            half = max(8, 1 << (len(text) - 1).bit_length())
            for at, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.prefix.setdefault(r, []).append((len(self.templates), at))
            self.templates.append((label, ranks, need, half))
        self.halves = sorted({t[3] for t in self.templates})

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[str, int, int, float]], set[str]]:
        """(label, first word, end, containment) of every block and template that meet the threshold, and the labels that stand.

        A match gives no label only if a better one, or as good a one of more pairs, accounts for its pairs: each of them
        has a place in its block that is also a place of the better match, as those of a near relative of the notice that is there.
        """
        known = []
        if not self.first_words.isdisjoint(tokens):
            known = [(i, r) for i, (a, b) in enumerate(pairs(tokens)) if a in self.first_words and (r := self.rank.get((a, b))) is not None]
        if not any(r in self.prefix for _, r in known):
            return [], set()
        found, matched = [], []
        for half in self.halves:
            # a pair lies in a block if both of its words do: not the one that begins with the block's last word
            blocks_of = lambda i, h=half: [b for b in (i // h, i // h - 1) if b >= 0 and i + 1 < (b + 2) * h]
            starts = {b for i, r in known if r in self.prefix for b in blocks_of(i)}
            blocks: dict[int, set[int]] = {}
            for i, r in known:
                for b in blocks_of(i):
                    if b in starts:
                        blocks.setdefault(b, set()).add(r)
            for b, own in sorted(blocks.items()):
                ranks = sorted(own)
                tried: set[int] = set()
                for q, r in enumerate(ranks):
                    for k, p in self.prefix.get(r, ()):
                        label, template, need, size = self.templates[k]
                        # length, then position: what can still match behind this first common pair
                        if size != half or k in tried or len(ranks) < need or 1 + min(len(template) - p - 1, len(ranks) - q - 1) < need:
                            continue
                        tried.add(k)
                        both = own.intersection(template)
                        if len(both) >= need:
                            low, high = b * half, min(len(tokens), (b + 2) * half)
                            found.append((label, low, high, len(both) / len(template)))
                            matched.append((low, high, both, len(template)))
        at: dict[int, list[int]] = {}
        for i, r in known if found else ():
            at.setdefault(r, []).append(i)

        def covered(k: int, by: int) -> bool:
            (a, b, own, _), (c, d, wider, _) = matched[k], matched[by]
            low, high = max(a, c), min(b, d) - 1
            return own <= wider and all((j := bisect_left(at[r], low)) < len(at[r]) and at[r][j] < high for r in own)

        # blocks that share no place can't account for each other: only those that begin within two of the longest are compared
        reach, labels = 2 * self.halves[-1] if self.halves else 0, set()
        by_start = sorted(range(len(found)), key=lambda k: matched[k][0])
        begins = [matched[k][0] for k in by_start]
        for k, (low, high, _, size) in enumerate(matched):
            near = by_start[bisect_left(begins, low - reach) : bisect_left(begins, high)]
            if not any((found[x][3], matched[x][3]) > (found[k][3], size) and found[x][0] != found[k][0] and covered(k, x) for x in near):
                labels.add(found[k][0])
        return found, labels


def _present(vocabulary: frozenset[tuple[bytes, bytes]]):
    def make():
        def batch(texts: pa.Array) -> pa.Array:
            return pa.array([[f"{a.decode()} {b.decode()}" for a, b in vocabulary.intersection(pairs(words(x or b"")))] for x in utf8(texts)], pa.list_(pa.string()))

        return batch

    return make


def places(tokens: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of the phrase's words where they stand consecutively."""
    found, at = [], -1
    try:
        while True:
            at = tokens.index(phrase[0], at + 1)
            if tokens[at : at + len(phrase)] == phrase:
                found.append(at)
    except ValueError:
        return found


def _scan(index: TemplateIndex, phrases: dict[str, str]):
    base = [(words(p.encode()), label) for p, label in phrases.items()]

    def make():
        def batch(texts: pa.Array) -> pa.Array:
            rows = []
            for text in utf8(texts):
                tokens = words(text or b"")
                have = set(tokens)
                starts, labels = [], set()
                for phrase, label in base:
                    if have.issuperset(phrase) and (at := places(tokens, phrase)):
                        starts += at
                        labels.add(label)
                blocks, noticed = index.scan(tokens)
                score = 1.0 if starts else max((b[3] for b in blocks), default=0.0)
                both = labels | noticed
                rows.append({
                    "n_words": len(tokens), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(both)), "score": score,
                    "blocks": [dict(zip(("label", "first", "end", "containment"), b)) for b in blocks],
                })
            return pa.array(rows, _ARROW)

        return batch

    return make


_BLOCK = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(_BLOCK))])
_SCHEMA = "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,blocks:array<struct<label:string,first:long,end:long,containment:double>>>"


def scan_licenses(docs: DataFrame, text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD, out: str = "license") -> DataFrame:
    """docs, all columns, with a struct column `license`: base phrase places, labels, score and the matching blocks.

    A notice is the set of its word pairs, so words in another order don't match. A first pass counts in how many documents
    each pair stands (partial sums; a row for each pair comes to the driver). Ordered from the rarest on, a template of n
    pairs needs m = ceil(threshold x n) of them in a block, so one of its n - m + 1 rarest must be there: the prefix. Blocks
    without any prefix pair are passed over, the others go through the length and positional filters and an exact count.
    Blocks have twice a template's length at least and overlap by half. The second pass does that beside the rows: no shuffle.

    All matching blocks are returned: those whose containment meets the threshold, no other rule. Every matching template gives
    its label unless another label's better (of equals: longer) match accounts for the same places. The score is 1 with a base
    phrase, else the best containment, else 0. Null and empty texts have no words and no labels; very long texts are scanned
    whole; repeated rows are scanned alike; ties in frequency are ordered by the pair; no documents give no rows. All columns are
    kept; one called as the result (`out`) gives way to it. Templates are a parameter of bounded size, of two words at least each.
    """
    if (size := sum(len(t) // 2 + 1 for _, t in templates)) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of {size} words: {MAX_TEMPLATE_WORDS} are the bound")
    vocabulary = frozenset(t for _, x in templates for t in pairs(words(x.encode())))
    seen = docs.select(arrow_column(_present(vocabulary), "array<string>", ref(text)).alias("t")).select(F.explode("t").alias("t"))
    frequency = {tuple(r.t.encode().split()): r.n for r in seen.groupBy("t").agg(F.count("*").alias("n")).collect()}
    index = TemplateIndex(templates, frequency, threshold)
    return docs.withColumn(out, arrow_column(_scan(index, phrases), _SCHEMA, ref(text)))


def op1(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(f"license.{c}" for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")))

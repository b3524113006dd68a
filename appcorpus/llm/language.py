"""Language identification by cross-parsing: the language whose text spells a document in the fewest phrases."""

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, held_out, learnable, ref, table

#: Characters of labelled text that each language's automaton is built of, at most: the bounded sample.
TRAIN_CHARS = 20_000
#: Characters that are parsed side by side with others; a phrase goes on from one block into the next.
BLOCK = 2_048
#: Bytes of all automata together, at most: they are broadcast. A row of 20,000 characters takes about 1 MB.
MAX_MODEL_BYTES = 256 << 20
UNDETERMINED = "und"
_SPACE, _UNKNOWN = 0, 1
#: Characters of text that a task works on at once.
_PART_CHARS = 8_000_000
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads exactly the substrings of codes (Blumer et al.)."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in codes.tolist():
        now = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return step


class Parser:
    """A suffix automaton as three arrays, whatever the number of letters: the rows of all states lie over one another.

    The edge of state s by letter c is at base[s] + c, where `owner` says whether it is there. The root has a row of
    its own, since a phrase begins wherever there is no edge.
    """

    def __init__(self, codes: np.ndarray, letters: int):
        step = suffix_automaton(codes)
        self.root = np.zeros(letters, np.int32)
        for c, to in step[0].items():
            self.root[c] = to
        edges = sum(map(len, step))
        size = edges + 2 * letters + 8
        owner, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        taken = bytearray(size)
        self.base = np.zeros(len(step), np.int32)
        low = near = letters  # the first free place; where rows of several edges are tried from
        for s in sorted(range(1, len(step)), key=lambda s: (-len(step[s]), s)):
            own = sorted(step[s])
            if not own:
                continue
            while taken[low]:
                low += 1
            at = tried = max(low, near if len(own) > 1 else low) - own[0]
            while any(taken[at + c] for c in own):
                at += 1
            if len(own) > 1 and at - tried > 8:
                near = at + own[0]
            if at + 2 * letters >= len(taken):
                taken.extend(bytes(size))
                owner = np.concatenate((owner, np.full(size, -1, np.int32)))
                target = np.concatenate((target, np.zeros(size, np.int32)))
            self.base[s] = at
            for c in own:
                taken[at + c], owner[at + c], target[at + c] = 1, s, step[s][c]
        self.owner, self.target = owner, target

    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.root, self.base, self.owner, self.target))

    def run(self, grid: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each row of codes, and the state behind it. Rows go from long to short; all advance together."""
        state, begun = state.copy(), np.zeros(len(state), np.int64)
        active = np.searchsorted(-lengths, -np.arange(grid.shape[1]), side="left")
        for codes, n in zip(grid.T, active.tolist()):
            if not n:
                break
            now, codes = state[:n], codes[:n]
            at = self.base[now] + codes
            on = self.owner[at] == now
            begun[:n] += ~on
            state[:n] = np.where(on, self.target[at], self.root[codes])
        return begun, state


class Languages:
    """One parser for each language, over the letters of all samples."""

    def __init__(self, samples: dict[str, str]):
        found = sorted({int(p) for text in samples.values() for p in np.unique(_points(text))} - {0})
        self.letters = [p for p in found if _is_letter()[p]]
        self.names = sorted(samples)
        lookup, width = self.lookup(), 2 + len(self.letters)
        self.parsers = [Parser(self.encode(samples[n], lookup), width) for n in self.names]
        if (size := sum(p.nbytes() for p in self.parsers)) > MAX_MODEL_BYTES:
            raise ValueError(f"automata of {size} bytes: {MAX_MODEL_BYTES} are the bound, take fewer characters of each language")

    def lookup(self) -> np.ndarray:
        """Code of each code point: one for all that isn't a letter, one for letters that no sample has."""
        codes = np.where(_is_letter(), _UNKNOWN, _SPACE).astype(np.int32)
        codes[self.letters] = np.arange(2, 2 + len(self.letters))
        return codes

    @staticmethod
    def encode(text: str, lookup: np.ndarray) -> np.ndarray:
        codes = lookup[_points(text)]
        return codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))] if len(codes) else codes

    def phrases(self, coded: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language: each the longest that stands in its sample, else one character.

        Texts are cut into blocks that are parsed side by side, first as if a phrase began with each. Then each block
        is parsed again from the state in which the block before it ended, until no block's end changes: that is the
        parse of the whole text, and most blocks have it after one repetition.
        """
        blocks = np.array([max(1, -(-len(c) // BLOCK)) for c in coded], np.int64)
        owner = np.repeat(np.arange(len(coded)), blocks)
        first = np.zeros(len(owner), bool)
        first[np.cumsum(blocks) - blocks] = True
        grid, lengths, at = np.zeros((len(owner), BLOCK), np.int32), np.zeros(len(owner), np.int64), 0
        for c, n in zip(coded, blocks.tolist()):
            grid[at : at + n].reshape(-1)[: len(c)] = c
            lengths[at : at + n] = BLOCK
            lengths[at + n - 1] = len(c) - (n - 1) * BLOCK
            at += n
        order = np.argsort(-lengths, kind="stable")
        counts = np.zeros((len(coded), len(self.names)), np.int64)
        for k, parser in enumerate(self.parsers):
            entry, begun, end = np.zeros(len(owner), np.int32), np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int32)
            begun[order], end[order] = parser.run(grid[order], lengths[order], entry[order])
            while True:
                now = np.where(first, 0, np.concatenate(([0], end[:-1])))
                again = order[now[order] != entry[order]]
                if not len(again):
                    break
                entry = now.astype(np.int32)
                begun[again], end[again] = parser.run(grid[again], lengths[again], entry[again])
            counts[:, k] = np.bincount(owner, begun, len(coded)).astype(np.int64)
        return counts

    def winners(self, texts: list[str | None], lookup: np.ndarray) -> tuple[list[str], list[float]]:
        coded = [self.encode(t or "", lookup) for t in texts]
        counts = self.phrases(coded) / np.maximum([len(c) for c in coded], 1)[:, None] if self.names else np.zeros((len(coded), 0))
        names, scores = [], []
        for codes, own in zip(coded, counts):
            if not len(own) or not (codes != _SPACE).any():
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(own.argmin())
            second = np.partition(own, 1)[1] if len(own) > 1 else 2 * own[0]
            names.append(self.names[best])
            scores.append(float(second / (second + own[best])))
        return names, scores


def _predict(broadcast):
    def make():
        model = broadcast.value
        lookup = model.lookup()

        def batch(texts: pa.Array) -> pa.Array:
            names, scores, some, chars = [], [], [], 0
            for i, text in enumerate(texts):  # a few MB of text at a time
                some.append(text.as_py())
                chars += len(some[-1] or "") + BLOCK
                if chars > _PART_CHARS or i == len(texts) - 1:
                    for out, new in zip((names, scores), model.winners(some, lookup)):
                        out += new
                    some, chars = [], 0
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

        return batch

    return make


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", chars: int = TRAIN_CHARS) -> Languages:
    """Automata from labelled rows outside the held-out fold; rows without an id are in no fold and not learnt from.

    The driver gets one count for each language and a sample of about `chars` characters of each, an eighth of that from
    a document at most, from any place in it; documents and places are chosen by a hash of id and text (so reruns agree).
    """
    rows = docs.select(ref(doc_id).alias("i"), ref(text).alias("t"), ref(lang).alias("l")).where(F.col("l").isNotNull() & (F.length("t") > 0) & learnable("i", 5, 0))
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.sum(F.length("t")).alias("n")).collect()}
    order = F.pmod(F.xxhash64("i", "t"), F.lit(1 << 30))
    share = F.lit(0)
    for name, n in sizes.items():
        share = F.when(F.col("l") == name, int(min(1.0, 4 * chars / n) * (1 << 30))).otherwise(share)
    # a piece of each from a place that the hash chooses too
    piece = lambda n: F.substring(F.col("t"), F.lit(1) + F.pmod(F.xxhash64("t", "i"), F.greatest(F.length("t") - n + 1, F.lit(1))).cast("int"), F.lit(n))
    picked = rows.withColumn("o", order).where(F.col("o") < share).select("l", "o", piece(max(1, chars // 8)).alias("t"))
    samples: dict[str, str] = {}
    for r in sorted(picked.toLocalIterator(), key=lambda r: (r.o, r.t)):
        samples[r.l] = (samples.get(r.l, "") + "\n" + r.t)[:chars] if len(samples.get(r.l, "")) < chars else samples[r.l]
    missing = {n for n in sizes if n not in samples}
    for name in sorted(missing):  # a language of a few long documents can miss its share
        row = rows.where(F.col("l") == name).select(piece(chars).alias("t"), order.alias("o")).orderBy("o", "t").first()
        samples[name] = row.t
    return Languages(samples)


def language_column(spark, model: Languages, text: str | Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    return arrow_column(_predict(spark.sparkContext.broadcast(model)), "struct<lang_pred:string,score:double>", text)


def identify(docs: DataFrame, training: DataFrame | None = None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", chars: int = TRAIN_CHARS, out: str = "language") -> DataFrame:
    """docs, all columns, with a struct column `language`: lang_pred and score.

    A text's phrases are counted in each language's text and divided by its length; the smallest wins, ties by name.
    The score is the runner-up's share of the two best counts: 0.5 for a tie, toward 1 for a clear case. Null, empty
    and letterless texts, and all texts if nothing was labelled, are `und` with score 0. Very long texts are parsed
    whole. Repeated rows get equal results; no documents give no rows. A column called as the result (`out`) gives way to it.
    """
    model = train(training if training is not None else docs, doc_id, text, lang, chars)
    return docs.withColumn(out, language_column(docs.sparkSession, model, ref(text)))


def op7(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "language.lang_pred", "language.score")

"""Fill-in-middle: cuts at token ranks, whose offsets a piecewise-linear learned index of all boundaries gives."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, free, ref, table, utf8
from .tokens import SPACES

#: A line's predictions are off by so many code points at most, so that a residual is one byte.
BOUND = 100
#: Shares in a hundred: documents that are transformed, and of these the ones whose suffix comes first.
RATE, SUFFIX_FIRST = 50, 80
MARKS = ("<P>", "<S>", "<M>")
SEED = 42


def boundaries(text: bytes) -> np.ndarray:
    """Code points before each token boundary, from 0 to the end; a token is a word with the white space before it, or trailing white space."""
    if not text:
        return np.zeros(1, np.int64)
    data = np.frombuffer(text, np.uint8)
    space = SPACES[data]
    last = ~space
    last[:-1] &= space[1:]
    last[-1] = True
    ends = np.flatnonzero(last) + 1
    points = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    return np.concatenate(([0], points[ends - 1].astype(np.int64)))


class RankIndex:
    """Offset of each rank: lines fitted so that none is off by more than the bound, and what is left as one byte for each rank.

    A segment is as long as a line through its first point can be within the bound of all others (a cone of slopes that
    only narrows). The offsets themselves are not kept.
    """

    def __init__(self, offsets: np.ndarray, bound: int = BOUND):
        if not 1 <= bound <= 126:
            raise ValueError("bound: 1 to 126, residuals are one byte")
        firsts, slopes, at, n = [], [], 0, len(offsets)
        while at < n:
            low, high, end, step, narrow = -np.inf, np.inf, at + 1, 64, False
            while end < n and not narrow:
                stop = min(n, end + step)
                run, rise = np.arange(end - at, stop - at), offsets[end:stop] - offsets[at]
                lows, highs = np.maximum.accumulate((rise - bound) / run).clip(low), np.minimum.accumulate((rise + bound) / run).clip(None, high)
                fits = np.flatnonzero(lows > highs)
                narrow, good = len(fits) > 0, int(fits[0]) if len(fits) else stop - end
                if good:
                    low, high = lows[good - 1], highs[good - 1]
                end, step = end + good, step * 2
            firsts.append(at)
            slopes.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        self.firsts, self.slopes = np.array(firsts, np.int64), np.array(slopes)
        self.bases = offsets[self.firsts]
        self.residuals = (offsets - self.predict(np.arange(n))).astype(np.int8)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.firsts, ranks, side="right") - 1
        return self.bases[k] + np.rint(self.slopes[k] * (ranks - self.firsts[k])).astype(np.int64)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact: the prediction and the stored residual."""
        return self.predict(ranks) + self.residuals[ranks]


_SCHEMA = "struct<n:long,first:long,second:long,segments:long,largest_residual:long>"
_ARROW = pa.struct([(c, pa.int64()) for c in ("n", "first", "second", "segments", "largest_residual")])


def _cuts():
    def batch(texts: pa.Array, ones: pa.Array, others: pa.Array) -> pa.Array:
        rows = []
        for text, a, b in zip(utf8(texts), ones.to_pylist(), others.to_pylist()):
            offsets = boundaries(text or b"")
            n = len(offsets) - 1
            index = RankIndex(offsets)
            first, second = index.offsets(np.sort(np.array([a % (n + 1), b % (n + 1)])))
            rows.append((n, int(first), int(second), len(index.firsts), int(np.abs(index.residuals.astype(np.int64)).max())))
        return pa.array([dict(zip(_ARROW.names, r)) for r in rows], _ARROW)

    return batch


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document: the same in every run, whatever the order of rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that a text without them can't hide: no end of one begins another, and none holds another."""
    for a in marks:
        for b in marks:
            if not a or (a != b and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b))):
                raise ValueError(f"marks overlap: {a!r} {b!r}")
    if len(set(marks)) < 3:
        raise ValueError("three different marks are needed")
    return marks


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of this form was made of."""
    first, last = marks[0], marks[1]

    def read(a: str, b: str) -> tuple[Column, Column, Column]:
        """What stands behind mark a, mark b and the middle's mark."""
        body = F.substring(output, F.lit(len(a) + 1), F.length(output))
        one = F.substring_index(body, b, 1)
        rest = F.substring(body, F.length(one) + len(b) + 1, F.length(body))
        two = F.substring_index(rest, marks[2], 1)
        return one, two, F.substring(rest, F.length(two) + len(marks[2]) + 1, F.length(rest))

    prefix, suffix, middle = read(first, last)
    suffix_, prefix_, middle_ = read(last, first)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, marks: tuple[str, str, str] = MARKS, out: str = "infill") -> DataFrame:
    """docs, all columns, with a struct column `infill`: n (tokens), form (plain, psm, spm), prefix_chars, middle_chars, output, segments, largest_residual.

    Of each text all token boundaries are fitted by lines; the two cuts, drawn as ranks by the id, are predicted and corrected by
    the stored residuals, which gives the exact code point. A map over rows: no shuffle. Texts that hold a mark stay
    plain, so `restored` always gives the text back.

    Null and empty texts are plain, with an empty output and no token; very long texts are indexed whole; a null id counts as an empty
    one; equal ids draw alike, so repeated rows come out alike; equal cuts leave the middle empty; no documents give no rows.
    A column of docs called as the result (`out`) gives way to it, all others stay.
    """
    marks = _checked(marks)
    own, cuts, form = free(docs, "_own", "_cuts", "_form")
    h = _draws(ref(doc_id), seed)
    found = docs.withColumn(own, F.coalesce(ref(text), F.lit("")))
    found = found.withColumn(cuts, arrow_column(_cuts, _SCHEMA, F.col(own), h[0], h[1]))
    plain = (F.col(own) == "") | (h[2] % 100 >= rate)
    for mark in marks:
        plain = plain | F.contains(F.col(own), F.lit(mark))
    found = found.withColumn(form, F.when(plain, "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm"))
    c, whole = F.col(cuts), F.col(own)
    prefix, middle = F.substring(whole, F.lit(1), c["first"]), F.substring(whole, c["first"] + 1, c["second"] - c["first"])
    suffix = F.substring(whole, c["second"] + 1, F.length(whole))
    p, s, m = (F.lit(x) for x in marks)
    kind = F.col(form)
    output = F.when(kind == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(kind == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(whole)
    cut = lambda x: F.when(kind != "plain", x)
    result = F.struct(
        c["n"].alias("n"), kind.alias("form"), cut(c["first"]).alias("prefix_chars"), cut(c["second"] - c["first"]).alias("middle_chars"),
        output.alias("output"), c["segments"].alias("segments"), c["largest_residual"].alias("largest_residual"),
    )
    return found.withColumn(out, result).drop(own, cuts, form)


def op11(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    own = F.col("infill")
    return made.select(
        "doc_id", *(own[c].alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")),
        sha(own["output"]).alias("output_sha256"), sha(restored(own["output"], own["form"])).alias("restored_sha256"),
    )


def oracle_sql() -> str:
    p, s, m = MARKS
    join = lambda a, b: f"coalesce(array_to_string(list_slice(t, {a}, {b}), ''), '')"
    holds = " or ".join(f"contains(x, '{mark}')" for mark in MARKS)
    return rf"""
with d as (select doc_id, coalesce(text, '') as x, sha256('{SEED}:' || coalesce(doc_id::varchar, '')) as h from documents),
t as (select doc_id, x, regexp_extract_all(x, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as t,
  ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select *, len(t)::bigint as n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) as a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) as b,
  case when x = '' or {holds} or h3 % 100 >= {RATE} then 'plain' when h4 % 100 < {SUFFIX_FIRST} then 'spm' else 'psm' end as form from t),
s as (select doc_id, n, form, x, {join("1", "a")} as prefix, {join("a + 1", "b")} as middle, {join("b + 1", "n")} as suffix from c)
select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
sha256(case form when 'psm' then '{p}' || prefix || '{s}' || suffix || '{m}' || middle when 'spm' then '{s}' || suffix || '{p}' || prefix || '{m}' || middle else x end) as output_sha256,
sha256(x) as restored_sha256 from s
"""

"""Word lists against texts: which lines, and which file names, hold a listed token."""

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from appcorpus.shared import cut

#: Bytes of all tokens together, at most: they go to every task.
MAX_TOKEN_BYTES = 16 << 20
_HITS = "array<struct<line:long,token:string,excerpt:string>>"


def tokens(lines: DataFrame) -> DataFrame:
    """(token) of a word list's `line`s: lower case, without comments (from # on) and blank lines."""
    own = F.lower(F.trim(F.split_part("line", F.lit("#"), F.lit(1))))
    return lines.select(own.alias("token")).where("token <> ''").distinct()


def _scanner(words: list[str]):
    def scan(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import ahocorasick

        def automaton(own: list[str]):
            machine = ahocorasick.Automaton()
            for word in own:
                machine.add_word(word, word)
            machine.make_automaton()
            return machine

        inline = [word for word in words if "\n" not in word]  # no line holds the others, but a path may
        of_lines, of_paths = automaton(inline), automaton(words)
        kind = pa.list_(pa.struct([("line", pa.int64()), ("token", pa.string()), ("excerpt", pa.string())]))
        for names, texts in batches:
            rows = []
            for name, text in zip(names.to_pylist(), texts.to_pylist()):
                body = (text or "").split("\n")
                flat, begins, at = "\n".join(part.lower() for part in body), [], 0
                for part in body:
                    begins.append(at)
                    at += len(part.lower()) + 1
                hits = {(bisect_right(begins, end - len(word) + 1), word) for end, word in of_lines.iter(flat)} if inline and text is not None else set()
                own = [{"line": line, "token": word, "excerpt": body[line - 1].strip(" ")[:140]} for line, word in sorted(hits)]
                named = {word for _, word in of_paths.iter((name or "").lower())} if words else set()
                rows.append(own + [{"line": 0, "token": word, "excerpt": "(file name)"} for word in sorted(named)])
            yield pa.array(rows, kind)

    return scan


def denylist_hits(files: DataFrame, words: DataFrame) -> DataFrame:
    """(path, line, token, excerpt) of files (path, text): every line from 1 on that holds a token, and 0 for a path that does.

    All tokens are looked for in one pass over each text, by one automaton in each task; the list's size is checked first. Nothing
    is shuffled. Null texts have no lines; a token with a line break is in no line, but may be in a path.
    """
    size = words.agg(F.coalesce(F.sum(F.octet_length("token")), F.lit(0))).first()[0]
    if size > MAX_TOKEN_BYTES:
        raise ValueError(f"tokens of {size} bytes: {MAX_TOKEN_BYTES} are the bound")
    found = F.arrow_udf(_scanner(sorted(r.token for r in words.collect())), _HITS)
    return files.select("path", F.explode(found("path", "text")).alias("h")).select("path", "h.*")


def denylist_summary(hits: DataFrame, most: int = 4) -> DataFrame:
    """(token, hits, places): the number of hits and the first places, by path and line; a null path counts as an empty one.

    The texts are scanned once: hits go to the shared folder. Counts are partial sums; of places each task passes on its
    first ones only (a window with a rank limit), so a frequent token never gathers its hits anywhere.
    """
    hits = cut(hits)
    order = Window.partitionBy("token").orderBy(F.coalesce("path", F.lit("")), "line")
    first = hits.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    shown = first.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("k", F.concat(F.coalesce("path", F.lit("")), F.lit(":"), "line").alias("p")))).alias("p"))
    places = shown.select("token", F.array_join(F.transform("p", lambda x: x["p"]), " ").alias("places"))
    return hits.groupBy("token").agg(F.count("*").alias("hits")).join(places, "token")

"""Helpers that the training-data operators share."""

from collections.abc import Callable
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appcorpus import shared
from appcorpus.shipping import ship

#: Rows of an Arrow batch: whole texts are long, and a task holds a batch several times over.
BATCH_ROWS = 2_000

# The characters that end a word, after A-Z became a-z.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in _LOWER)


def _ready() -> None:
    """The package is on the executors, and Arrow batches are small unless the session says otherwise."""
    spark = SparkSession.active()
    ship(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows) == "10000":
        spark.conf.set(rows, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared checkpoint folder; see `appcorpus.shared`."""
    _ready()
    return shared.cut(df)


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that df doesn't have, whatever the caller's columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ref(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def dealt_anew(key: str) -> Column:
    """A long key as a new expression, so that a join deals out both of its sides itself.

    Where one side comes from an aggregation by the same key, Spark would keep that side as it lies, and adaptive
    execution doesn't split a join whose sides aren't both exchanges: a hot key would be one task.
    """
    return F.col(key).bitwiseXOR(F.lit(0).cast("long"))


def words(text: bytes) -> list[bytes]:
    """Letters, digits and non-ASCII, A-Z lower-cased."""
    return text.translate(_WORDS).split()


def lower_tokens(text: bytes) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return text.translate(_LOWER).split()


def utf8(column: pa.Array) -> list[bytes | None]:
    large = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if large else pa.binary()).to_pylist()


class WordHashes(dict):
    """64-bit hash of each word seen; emptied before it grows large."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


def arrow_column(make: Callable, schema: str, *columns: str | Column) -> Column:
    """One Arrow UDF over the columns: make() runs once in each task and gives the function of a batch.

    It counts as non-deterministic so that a filter on its result doesn't run it twice.
    """
    _ready()

    @F.arrow_udf(schema)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for batch in batches:
            yield f(batch)

    @F.arrow_udf(schema)
    def run_many(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        f = make()
        for batch in batches:
            yield f(*batch)

    return (run if len(columns) == 1 else run_many).asNondeterministic()(*columns)


def _fold(doc_id: str | Column, modulus: int) -> Column:
    own = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(own.cast("string").cast("binary")) % modulus


def held_out(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True for the fold that no label may be learnt from; false for a null id."""
    return F.coalesce(_fold(doc_id, modulus) == remainder, F.lit(False))


def learnable(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """True for the rows that may be learnt from; a null id is in no fold, so never."""
    return F.coalesce(_fold(doc_id, modulus) != remainder, F.lit(False))


def hex64(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")

"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination and mixing, each over what the last kept."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appcorpus.llm.common import free, table
from appcorpus.llm.decontaminate import decontaminate
from appcorpus.llm.language import UNDETERMINED, identify
from appcorpus.llm.mixing import mix
from appcorpus.llm.simhash import keep_first
from appcorpus.llm.substring import substring_dedup
from appcorpus.shared import remove_folder, shared_folder


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents with another text; n_chars follows it."""
    new = {"text": F.col(text)}
    if "n_chars" in columns:
        new["n_chars"] = F.when(F.col("text").eqNullSafe(F.col(text)), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    return docs.withColumns(new).select(*columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter) go.

    Learns from the rows' own `lang`; if no row has one, all go. Repeated rows go or stay together; no rows give none; other columns are
    kept, whatever their names.
    """
    (own,) = free(docs, "_language")
    return identify(docs, out=own).where(F.col(own)["lang_pred"] != UNDETERMINED).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose SimHash fingerprints are linked the row of the smallest doc_id stays.

    Texts without words are one component; of rows repeated whole one stays; null ids go behind all others; of equal ids the
    smallest hash of the text. No rows give none; other columns are kept, whatever their names.
    """
    return keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows go from the texts; a text may become empty, its row stays.

    Null texts stay null; windows of rows repeated whole repeat, so they go from all of them. No rows give none; other
    columns are kept, whatever their names.
    """
    (own,) = free(docs, "_dedup")
    return _with_text(substring_dedup(docs, with_text=True, out=own), docs.columns, f"{own}.kept_text")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans that hold benchmark windows go from the texts; a text may become empty, its row stays.

    Null texts stay null and null items have no windows; repeated rows are treated alike; an empty benchmark changes nothing and no
    rows give none; other columns are kept, whatever their names.
    """
    (own,) = free(docs, "_hit")
    return _with_text(decontaminate(docs, table(spark, sf_dir, "benchmark"), with_text=True, out=own), docs.columns, f"{own}.clean_text")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their size, source_size, target and taken, before which columns of these names give way.

    Texts without words are never taken; a null source is one of its own; repeated rows each count; of equal places in the
    seeded order any may be taken; no rows give none.
    """
    (own,) = free(docs, "_mix")
    added = ("size", "source_size", "target", "taken")
    mixed = mix(docs, out=own).where(F.col(own)["taken"] > 0)
    return mixed.select(*(c for c in docs.columns if c not in added), *(F.col(own)[c].alias(c) for c in added))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmark", benchmark), ("mixture", mixture)]
#: The seeded choice and the trained model of two stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are a Parquet table in the shared checkpoint folder until the next is written.

    The last table is what the result reads, so it stays; nulls, ties, repeated rows, empty tables and clashing names are as the stages say.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs

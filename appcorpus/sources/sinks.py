"""Results as files."""

from pyspark.sql import DataFrame

from appcorpus.operators.references import KEY


def write_lines(rows: DataFrame, path: str, *order: str) -> None:
    """The `line` column as text. Parts are ranges of the order: read by name, one after another, they are the whole output."""
    rows.orderBy(*order).select("line").write.text(path)


def write_references(refs: DataFrame, path: str) -> None:
    """References as Parquet, a folder for each kind, so that a search for one kind reads only its files."""
    refs.write.partitionBy("ref_kind").parquet(path)


def write_bucketed(tables: dict[str, DataFrame], folder: str, buckets: int, prefix: str = "catalog") -> dict[str, DataFrame]:
    """Catalog tables with the key of an image (package_id, entry_index, logical_index) as bucketed tables; returns them as tables of the session.

    All have the same buckets, sorted by image, so joins and groupings that include the image's key need no shuffle of them. For
    joins by more columns than the key, the session must be built with `spark.sql.requireAllClusterKeysForCoPartition` false.
    """
    out = {}
    for name, rows in tables.items():
        own = f"{prefix}_{name}"
        rows.repartition(buckets, *KEY).write.mode("overwrite").option("path", f"{folder}/{name}").bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(own)
        out[name] = rows.sparkSession.table(own)
    return out

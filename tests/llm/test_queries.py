import duckdb
import pytest

import corpus_pipeline
from appcorpus.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = db.execute(queries.ORACLES[name])
    columns = [c[0] for c in expected.description]
    found = queries.QUERIES[name](spark, SF).select(*columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected.fetchall()))


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    result = corpus_pipeline.run(spark, SF)
    assert result.columns[: len(documents.columns)] == documents.columns
    assert 0 < result.count() <= documents.count() and result.where("taken <= 0 or taken > 3 * size").count() == 0

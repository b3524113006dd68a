import pytest
from pyspark.sql import functions as F

from appcorpus.operators import references as r
from appcorpus.operators.pages import page
from appcorpus.plans.queries import j01_findrefs_string
from appcorpus.sources.sinks import write_bucketed
from appcorpus.testing.fixtures import view

SF = "/root/testdata/sf0.001"


@pytest.fixture
def joined_by_image(spark):
    """What a session that reads bucketed catalogs is built with."""
    conf = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_references_over_a_bucketed_catalog_without_shuffle(spark, tmp_path, joined_by_image):
    names = ["fx_code_refs", "fx_strings", "fx_methods"]
    tables = write_bucketed({n: view(spark, SF, n) for n in names}, str(tmp_path), 4)
    found = j01_findrefs_string(lambda n: tables[n])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 3
    assert sorted(map(repr, found.collect())) == sorted(map(repr, j01_findrefs_string(lambda n: view(spark, SF, n)).collect()))


@pytest.mark.parametrize("offset, limit", [(0, 5), (4_995, 10), (990, 30), (9_999, 1), (10_000, 5), (50_000, 5), (17, 0), (0, 20_000)])
def test_deep_pages(spark, offset, limit):
    rows = spark.range(10_000).select((F.col("id") % 7).alias("a"), F.when(F.col("id") % 11 != 0, F.concat(F.lit("x"), F.col("id"))).alias("b"), "id").repartition(5)
    expected = [tuple(x) for x in rows.orderBy("a", "b", "id").collect()][offset : offset + limit]
    assert [tuple(x) for x in page(rows, ["a", "b", "id"], offset, limit, range_rows=700).collect()] == expected
    assert page(rows.limit(0), ["a"], offset, limit).count() == 0


def test_a_page_passes_over_one_range_at_most(spark):
    plan = page(spark.range(10_000), ["id"], 9_000, 10, range_rows=500)._jdf.queryExecution().optimizedPlan().toString()
    passed = int(plan.split("Offset ")[1].split()[0])
    assert passed <= 1_500


def test_a_page_computes_its_rows_once(spark):
    asked = spark.sparkContext.accumulator(0)

    def same(k):
        asked.add(1)
        return k

    rows = spark.range(300).select(F.udf(same, "long")("id").alias("id"))
    assert [r.id for r in page(rows, ["id"], 200, 3, range_rows=50).collect()] == [200, 201, 202] and asked.value == 300


def test_key_is_the_image():
    assert r.KEY == ["package_id", "entry_index", "logical_index"]

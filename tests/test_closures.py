import random

import pytest
from pyspark.sql import functions as F

from appcorpus.operators import calls, hierarchy


def by_hand(edges):
    """Shortest distances of all pairs, by breadth-first search from each child."""
    out, up = set(), {}
    for p, a, b in edges:
        up.setdefault((p, a), set()).add(b)
    for p, start in up:
        seen, now, distance = {start}, {start}, 0
        while now:
            out |= {(p, start, x, distance) for x in now}
            now = {b for x in now for b in up.get((p, x), ())} - seen
            seen |= now
            distance += 1
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_both_closures_by_hand(spark, seed):
    """Trees, several parents, cycles, loops and two packages with the same names."""
    rng = random.Random(seed)
    edges = [(p, f"c{k}", f"c{rng.randrange(40) if rng.random() < 0.1 * seed else rng.randrange(k + 1)}") for p in "ab" for k in range(40) for _ in range(rng.choice([1, 1, 2]))]
    rows = spark.createDataFrame(edges, "package_id string, child string, parent string")
    for f in (hierarchy.closure, hierarchy.doubled_closure):
        found = [(r.package_id, r.descriptor, r.ancestor, r.distance) for r in f(rows).collect()]
        assert len(found) == len(set(found)) and set(found) == by_hand(edges)
    some = rows.select("package_id", "child").where("child < 'c2'").distinct()
    assert {(r.package_id, r.descriptor, r.ancestor, r.distance) for r in hierarchy.closure(rows, some).collect()} == {x for x in by_hand(edges) if x[1] < "c2"}


def test_closure_of_many_starts_computes_its_edges_once(spark):
    """Over 64 starts, so several blocks; one evaluation of the edges however many steps."""
    asked = spark.sparkContext.accumulator(0)

    def up(k):
        asked.add(1)
        return k + 1

    edges = spark.range(90).select(F.lit("p").alias("package_id"), F.col("id").alias("child"), F.udf(up, "long")("id").alias("parent"))
    found = {(r.descriptor, r.ancestor, r.distance) for r in hierarchy.closure(edges, edges.where("child >= 10").select("package_id", "child")).collect()}
    assert found == {(a, b, b - a) for a in range(10, 90) for b in range(a, 91)}
    assert asked.value <= 2 * 90


def test_rounds_grow_with_the_digits_of_the_depth(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(hierarchy, "cut", lambda df, f=hierarchy.cut: cuts.append(1) or f(df))
    chain = spark.createDataFrame([("p", k, k + 1) for k in range(100)], "package_id string, child int, parent int")
    assert hierarchy.doubled_closure(chain).agg({"distance": "max"}).first()[0] == 100
    assert len(cuts) <= 2 * 9  # two tables a round, seven digits
    assert hierarchy.doubled_closure(chain.limit(0)).count() == 0


def test_exceptions_of_several_blocks_look_up_handlers_once(spark):
    """Method k calls k - 1; method 0 throws 70 types, 3 takes one of them, 5 takes all. Handlers are evaluated once, not in each round."""
    asked = spark.sparkContext.accumulator(0)

    def seen(x):
        asked.add(1)
        return x

    place = "package_id string, entry_index long, logical_index long, method_index long"
    thrown = [f"LE{k};" for k in range(70)]
    methods = spark.createDataFrame([("p", 0, 0, k, "m") for k in range(8)], f"{place}, name string")
    declared = spark.createDataFrame([("p", 0, 0, 0, e) for e in thrown], f"{place}, exception string")
    edges = spark.createDataFrame([("p", 0, 0, k, 5, (0, 0, k - 1)) for k in range(1, 8)], f"{place}, pc long, body struct<entry_index:long,logical_index:long,method_index:long>")
    rows = [("p", 0, 0, 3, 0, 6, "LE7;"), ("p", 0, 0, 4, 6, 9, None), ("p", 0, 0, 5, 5, 6, None)]
    handlers = spark.createDataFrame(rows, f"{place}, start_addr long, end_addr long, catch_type string").withColumn("end_addr", F.udf(seen, "long")("end_addr"))
    types = spark.createDataFrame([("p", e, up) for e in thrown for up in (e, calls.THROWABLE)], "package_id string, exception string, above string")
    found = {(r.method_index, r.exception, r.inferred) for r in calls.escaping_exceptions(methods, declared, edges, handlers, types).collect()}
    assert found == {(k, e, k > 0) for k in range(5) for e in thrown if k < 3 or e != "LE7;"}
    assert asked.value <= 2 * len(rows)


def test_least_common_supertypes_by_hand(spark):
    """Graphs with several parents and ends that don't reach Object; dominated ancestors are found by single steps."""
    rng = random.Random(5)
    edges = {("p", f"c{k}", hierarchy.OBJECT if k < 2 else f"c{rng.randrange(k)}" if rng.random() < 0.9 else f"x{k}") for k in range(30) for _ in range(2)}
    up = hierarchy.ancestors(spark.createDataFrame(sorted(edges), "package_id string, child string, parent string"))
    far = {}
    for r in up.collect():
        far.setdefault(r.descriptor, {})[r.ancestor] = r.distance
    pairs = [("p", f"c{a}", f"c{b}") for a in range(30) for b in range(30) if (a + b) % 3 == 0]
    found = hierarchy.least_common_supertype(spark.createDataFrame(pairs, "package_id string, l string, r string"), up)
    assert "distance > 0" not in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and str(hierarchy.UNREACHED) in plan

    def by_hand(a, b):
        both = far[a].keys() & far[b].keys()
        least = [x for x in both if not any(far.get(y, {}).get(x, 0) > 0 for y in both)]
        return min(least, key=lambda x: (max(far[a][x], far[b][x]), min(far[a][x], far[b][x]), x))

    assert {(r.l, r.r): r.lcs for r in found.collect()} == {(a, b): by_hand(a, b) for _, a, b in pairs}

"""Which methods reference which strings, types, methods or fields."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appcorpus.functions.names import class_descriptor, fuzzy_pattern

#: Ids are only meaningful inside one DEX file of one package.
KEY = ["package_id", "entry_index", "logical_index"]


def contains_literal(value: Column, pattern: str) -> Column:
    """Case-sensitive and literal; an empty pattern matches nothing."""
    return value.contains(pattern) if pattern else F.lit(False)


def contains_folded(value: Column, pattern: str) -> Column:
    return F.contains(F.lower(value), F.lower(F.lit(pattern)))


def member_condition(name: str | None = None, owner: str | None = None, fuzzy: bool = False) -> Column:
    """A member whose name contains `name` and whose class is, or with fuzzy contains, `owner`; empty counts as not given."""
    if not name and not owner:
        raise ValueError("a member query needs a name or a class")
    out = F.col("name").contains(name) if name else F.lit(True)
    if owner and fuzzy:
        out = out & F.col("owner").contains(fuzzy_pattern(F.lit(owner)))
    elif owner:
        out = out & (F.col("owner") == class_descriptor(F.lit(owner)))
    return out


def find_references(refs: DataFrame, kind: str, targets: DataFrame, methods: DataFrame) -> DataFrame:
    """(dex_id, member, matched) of each method that references a target.

    targets: KEY, target_index and text. The targets are the filtered id table; whether it is broadcast is left to
    Spark, which knows its size. A method's distinct targets are joined in index order.
    """
    hits = refs.where(F.col("ref_kind") == kind).join(targets, [*KEY, "target_index"])
    rows = hits.groupBy(*KEY, "dex_id", "method_index").agg(F.array_sort(F.collect_set(F.struct("target_index", "text"))).alias("t"))
    named = methods.select(*KEY, "method_index", F.concat("owner", F.lit("->"), "name").alias("member"))
    return rows.join(named, [*KEY, "method_index"]).select("package_id", "dex_id", "method_index", "member", F.array_join(F.transform("t", lambda x: x["text"]), "; ").alias("matched"))


def render(rows: DataFrame) -> DataFrame:
    return rows.select("package_id", F.concat("dex_id", F.lit(" | "), "member", F.lit(" | matched=("), "matched", F.lit(")")).alias("line"))

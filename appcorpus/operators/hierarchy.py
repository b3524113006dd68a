"""Class hierarchies: closures, subtype verdicts and what they carry over to members."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from appcorpus.shared import cut, stored

OBJECT = "Ljava/lang/Object;"


#: Distance to Object of a class whose chain of known parents doesn't reach it: a fixed value, beyond any real one.
UNREACHED = (1 << 64) // 4 - 1


def parent_edges(classes: DataFrame) -> DataFrame:
    """(package_id, child, parent) over superclass and interfaces, united over repeated definitions."""
    up = classes.select("package_id", F.col("descriptor").alias("child"), F.explode(F.array_compact(F.array("superclass", "iface1", "iface2"))).alias("parent"))
    return up.distinct()


def flooded(first: DataFrame, onward) -> DataFrame:
    """(package_id, node, block, fresh, distance): the bits that newly come to a node in each round, the first ones at 0.

    first: (package_id, node, block, fresh); onward(those of a round): what they bring to further nodes, as such rows. Each round takes
    the newest bits only and gives one small row for a node, however many bits it has; it ends when no node has a new one.
    """
    key, none = ["package_id", "node", "block"], F.lit(0).cast("long")
    state = stored(first.groupBy(*key).agg(F.bit_or("fresh").alias("fresh")).withColumn("seen", F.col("fresh")))
    levels = []
    while True:
        new = state.where("fresh <> 0").select(*key, "fresh")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, levels) if levels else new.withColumn("distance", none)
        levels.append(new.withColumn("distance", F.lit(len(levels)).cast("long")))
        both = state.select(*key, "seen", none.alias("fresh")).unionByName(onward(new).select(*key, none.alias("seen"), "fresh"))
        both = both.groupBy(*key).agg(F.bit_or("seen").alias("seen"), F.bit_or("fresh").alias("fresh"))
        state = stored(both.select(*key, F.col("fresh").bitwiseAND(F.bitwise_not("seen")).alias("fresh"), F.col("seen").bitwiseOR(F.col("fresh")).alias("seen")))


def closure(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(package_id, descriptor, ancestor, distance) over (package_id, child, parent), the shortest way; each child is its own ancestor at 0.

    starts: (package_id, child) to begin with, defined or not; without it, all children.

    Breadth first, one join of the newest rows for each step, until nothing is new. Starts of a package are numbered and go as bits,
    64 to a row: a row is a class with those that reach it, not a pair, and pairs come out at the end only. Edges are computed
    once. Cycles end by themselves.
    """
    edges = stored(edges.select("package_id", "child", "parent").distinct())
    number = F.row_number().over(Window.partitionBy("package_id").orderBy("child")) - 1
    starts = (edges if starts is None else starts).select("package_id", "child").distinct().withColumn("n", number)
    starts = stored(starts.select("package_id", "child", F.expr("n div 64").alias("block"), (F.col("n") % 64).alias("bit")))
    first = starts.select("package_id", F.col("child").alias("node"), "block", F.expr("shiftleft(1L, bit)").alias("fresh"))
    up = edges.withColumnRenamed("child", "node")
    levels = flooded(first, lambda new: new.join(up, ["package_id", "node"]).select("package_id", F.col("parent").alias("node"), "block", "fresh"))
    of_block = starts.groupBy("package_id", "block").agg(F.collect_list(F.struct("bit", "child")).alias("starts"))
    found = levels.join(of_block, ["package_id", "block"])
    found = found.select("package_id", "node", "distance", F.explode(F.filter("starts", lambda s: F.getbit("fresh", s["bit"]) == 1)).alias("s"))
    return found.select("package_id", F.col("s.child").alias("descriptor"), F.col("node").alias("ancestor"), "distance")


def doubled_closure(edges: DataFrame) -> DataFrame:
    """The same rows as `closure(edges)` in as many rounds as the longest distance has binary digits, and one more.

    After k rounds all pairs nearer than 2^k steps are known, with their distance, beside the pairs that exactly 2^k steps join. The
    next round takes one such leap behind each known way, and leaps behind leaps. In a class hierarchy leaps are at most about
    as many as edges, so the rows joined are those of the result; a dense graph with cycles is better walked step by step. Cycles
    end by themselves: a round without a new pair is the last.
    """
    key = ["package_id", "descriptor", "ancestor"]
    known = cut(edges.select("package_id", F.col("child").alias("descriptor"), F.col("child").alias("ancestor"), F.lit(0).cast("long").alias("distance")).distinct())
    leaps, steps, size = cut(edges.select("package_id", F.col("child").alias("ancestor"), F.col("parent").alias("further")).distinct()), 1, known.count()
    while True:
        more = known.join(leaps, ["package_id", "ancestor"]).select("package_id", "descriptor", F.col("further").alias("ancestor"), (F.col("distance") + steps).alias("distance"))
        known = cut(known.unionByName(more).groupBy(*key).agg(F.min("distance").alias("distance")))
        before, size = size, known.count()
        if size == before:
            return known
        again = leaps.select("package_id", F.col("ancestor").alias("further"), F.col("further").alias("end"))
        leaps, steps = cut(leaps.join(again, ["package_id", "further"]).select("package_id", "ancestor", F.col("end").alias("further")).distinct()), steps * 2


def ancestors(edges: DataFrame) -> DataFrame:
    """The closure of a class hierarchy: Object is an ancestor of every class, at UNREACHED where no known chain leads to it."""
    known = doubled_closure(edges)
    reached = known.where(F.col("ancestor") == OBJECT).select("package_id", "descriptor")
    rest = known.where("distance = 0").select("package_id", "descriptor").join(reached, ["package_id", "descriptor"], "left_anti")
    return known.unionByName(rest.select("package_id", "descriptor", F.lit(OBJECT).alias("ancestor"), F.lit(UNREACHED).cast("long").alias("distance")))


def incomplete(closure: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes whose ancestry meets an undefined class other than Object."""
    defined = edges.select("package_id", F.col("child").alias("ancestor")).distinct()
    return closure.where(F.col("ancestor") != OBJECT).join(defined, ["package_id", "ancestor"], "left_anti").select("package_id", "descriptor").distinct()


def subtype_relation(pairs: DataFrame, closure: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (package_id, descriptor, expected) with verdict yes, no or unknown (the walk met an undefined class)."""
    up = closure.select("package_id", "descriptor", F.col("ancestor").alias("expected"), F.lit(True).alias("_yes"))
    open_end = incomplete(closure, edges).withColumn("_open", F.lit(True))
    out = pairs.join(up, ["package_id", "descriptor", "expected"], "left").join(open_end, ["package_id", "descriptor"], "left")
    return out.withColumn("verdict", F.when((F.col("expected") == OBJECT) | F.col("_yes"), "yes").when(F.col("_open"), "unknown").otherwise("no")).drop("_yes", "_open")


def least_common_supertype(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    """pairs (package_id, l, r) with `lcs`: of the common ancestors that no other one is below, the nearest by (max, sum, name).

    Object is common to all classes of the closure, so each pair of them has one. What is above a common ancestor is common too, so
    one has another below it exactly if one of those is a single step below it, or never reaches Object.
    """
    left = closure.select("package_id", F.col("descriptor").alias("l"), "ancestor", F.col("distance").alias("dl"))
    right = closure.select("package_id", F.col("descriptor").alias("r"), "ancestor", F.col("distance").alias("dr"))
    common = pairs.join(left, ["package_id", "l"]).join(right, ["package_id", "r", "ancestor"])
    below = closure.where(F.col("distance").isin(1, UNREACHED)).select("package_id", F.col("descriptor").alias("lower"), "ancestor")
    lower = common.select("package_id", "l", "r", F.col("ancestor").alias("lower"))
    dominated = lower.join(below, ["package_id", "lower"]).select("package_id", "l", "r", "ancestor").distinct()
    best = common.join(dominated, ["package_id", "l", "r", "ancestor"], "left_anti")
    rank = F.struct(F.greatest("dl", "dr"), F.least("dl", "dr"), "ancestor")
    return best.groupBy("package_id", "l", "r").agg(F.min_by("ancestor", rank).alias("lcs"))


def overloads(closure: DataFrame, methods: DataFrame) -> DataFrame:
    """Per class, name and arity: the sorted distinct descriptors on it or any ancestor."""
    from appcorpus.functions.names import proto_params

    own = methods.select("package_id", F.col("owner").alias("ancestor"), "name", "proto", F.size(proto_params(F.col("proto"))).alias("arity")).distinct()
    found = closure.join(own, ["package_id", "ancestor"]).groupBy("package_id", "descriptor", "name", "arity")
    return found.agg(F.array_join(F.array_sort(F.collect_set("proto")), " ").alias("protos"))


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")

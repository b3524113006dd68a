"""Quality: a sparse rule ensemble (Friedman and Popescu) over text statistics, compiled into one Spark expression."""

import math

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free, held_out, learnable, ref, table

#: Labelled documents that the rules are learnt from, at most about: the bounded sample.
TRAIN_ROWS = 20_000
TREES, DEPTH, LASSO = 10, 3, 0.001
#: Partitions of the sample: a few thousand rows of numbers each, for many small jobs.
PARTITIONS = 2
THRESHOLD = 0.3
# The characters whose shares of the text are statistics, as runs.
PATTERNS = {"upper": r"\p{Lu}+", "symbol": r"[^\p{L}\p{N}\s.,;:'\"?()-]+", "digit": r"\p{N}+", "stop": "[.?]+", "line": r"\n+"}
STATISTICS = ["log_chars", "word_length", "distinct", "distinct_lines", *PATTERNS]


def with_statistics(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with a struct of statistics of the whole text, doubles all; a null or empty text has all 0 but one distinct line of one.

    All are JVM expressions. What several of them need (the words, the lines) is a column of its own, so that nothing is
    computed twice.
    """
    own, tokens, lines = free(df, "_own", "_tokens", "_lines")
    df = df.withColumn(own, F.coalesce(ref(text), F.lit("")))
    df = df.withColumns({tokens: F.array_remove(F.split(own, r"\s+"), ""), lines: F.split(own, "\n")})
    chars, n = F.length(own), F.size(tokens)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = {"log_chars": F.log1p(chars.cast("double")), "word_length": share(chars.cast("double"), n), "distinct": share(F.size(F.array_distinct(tokens)).cast("double"), n)}
    out["distinct_lines"] = F.size(F.array_distinct(lines)) / F.size(lines)
    out |= {k: share((chars - F.length(F.regexp_replace(own, pattern, ""))).cast("double"), chars) for k, pattern in PATTERNS.items()}
    return df.withColumn(name, F.struct(*(out[k].alias(k) for k in STATISTICS))).drop(own, tokens, lines)


def _paths(node, names: list[str], path: tuple = ()) -> list[tuple]:
    """Every path of a tree as conditions (statistic, at most?, threshold)."""
    found = [path] if path else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        at = (names[split.featureIndex()], split.threshold())
        found += _paths(node.leftChild(), names, (*path, (at[0], True, at[1])))
        found += _paths(node.rightChild(), names, (*path, (at[0], False, at[1])))
    return found


def _merged(path: tuple) -> tuple:
    """A path's conditions without those that others imply, in a fixed order."""
    tight: dict[tuple[str, bool], float] = {}
    for name, low, at in path:
        tight[name, low] = (min if low else max)(at, tight.get((name, low), at))
    return tuple(sorted((name, low, at) for (name, low), at in tight.items()))


def rule_column(rule: tuple, stats: dict[str, Column]) -> Column:
    out = F.lit(True)
    for name, low, at in rule:
        out = out & (stats[name] <= at if low else stats[name] > at)
    return out


class Rules:
    """Weighted rules and an intercept; column() compiles them."""

    def __init__(self, weights: dict[tuple, float], bias: float):
        self.weights, self.bias = weights, bias

    def column(self, stats: dict[str, Column]) -> Column:
        z = F.lit(float(self.bias))
        for rule, w in self.weights.items():
            z = z + F.when(rule_column(rule, stats), float(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS, seed: int = 1) -> Rules:
    """Learns from about `rows` labelled documents at most, outside the held-out fold, chosen by a hash of the id.

    A random forest proposes the rules, a lasso logistic regression weighs them; both are Spark ML over the sample's
    statistics. The sample of labels is broadcast (its size is bounded by `rows`), so texts aren't shuffled; of rows with one id
    the one of the smallest statistics counts, so the sample is bounded by `rows` whatever repeats.
    """
    known = labels.select(F.col("doc_id").alias("i"), F.col(label).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & learnable("i", 5, 0))
    known = known.groupBy("i").agg(F.min("y").alias("y"))
    n = known.count()
    part = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1 << 30)) < int(min(1.0, rows / max(n, 1)) * (1 << 30))
    own = docs.select(ref(doc_id).alias("i"), ref(text).alias("text")).join(F.broadcast(known.where(part)), "i")
    own = with_statistics(own, "text", "s").groupBy("i").agg(F.first("y").alias("y"), F.min("s").alias("s")).select("i", "y", "s.*")
    own = cut(own.repartition(PARTITIONS, "i").sortWithinPartitions("i"))
    found = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return Rules({}, math.log((found.get(1.0, 0) + 1) / (found.get(0.0, 0) + 1)))
    names = STATISTICS
    ready = VectorAssembler(inputCols=names, outputCol="_features").transform(own)
    forest = RandomForestClassifier(featuresCol="_features", labelCol="y", numTrees=TREES, maxDepth=DEPTH, seed=seed, featureSubsetStrategy="onethird").fit(ready)
    rules = sorted({_merged(p) for t in forest.trees for p in _paths(t._call_java("rootNode"), names)})
    if not rules:
        return Rules({}, math.log((found[1.0] + 1) / (found[0.0] + 1)))
    columns = {k: F.col(k) for k in names}
    held = own.select("y", *(rule_column(r, columns).cast("double").alias(f"r{k}") for k, r in enumerate(rules)))
    held = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="_rules").transform(held).select("y", "_rules")
    lasso = LogisticRegression(featuresCol="_rules", labelCol="y", elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(held)
    return Rules({r: w for r, w in zip(rules, lasso.coefficients.toArray().tolist()) if w}, lasso.intercept)


def quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS, out: str = "quality_score") -> DataFrame:
    """docs, all columns, with a column `quality_score`: the probability that the text's quality label is 1.

    Only JVM expressions score, in one pass without a shuffle. Null texts count as empty, whose statistics are all 0;
    very long texts are read whole. Labels may be missing, null, repeated (the smallest counts) or of one class only:
    then the score is the class's share for all. A statistic at a rule's threshold counts as below it. Repeated rows score alike; no
    documents give no rows; reruns agree. All columns are kept, whatever their names; one called as the result (`out`) gives way to it.
    """
    rules = train(docs, labels, doc_id, text, rows=rows)
    (own,) = free(docs, "_stats")
    return with_statistics(docs, text, own).withColumn(out, rules.column({k: F.col(own)[k] for k in STATISTICS})).drop(own)


def op4(spark, sf_dir: str) -> DataFrame:
    scored = quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))

"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (after Wang and Manning)."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, cut, held_out, learnable, ref, table

ORDERS = (3, 4, 5)
#: Labelled documents that the model is fitted on, at most: the bounded sample.
TRAIN_ROWS = 8_000
#: An n-gram is a feature if it stands in so many sampled documents, and if its log-count ratio is so many standard errors
#: from zero. All that pass are fitted; there is no other limit.
MIN_DOCUMENTS, MIN_ERRORS = 3, 4.0
PENALTY = 1e-3
ROUNDS = 400
THRESHOLD = 0.7
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20
#: N-gram hashes that a task holds before it sums them up and sends them on.
HELD = 1 << 21


def grams(text: str):
    """64-bit hashes of the n-grams of the lower-cased text, framed by spaces, in parts and repeated as they stand."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for low in range(0, len(points), _CHUNK):
        x = points[low : low + _CHUNK + ORDERS[-1] - 1].astype(np.uint64) + np.uint64(1)
        h = x
        for n in range(2, ORDERS[-1] + 1):
            if len(x) < n:
                break
            h = h[:-1] * _BASE + x[n - 1 :]
            if n in ORDERS:
                g = (h ^ (h >> np.uint64(29))) * _MIX + np.uint64(n)
                yield ((g ^ (g >> np.uint64(32))) * _BASE).view(np.int64)


def known(texts: pa.Array, chosen: np.ndarray):
    """For each text the places in the sorted hashes `chosen` of its n-grams, each once."""
    seen = np.zeros(len(chosen), bool)
    for text in texts:
        for own in grams(text.as_py() or "") if len(chosen) else ():
            at = np.minimum(np.searchsorted(chosen, own), len(chosen) - 1)
            seen[at[chosen[at] == own]] = True
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def _counts(batches):
    """Documents of either class with each n-gram; rows are sums over some documents, sent on whenever their hashes are many."""

    def out(sides: tuple[list, list]):
        both = [np.concatenate([np.zeros(0, np.int64), *side]) for side in sides]
        some, place = np.unique(np.concatenate(both), return_inverse=True)
        n0, n1 = (np.bincount(part, minlength=len(some)) for part in np.split(place, [len(both[0])]))
        for low in range(0, len(some), 50_000):
            at = slice(low, low + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(some[at]), pa.array(n0[at].astype(np.int64)), pa.array(n1[at].astype(np.int64))], ["gram", "n0", "n1"])

    sides, held = ([], []), 0
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"].to_pylist()):
            own = np.zeros(0, np.int64)
            for part in grams(text.as_py()):
                own = np.union1d(own, part)
            sides[y].append(own)
            held += len(own)
            if held >= HELD:
                yield from out(sides)
                sides, held = ([], []), 0
    yield from out(sides)


def _kept(chosen):
    def make():
        return lambda texts: pa.array([found.astype(np.int32) for found in known(texts, chosen.value)], pa.list_(pa.int32()))

    return make


def ratios(n1: np.ndarray, n0: np.ndarray, size1: int, size0: int) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram's smoothed log-count ratio, from the documents of either class that have it, and its distance from zero in standard errors."""
    a, b = n1 + 1.0, n0 + 1.0
    ratio = np.log(a / (size1 + 2)) - np.log(b / (size0 + 2))
    return ratio, np.abs(ratio) / np.sqrt(1 / a - 1 / (size1 + 2) + 1 / b - 1 / (size0 + 2))


def fit(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; each feature's value is its ratio where present.

    Both classes weigh the same, however many documents they have.
    """
    n = len(rows)
    column = np.concatenate(rows) if n else np.zeros(0, np.int32)
    row = np.repeat(np.arange(n), [len(r) for r in rows])
    value = ratio[column]
    own = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum())) * n
    step = 4 / max(1e-9, float((own * (1 + np.bincount(row, value * value, n))).sum()) / n * 0.5 + 4 * penalty)
    weight = momentum = np.zeros(len(ratio))
    bias = bias_momentum = 0.0
    for t in range(rounds):
        z = np.bincount(row, value * momentum[column], n) + bias_momentum
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * own
        gradient = np.bincount(column, value * error[row], len(ratio)) / n + penalty * momentum
        new, new_bias = momentum - step * gradient, bias_momentum - step * error.mean()
        k = t / (t + 3)
        momentum, bias_momentum = new + k * (new - weight), new_bias + k * (new_bias - bias)
        weight, bias = new, new_bias
    return weight, float(bias)


class Toxicity:
    """Sorted n-gram hashes, their weights, and the intercept."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias


_NONE = np.zeros(0, np.int64), np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", label_id: str = "doc_id", rows: int = TRAIN_ROWS, seed: int = 1) -> Toxicity:
    """Fits on at most about `rows` labelled documents outside the held-out fold, chosen by a hash of the id.

    The sample of labels is broadcast (its size is bounded by `rows`), so texts aren't shuffled to find their labels; of rows
    with one id the smallest text counts. The driver gets one row for each n-gram that passes, then the sample's features.
    """
    labelled = labels.select(ref(label_id).alias("i"), ref(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & learnable("i", 3, 1))
    labelled = labelled.groupBy("i").agg(F.max("y").alias("y"))
    n = labelled.count()
    if not n:
        return Toxicity(*_NONE, 0.0)
    part = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1 << 30)) < int(min(1.0, rows / n) * (1 << 30))
    sample = F.broadcast(labelled.where(part))
    own = docs.select(ref(doc_id).alias("i"), ref(text).alias("text")).join(sample, "i").groupBy("i").agg(F.first("y").alias("y"), F.coalesce(F.min("text"), F.lit("")).alias("text"))
    own = cut(own.repartition(docs.sparkSession.sparkContext.defaultParallelism, "i"))
    total = own.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    size1, size0 = total[1], total[0] - total[1]
    if not size0 or not size1:
        return Toxicity(*_NONE, 4.0 if size1 else -4.0 if size0 else 0.0)
    a, b = F.col("n1") + 1.0, F.col("n0") + 1.0
    error = F.sqrt(1 / a - 1 / (size1 + 2) + 1 / b - 1 / (size0 + 2))
    far = F.abs(F.log(a / (size1 + 2)) - F.log(b / (size0 + 2))) >= (MIN_ERRORS - 1e-6) * error
    sums = own.select("text", "y").mapInArrow(_counts, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    sums = sums.where(F.col("n0") + F.col("n1") >= MIN_DOCUMENTS).where(far).toPandas().sort_values("gram")
    ratio, errors = ratios(sums.n1.to_numpy(), sums.n0.to_numpy(), size1, size0)
    chosen, ratio = sums.gram.to_numpy()[errors >= MIN_ERRORS], ratio[errors >= MIN_ERRORS]
    shared = own.sparkSession.sparkContext.broadcast(chosen)
    fitted = own.select("i", "y", arrow_column(_kept(shared), "array<int>", "text").alias("f")).toPandas().sort_values("i")
    weight, bias = fit([np.asarray(f, np.int32) for f in fitted.f], fitted.y.to_numpy(float), ratio)
    return Toxicity(chosen, weight * ratio, bias)


def _score(broadcast):
    def make():
        model = broadcast.value

        def batch(texts: pa.Array) -> pa.Array:
            z = np.array([float(model.weights[found].sum()) for found in known(texts, model.chosen)]) + model.bias
            return pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())

        return batch

    return make


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", label_id: str = "doc_id", rows: int = TRAIN_ROWS, out: str = "toxicity") -> DataFrame:
    """docs, all columns, with a column `toxicity`: the probability that the text is toxic, from its n-grams alone.

    Null texts count as empty and score like a text without known n-grams; very long texts are read whole. Labels may be
    missing, null, repeated (the largest counts) or of one class only; without any, all scores are 0.5. Reruns agree; repeated
    rows score alike; no documents give no rows. All columns are kept; one called as the result (`out`) gives way to it.
    """
    model = train(docs, labels, doc_id, text, label, label_id, rows)
    return docs.withColumn(out, toxicity_column(docs.sparkSession, model, ref(text)))


def toxicity_column(spark, model: Toxicity, text: str | Column) -> Column:
    return arrow_column(_score(spark.sparkContext.broadcast(model)), "double", text)


def op9(spark, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))

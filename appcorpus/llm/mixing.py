"""Mixing overlapping sources to target weights by a min-cost flow from membership patterns to source quotas."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, ref, table

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: A pattern's documents are taken in a seeded order, which is cut into slots of about so many documents of all
#: patterns together; only the slot where the quota ends is sorted.
SLOT_ROWS, MAX_SLOT_BITS = 500, 20
#: Rows the driver may get: one for each combination of sources, which grows with sources, not with documents.
MAX_PATTERNS = 50_000


def source_targets(sizes: dict[str | None, int], total: int, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Targets by weight, the sources in code-point order and null last; what exceeds `most` x size is shared again by weight."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    done: dict[str | None, float] = {}
    while free := [s for s in order if s not in done]:
        left, shares = total - sum(done.values()), sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / shares > most * sizes[s]]
        done |= {s: float(most * sizes[s]) for s in above} if above else {s: left * weight[s] / shares for s in free}
    return done


class Flow:
    """Words of each pattern to each of its sources, as much as the quotas take.

    A path uses one repetition's arc and else only free ones, so the cheapest paths are those of the lowest repetition that
    still reaches a quota: repetition by repetition, blocking flows over shortest ways until there is none left.
    """

    def __init__(self, own: list[list[int]], quotas: list[int]):
        self.own, self.left = own, list(quotas)
        self.sent = [[0] * len(places) for places in own]
        self.back: list[list[tuple[int, int]]] = [[] for _ in quotas]
        for p, places in enumerate(own):
            for k, s in enumerate(places):
                self.back[s].append((p, k))

    def _levels(self, supply: list[int]) -> tuple[list[int], list[int]] | None:
        """Distances of patterns and sources from the patterns that have words left, up to the nearest open quota; None if none is reached."""
        of_pattern, of_source = [0 if n else -1 for n in supply], [-1] * len(self.left)
        now, reached, level = [p for p, n in enumerate(supply) if n], False, 0
        while now and not reached:
            level, found = level + 1, []
            for p in now:
                for s in self.own[p]:
                    if of_source[s] < 0:
                        of_source[s] = level
                        found.append(s)
                        reached |= self.left[s] > 0
            level, now = level + 1, []
            for s in () if reached else found:
                for p, k in self.back[s]:
                    if of_pattern[p] < 0 and self.sent[p][k]:
                        of_pattern[p] = level
                        now.append(p)
        return (of_pattern, of_source) if reached else None

    def add(self, sizes: list[int]) -> list[int]:
        """Sends as many of these words as possible, cheapest ways first; returns how many of each pattern went."""
        supply = list(sizes)
        while (levels := self._levels(supply)) is not None:
            of_pattern, of_source = levels
            next_own, next_back = [0] * len(self.own), [0] * len(self.left)
            for start in range(len(supply)):
                path: list[tuple[int, int]] = []  # (pattern, which of its sources), the source's way on being back[s][next_back[s]]
                p = start
                while supply[start]:
                    if next_own[p] == len(self.own[p]):
                        if not path:
                            break
                        p, k = path.pop()
                        next_back[self.own[p][k]] += 1
                        continue
                    k = next_own[p]
                    s = self.own[p][k]
                    if of_source[s] != of_pattern[p] + 1:
                        next_own[p] += 1
                        continue
                    if self.left[s]:
                        steps = [*path, (p, k)]
                        turns = [self.back[self.own[a][i]][next_back[self.own[a][i]]] for a, i in path]
                        n = min([supply[start], self.left[s], *(self.sent[b][j] for b, j in turns)])
                        for a, i in steps:
                            self.sent[a][i] += n
                        for b, j in turns:
                            self.sent[b][j] -= n
                        self.left[s] -= n
                        supply[start] -= n
                        path, p = [], start
                        continue
                    on = self.back[s]
                    while next_back[s] < len(on) and not (self.sent[on[next_back[s]][0]][on[next_back[s]][1]] and of_pattern[on[next_back[s]][0]] == of_source[s] + 1):
                        next_back[s] += 1
                    if next_back[s] == len(on):
                        next_own[p] += 1
                        continue
                    path.append((p, k))
                    p = on[next_back[s]][0]
        return [n - left for n, left in zip(sizes, supply)]


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], most: int = MAX_REPEATS) -> dict[tuple, int]:
    """Words to take of each pattern. The r-th repetition of a word costs r, so fresh words go first."""
    order = sorted(patterns, key=lambda p: [(s is None, s or "") for s in p])
    place = {s: k for k, s in enumerate(quotas)}
    flow, sizes = Flow([[place[s] for s in p] for p in order], list(quotas.values())), [patterns[p] for p in order]
    taken = [0] * len(order)
    for _ in range(most):
        taken = [a + b for a, b in zip(taken, flow.add(sizes))]
    return dict(zip(order, taken))


def _plan(spark, rows: list, total: int, most: int):
    patterns = {tuple(r["pattern"]): r["size"] for r in rows}
    sizes: dict[str | None, int] = {}
    for pattern, n in patterns.items():
        for s in pattern:
            sizes[s] = sizes.get(s, 0) + n
    targets = source_targets(sizes, total, most=most)
    taken = route(patterns, {s: round(t) for s, t in targets.items()}, most)
    out = [(list(p), [sizes[s] for s in p], [targets[s] for s in p], taken[p] // n if n else 0, taken[p] % n if n else 0) for p, n in patterns.items()]
    return spark.createDataFrame(out, "pattern array<string>, sizes array<long>, targets array<double>, whole long, rest long")


def _memberships(docs: DataFrame, sources: str | Column) -> Column:
    """The sorted distinct sources of each document; none at all counts as the null source."""
    own = ref(sources) if isinstance(sources, str) else sources
    if not docs.select(own.alias("s")).schema["s"].dataType.typeName().startswith("array"):
        return F.array(own.cast("string"))
    named = F.array_sort(F.array_distinct(own.cast("array<string>")))  # nulls last
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(None).cast("string")))


def mix(docs: DataFrame, sources: str | Column = "source", doc_id: str = "doc_id", text: str = "text", seed: int = 0, most: int = MAX_REPEATS, out: str = "mix") -> DataFrame:
    """docs, all columns, with a struct column `mix`: size, source_size, target, taken and repeats.

    sources: a column of one source, or of an array for documents that belong to several, in any order and with repeats
    (source_size and target are then of the first in order; sums by source count such a document in each). Documents are
    summed by membership pattern and slot of a seeded hash in Spark; the driver gets one row for each pattern (an error
    over MAX_PATTERNS), solves the flow and returns how often each pattern is taken whole and how many words more.
    Those come from the pattern's documents in seeded order; the one where the rest ends is taken if that is nearer.
    Texts are never shuffled but for that one slot of each pattern.

    Null and blank texts have size 0 and are never taken; very long texts are counted whole; a null source, and an empty or null
    array, is a source of its own, last in order; repeated rows each count; of equal places in the seeded order (rows repeated
    whole) any may be taken; no documents give no rows. Reruns agree. All columns are kept, whatever their names; one
    called as the result (`out`) gives way to it.
    """
    spark = docs.sparkSession
    pattern, size, order, slot, more = free(docs, "_pattern", "_size", "_order", "_slot", "_more")
    p_sizes, p_targets, p_whole, p_rest, p_end = free(docs, "_sizes", "_targets", "_whole", "_rest", "_end")
    bits = max(0, min(MAX_SLOT_BITS, (docs.count() // SLOT_ROWS).bit_length()))
    dealt = docs.withColumns({
        pattern: _memberships(docs, sources),
        size: F.coalesce(F.regexp_count(ref(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
        order: F.xxhash64(F.lit(seed), ref(doc_id), ref(text)),
    })
    # the slot is the order's first bits, so that the order of slots is the order of documents
    dealt = dealt.withColumn(slot, F.shiftright(F.col(order), 63 - bits))
    slots = cut(dealt.groupBy(F.col(pattern).alias("pattern"), F.col(slot).alias("slot")).agg(F.sum(size).alias("size")))
    patterns = slots.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} combinations of sources")
    plan = _plan(spark, patterns, sum(r["size"] for r in patterns), most)
    by_slot = Window.partitionBy("pattern").orderBy("slot")
    ends = slots.join(F.broadcast(plan), "pattern").withColumn("until", F.sum("size").over(by_slot)).where("until >= rest")
    ends = ends.groupBy("pattern").agg(F.min_by(F.struct("slot", (F.col("until") - F.col("size")).alias("before")), "slot").alias("end"))
    known = plan.join(ends, "pattern", "left").toDF(pattern, p_sizes, p_targets, p_whole, p_rest, p_end)
    ready = dealt.join(F.broadcast(known), pattern)
    inside = F.col(slot) == F.col(p_end)["slot"]
    plain = ready.where(~F.coalesce(inside, F.lit(False))).withColumn(more, (F.col(slot) < F.col(p_end)["slot"]).cast("int"))
    upto = Window.partitionBy(pattern).orderBy(order, ref(doc_id), size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.col(p_end)["before"] + F.sum(size).over(upto) - F.col(size) / 2
    edge = ready.where(inside).withColumn(more, (reach <= F.col(p_rest)).cast("int"))
    repeats = F.col(p_whole) + F.coalesce(F.col(more), F.lit(0))
    result = F.struct(
        F.col(size).alias("size"), F.col(p_sizes)[0].alias("source_size"), F.col(p_targets)[0].alias("target"),
        (repeats * F.col(size)).alias("taken"), F.when(F.col(size) > 0, repeats).otherwise(0).alias("repeats"),
    )
    return plain.unionByName(edge).withColumn(out, result).select(*(ref(c) for c in docs.columns if c.lower() != out.lower()), out)


def op8(spark, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")

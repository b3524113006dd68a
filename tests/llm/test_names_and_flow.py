import random
import time
from collections import deque

import pyarrow as pa
import pytest

from appcorpus.llm import language, mixing, toxicity


def by_paths(patterns, quotas, most):
    """(words sent, cost) by one cheapest path at a time."""
    to, room, cost, out = [], [], [], {}

    def arc(a, b, r, c):
        for x, y, n, k in ((a, b, r, c), (b, a, 0, -c)):
            out.setdefault(x, []).append(len(to))
            to.append(y), room.append(n), cost.append(k)

    for s, q in quotas.items():
        arc(("s", s), "sink", q, 0)
    for p, n in patterns.items():
        for r in range(most):
            arc("source", p, n, r)
        for s in p:
            arc(p, ("s", s), n * most, 0)
    sent = paid = 0
    while True:
        best, via, queue = {"source": 0}, {}, deque(["source"])
        while queue:
            x = queue.popleft()
            for e in out.get(x, ()):
                if room[e] and best[x] + cost[e] < best.get(to[e], 10**9):
                    best[to[e]], via[to[e]] = best[x] + cost[e], e
                    queue.append(to[e])
        if "sink" not in via:
            return sent, paid
        path, y = [], "sink"
        while y != "source":
            path.append(via[y])
            y = to[via[y] ^ 1]
        n = min(room[e] for e in path)
        for e in path:
            room[e] -= n
            room[e ^ 1] += n
        sent, paid = sent + n, paid + n * best["sink"]


def some(rng, sources, n, most_size=60):
    names = [f"s{k}" for k in range(sources)]
    patterns = {tuple(sorted(rng.sample(names, rng.randint(1, min(4, sources))))): rng.randint(0, most_size) for _ in range(n)}
    return patterns, {s: rng.randint(0, most_size * n // sources) for s in names}


@pytest.mark.parametrize("seed", range(40))
def test_flow_is_as_large_and_cheap_as_by_single_paths(seed):
    rng = random.Random(seed)
    patterns, quotas = some(rng, rng.randint(1, 6), rng.randint(1, 14))
    taken = mixing.route(patterns, quotas, 3)
    assert all(0 <= taken[p] <= 3 * n for p, n in patterns.items())
    cost = sum(r * min(max(taken[p] - r * n, 0), n) for p, n in patterns.items() for r in range(3))
    assert (sum(taken.values()), cost) == by_paths(patterns, quotas, 3)


def test_flow_of_many_patterns_takes_seconds():
    patterns, quotas = some(random.Random(1), 60, 9_000, 10_000)
    began = time.process_time()
    taken = mixing.route(patterns, quotas)
    assert len(patterns) > 5_000 and time.process_time() - began < 30
    assert sum(taken.values()) <= sum(quotas.values())


def test_every_name_is_a_parameter(spark):
    rows = [(k, ("der hund und die katze " if k % 2 else "the dog and the cat ") * 9 + ("hate" if k % 3 == 0 else "love") * 5, "de" if k % 2 else "en") for k in range(400)]
    docs = spark.createDataFrame(rows, "key long, body string, tongue string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _, _ in rows], "which long, bad int")
    found = language.identify(docs, text="body", doc_id="key", lang="tongue", out="found").collect()
    assert all(r.found.lang_pred == r.tongue for r in found)
    scored = toxicity.toxicity(docs, labels, text="body", doc_id="key", label="bad", label_id="which", out="found").collect()
    assert all((r.found >= 0.5) == (r.key % 3 == 0) for r in scored)


def test_counts_are_sent_on_when_many(monkeypatch):
    batch = pa.record_batch([pa.array(["some text here", "other text", "some more"]), pa.array([0, 1, 1])], ["text", "y"])
    sums = lambda batches: {g: (sum(x[1] for x in rows if x[0] == g), sum(x[2] for x in rows if x[0] == g)) for rows in [[tuple(r.values()) for b in batches for r in b.to_pylist()]] for g in {r[0] for r in rows}}
    whole = list(toxicity._counts([batch]))
    monkeypatch.setattr(toxicity, "HELD", 4)
    parts = list(toxicity._counts([batch]))
    assert len(parts) > len(whole) and sums(parts) == sums(whole)

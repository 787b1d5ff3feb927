"""Targets by whole rounds of resharing, many sources, null ids, and how near the taken words come."""

import collections
from fractions import Fraction

import numpy as np
import pytest

from voxelframe.llm import mixing

SCHEMA = "doc_id long, text string, source string, w double, rate double"


def plain_targets(sizes, weights=mixing.WEIGHTS, limit=mixing.LIMIT):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = [s for s in order if s not in capped]
        level = Fraction(total - sum(limit * sizes[s] for s in capped), sum(weight[s] for s in left)) if left else 0
        more = {s for s in left if weight[s] * level > limit * sizes[s]}
        if not more:
            return {s: float(min(limit * sizes[s], weight[s] * level)) for s in order}
        capped |= more


@pytest.mark.parametrize("broadcast", [10_000, 3])
def test_many_sources(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    rng = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        source = None if i % 50 == 0 else f"s{int(rng.zipf(1.3)) % 400}"
        rows.append((i if i % 40 else None, "x " * int(rng.integers(0, 30)) if i % 77 else None, source, 0.0, 0.0))
    rows += [rows[3]] * 4 + [(99_999, "y " * 100_000, "s1", 0.0, 0.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sizes, size = collections.Counter(), lambda t: (t or "").count(" ")
    for _, t, s, _, _ in rows:
        sizes[s] += size(t)
    want, taken = plain_targets(sizes), collections.Counter()
    noise = collections.Counter()
    got = mixing.plan(df).collect()
    by_key = collections.defaultdict(set)
    for r in rows:
        by_key[r[0], size(r[1])].add(r[2])
    assert len(got) == len(rows)
    emitted = collections.Counter(tuple(r) for r in mixing.emit(df).collect())
    for r in got:
        s = next(s for s in by_key[r.doc_id, r.size] if sizes[s] == r.source_size and abs(want[s] - r.target) < 1e-5)
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert r.taken in {r.size * int(rate), r.size * (int(rate) + 1)} and r.taken <= 3 * r.size
        taken[s] += r.taken
        noise[s] += r.size**2 * (rate % 1) * (1 - rate % 1)
    assert all(abs(taken[s] - want[s]) <= 5 * noise[s] ** 0.5 + 1 for s in want if len(want) > 1 and s != rows[3][2])
    assert sum(k * size(r[1]) for r, k in emitted.items()) == sum(taken.values())
    # Rows of a null id are drawn one by one.
    assert len({k / rows.count(r) for r, k in emitted.items() if r[0] is None}) > 1

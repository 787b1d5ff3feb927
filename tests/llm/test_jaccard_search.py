"""The T-occurrence search alone, and whole joins with every way of dealing out its work forced."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from voxelframe.llm import jaccard_join as jj


def test_divide_skip_counts_like_a_counter():
    rng = np.random.default_rng(8)
    for _ in range(300):
        lists = [sorted(rng.choice(60, rng.integers(1, 40), replace=False).tolist()) for _ in range(rng.integers(1, 14))]
        count = collections.Counter(x for one in lists for x in one)
        for theta in range(1, len(lists) + 2):
            assert sorted(jj.divide_skip(lists, theta)) == sorted((x, c) for x, c in count.items() if c >= theta)


def test_search_finds_every_pair_that_is_due():
    rng = np.random.default_rng(9)
    base = rng.choice(10_000, 120, replace=False)
    sets = []
    for i in range(60):
        keep = base[: rng.integers(90, 121)].copy()
        spots = rng.integers(0, len(keep), rng.integers(0, 30))
        keep[spots] = rng.integers(10_000, 10_100, len(spots))
        sets.append(sorted(set(keep.tolist())))
    often = collections.Counter(x for s in sets for x in s)
    short = [sorted(s, key=lambda x: (often[x], x))[: jj.short_lists(len(s))] for s in sets]
    comp = [i % 7 for i in range(60)]
    weight = collections.Counter(comp[i] for i in range(60) for _ in short[i])
    rows = [(k, i, len(sets[i]), comp[i], weight[comp[i]]) for i in range(60) for k in short[i]]
    lists = pa.table(dict(zip(("key", "doc", "n", "comp", "w"), map(list, zip(*rows)))))
    asked = pa.table({"doc": list(range(60)), "n": [len(s) for s in sets], "comp": comp, "w": [weight[c] for c in comp], "keys": short})
    a, b, total, met = jj._search(lists, asked, 80, None)
    found = set(zip(a, b))
    assert len(a) == total == len(found)
    due = {(i, j) for i in range(60) for j in range(60) if (weight[comp[i]], comp[i]) < (weight[comp[j]], comp[j]) and 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    assert due and due <= found and met == set(a) | set(b)
    some = jj._search(lists, asked, 80, 2)
    assert some[2] == total and set(zip(*some[:2])) <= found and max(collections.Counter(some[0]).values()) == 2


@pytest.fixture(scope="module")
def family(spark):
    """Near copies of a few texts at many distances, so that links chain and many candidates fail; one long text."""
    rng = np.random.default_rng(12)
    rows = [(9000, " ".join(f"w{k}" for k in rng.integers(0, 50_000, 60_000)))]
    for f in range(3):
        base = rng.integers(0, 500, 150)
        for i in range(40):
            t = base.copy()
            spots = rng.integers(0, 150, rng.integers(0, 9))
            t[spots] = rng.integers(500, 520, len(spots))
            rows.append((f * 1000 + i, " ".join(f"w{k}" for k in t)))
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert 6 < len(set(comp.values())) < 100
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), {(i, len(sets[i]), comp[i]) for i in sets}


@pytest.mark.parametrize("ways", [{}, {"run_rows": 2, "task_entries": 40, "bins": 3, "tries": (1, 2)}, {"tries": (), "bits": 6, "bins": 1}], ids=str)
def test_every_way_gives_one_result(family, ways):
    df, want = family
    assert {tuple(r) for r in jj.link(df, **ways).collect()} == want


def test_many_ids_join_instead_of_a_broadcast(family, monkeypatch):
    monkeypatch.setattr(jj, "IDS_BROADCAST", 1)
    df, want = family
    assert {tuple(r) for r in jj.link(df).collect()} == want

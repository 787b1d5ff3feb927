"""The whole query against a plain minimax partition of the ordered groups, and its laws."""

import collections
import hashlib
import zlib

import numpy as np
import pytest

from voxelframe.llm import sharding

SCHEMA = "doc_id long, text string, shard int, slot long, m string, lane int"


def plain_capacity(sizes, shards):
    best = {0: 0}
    sums = np.concatenate([[0], np.cumsum(sizes)])
    for _ in range(shards):
        best = {j: min(max(best[i], sums[j] - sums[i]) for i in best if i <= j) for j in range(len(sums))}
    return best[len(sizes)]


@pytest.mark.parametrize("digits", [4, 1])
def test_shards_are_as_small_as_they_can_be(spark, monkeypatch, digits):
    """With one hex digit sixteen atoms hold many texts each, and have to be split."""
    monkeypatch.setattr(sharding, "FIRST_DIGITS", digits)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    rng = np.random.default_rng(10)
    texts = [None, "", "é" * 50] + ["t" * int(n) + str(n) for n in rng.integers(0, 400, 150)] + ["copy " * 60] * 40
    rows = [(int(i) if i % 9 else None, t, 1, 2, "m", 3) for i, t in enumerate(texts)] + [(5, texts[5], 1, 2, "m", 3)] * 3
    for shards in (5, 24):
        got = sharding.assign(spark.createDataFrame(rows, SCHEMA).repartition(4), shards=shards).collect()
        size = lambda t: len((t or "").encode()) + 8
        want = collections.Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
        assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
        assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
        groups = collections.Counter()
        for r in rows:
            groups[hashlib.md5((r[1] or "").encode()).hexdigest()] += size(r[1])
        held, slots, where = collections.Counter(), collections.defaultdict(list), {}
        for r in got:
            held[r.shard] += r.size
            slots[r.shard].append(r.slot)
            assert where.setdefault((r.size, r.text_crc32), r.shard) == r.shard
        assert max(held.values()) == plain_capacity([groups[m] for m in sorted(groups)], shards) and set(held) <= set(range(shards))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_fewer_groups_than_shards(spark):
    got = sharding.assign(spark.createDataFrame([(i, "ab"[i % 2], 0, 0, "", 0) for i in range(7)], SCHEMA)).collect()
    assert len(got) == 7 and len({r.shard for r in got}) == 2
    assert sharding.assign(spark.createDataFrame([], SCHEMA)).count() == 0
    null = sharding.assign(spark.createDataFrame([(None, None, 0, 0, "", 0)], SCHEMA)).first()
    assert (null.size, null.text_crc32, null.slot) == (8, 0, 0)


def test_bounds_meet_at_the_group_level():
    rng = np.random.default_rng(11)
    for _ in range(60):
        sizes = rng.integers(1, 60, rng.integers(1, 40))
        shards = int(rng.integers(1, 7))
        whole = rng.random(len(sizes)) < 0.5
        low, high, split = sharding.between(sizes, whole, shards)
        assert low <= high == sharding.minimax_cuts(sizes, shards)[0] == plain_capacity(sizes, shards)
        assert low == high or split.any()
        assert sharding.between(sizes, np.ones(len(sizes), bool), shards)[:2] == (high, high)


def test_real_texts_are_near_even(spark):
    rng = np.random.default_rng(12)
    rows = [(i, "x" * int(n), 0, 0, "", 0) for i, n in enumerate(rng.integers(1, 4000, 3000))]
    held = collections.Counter()
    for r in sharding.assign(spark.createDataFrame(rows, SCHEMA)).collect():
        held[r.shard] += r.size
    assert len(held) == 24 and max(held.values()) <= 1.03 * sum(held.values()) / 24

"""Edge cases and size-dependent paths of the operators, each against a brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_pipeline import counts, good

from voxelframe.llm import common, components, line_dedup, mixing, quality_rules, recompression, substring_dedup, topk_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ substring dedup


def plain_substrings(rows, window=50):
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k : k + window])
                first[key] = min(i, first.get(key, i))
    out = collections.Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        keep = np.ones(len(w), bool)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = False
        out[i, len(w), int((~keep).sum()), hashlib.sha256(" ".join(np.array(w, object)[keep]).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("climbs", [recompression.CLIMBS, ((1,),), ((1, 2),), ((1,), (1, 2, 4))])
def test_substrings_of_texts_beyond_a_slice(spark, monkeypatch, climbs):
    monkeypatch.setattr(substring_dedup, "CLIMBS", climbs)
    rng = np.random.default_rng(31)
    long = [f"wörd{k}" for k in rng.integers(0, 3000, 130_000)]
    rows = [(1, " ".join(long)), (2, "\n".join(long[100:160]) + " tail"), (3, " ".join(long[5000:5049])), (4, "x " * 300), (5, "y x " * 40 + "x " * 200), (6, " ".join(long[:60] + long[59::-1])), (7, "\x1c".join("ab"))]
    rows += [(8, " ".join(["same"] * 49)), (9, " ".join(long[120_000:] + long[:5000])), (9, " ".join(long[120_000:] + long[:5000])), (9, "other"), (None, " ".join(long[:80]))]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, keys int, at int").repartition(3)
    assert len(rows[0][1]) > common.SLICE_BYTES
    got = substring_dedup.dedup(df, text_out=True).collect()
    assert collections.Counter(tuple(r)[:4] for r in got) == plain_substrings(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_slices_cut_between_rows_only():
    import pyarrow as pa

    column = pa.array(["a" * 700_000, None, "b" * 2_000_000, "", "c"])
    got = [(a, b, len(data), offsets.tolist()) for a, b, data, offsets in common.slices(column)]
    assert got == [(0, 2, 700_000, [0, 700_000, 700_000]), (2, 3, 2_000_000, [0, 2_000_000]), (3, 5, 1, [0, 0, 1])]


def test_equal_passages_have_equal_interior_symbols():
    rng = np.random.default_rng(32)
    for limits in ((1, 2), (1, 2, 4)):
        margin, passage = recompression.context(limits), rng.integers(1, 40, 90).astype(np.uint64)
        seen = []
        for _ in range(6):
            words = np.concatenate([rng.integers(1, 40, rng.integers(0, 30)).astype(np.uint64), passage, rng.integers(1, 40, rng.integers(0, 30)).astype(np.uint64)])
            at = next(i for i in range(len(words)) if np.array_equal(words[i : i + 90], passage))
            start = np.zeros(len(words), bool)
            start[0] = True
            names, starts, spans = recompression.symbols(common.mix(words), start, limits)
            assert spans.sum() == len(words) and (limits[-1] < 2 or spans.max() > 2)
            inside = (starts >= at + margin) & (starts + spans <= at + 90 - margin)
            seen.append([(int(n), int(s) - at, int(k)) for n, s, k in zip(names[inside], starts[inside], spans[inside])])
        assert all(s == seen[0] for s in seen) and seen[0]


# ------------------------------------------------------------------ top-k


def best(rows, k, scale=64):
    whole = [(i, [int(np.floor(scale * e)) for e in v]) for i, v in rows if i is not None and v is not None and all(e is not None and np.isfinite(e) for e in v)]
    out = {}
    for q, v in whole:
        if q % 20 == 0:
            out.setdefault(q, [])
    for q in out:
        mine = {tuple(v) for i, v in whole if i == q}
        out[q] = [(-s, i) for s, i in sorted((-sum(a * b for a, b in zip(m, v)), i) for m in mine for i, v in whole if i != q and len(v) == len(m))[:k]]
    return {q: r for q, r in out.items() if r}


def found(spark, rows, k=5, **ways):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, row int, h1 int").repartition(3)
    out = collections.defaultdict(list)
    for r in topk_search.search(df, F.col("vec_id") % 20 == 0, k, **ways).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("ways", [{}, {"data_chunk": 16, "query_block": 2}])
def test_crowds_repeats_and_wide_ranges(spark, monkeypatch, ways):
    monkeypatch.setattr(topk_search, "ROWS_BROADCAST", 3)
    rng = np.random.default_rng(33)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(80)]
    rows += [(100 + i, [0.5, 0.25, -0.5, 1.0, 2.0]) for i in range(60)]  # one vector that many hold
    rows += [rows[3]] * 9 + [rows[20]] * 4 + [(40, [9.0] * 5), (40, None), (101, [0.5, 0.25, -0.5, 1.0, 2.0])] * 2
    rows += [(200 + i, (rng.normal(size=5) * 10 ** rng.uniform(0, 9)).tolist()) for i in range(45)]
    rows += [(300, [1.0, 2.0]), (301, [1.0, 3.0]), (320, [7.0])]
    got = found(spark, rows, **ways)
    assert got == best(rows, 5)


def test_fewer_candidates_than_asked_for(spark):
    assert found(spark, [(0, [1.0]), (7, [2.0]), (8, [-1.0])], 20) == {0: [(64 * 128, 7), (-64 * 64, 8)]}
    assert found(spark, [(0, [1.0])]) == {} and found(spark, [(1, [1.0])]) == {} and found(spark, []) == {}


def test_bounds_hold_and_spare_reads():
    rng = np.random.default_rng(34)
    for scale in (3, 300, 1e6, 1e12):
        v, q = np.floor(rng.normal(size=(500, 24)) * scale), np.floor(rng.normal(size=(40, 24)) * scale)
        codes, low, width = topk_search.cells(v)
        scores, base, margin = topk_search.bounds(q, codes, low, width)
        exact = np.array([[sum(int(a) * int(b) for a, b in zip(x, y)) for y in v] for x in q], object)
        gap = np.array(scores.astype(float) + base[:, None] - exact.astype(float))
        assert (np.abs(gap) <= margin[:, None] * (1 + 1e-9)).all()
        blocks = [(np.arange(k, k + 250), np.arange(k, k + 250), *topk_search.cells(v[k : k + 250])) for k in (0, 250)]
        x, row, _, _ = topk_search.scan(blocks, np.arange(1000, 1040), q, 10)
        kept = collections.defaultdict(set)
        for a, b in zip(x, row):
            kept[a].add(b)
        for i in range(40):
            order = sorted(range(500), key=lambda j: -exact[i, j])[:10]
            assert set(order) <= kept[i] and (scale > 1e9 or len(kept[i]) < 40)  # beyond 64 bits clipped scores tie


# ------------------------------------------------------------------ quality rules


def test_quality_verdicts_of_odd_texts(spark):
    rng = np.random.default_rng(35)
    texts = [None, "", " \n ", "the " * 60, "the of and " + " ".join(f"w{k}" for k in range(60)), "a" * 50_000, "\n".join(["the same line of words"] * 30)]
    texts += [" ".join(rng.choice(["the", "of", "word", "other", "#", "!", "thing|", "\n", "more", "x1"], rng.integers(40, 200))) for _ in range(40)]
    texts.append(" ".join(f"the w{k}" for k in rng.integers(0, 20_000, 30_000)))
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words long, words string")
    for r in quality_rules.judge(df).collect():
        c = counts(texts[r.doc_id])
        assert [r[k] for k in quality_rules.COUNTS] == [c[k] for k in quality_rules.COUNTS]
        assert r.base_failed == (c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]) and r.kept == good(texts[r.doc_id])
    assert {r.doc_id for r in quality_rules.keep_good(df).collect()} == {i for i, t in enumerate(texts) if good(t)}
    assert quality_rules.judge(df.limit(0)).count() == 0


# ------------------------------------------------------------------ shared parts


def test_lane_join_and_components_under_skew(spark):
    many = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    one = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = common.lane_join(many, one, ["k"], ["id"], how="left")
    assert got.count() == 5000 and got.where("v is not null").count() == many.join(one, "k").count()
    hub = spark.createDataFrame([(7, i) for i in range(100, 1100)] + [(5, 7)], "a long, b long")
    assert {r.component for r in components.components(hub).collect()} == {5}


def test_cuts_are_deleted_and_need_a_shared_folder(spark):
    import os

    df = common.cut(spark.range(3), "probe")
    path = df._voxelframe_path.removeprefix("file://")
    assert df.count() == 3 and os.path.isdir(path)
    common.spent(df, spark.range(1))
    assert not os.path.exists(path)


def test_line_windows_on_empty_and_repeated_rows(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id long, text string, x int")).columns == ["doc_id", "text", "x"]
    assert mixing.plan(spark.createDataFrame([(1, "a", None), (2, "", None)], "doc_id long, text string, source string")).agg(F.sum("taken")).first()[0] == 1

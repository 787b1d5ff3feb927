import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules, sharding, site_bayes, substring_dedup, topk_search, url_filter
from voxelframe.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rate double, key string"


def words(rng, n, size=400):
    return " ".join(f"w{k}" for k in rng.integers(0, size, n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Null, empty, short and long texts, exact and near copies, repeated rows and ids, shared passages; columns whose names clash with inner ones."""
    rng = np.random.default_rng(7)
    rows, base, passage = [], words(rng, 300), words(rng, 70)
    texts = [None, "", " \n\t ", "one", "a b c d e", base, base, passage + " " + words(rng, 200), words(rng, 150) + " " + passage, "z " * 120, "q " * 130]
    for _ in range(25):
        w = base.split()
        for k in rng.integers(0, 300, rng.integers(1, 6)):
            w[k] = f"x{rng.integers(0, 9)}"
        texts.append(" ".join(w))
    texts += [words(rng, int(n)) for n in rng.integers(1, 900, 20)]
    texts.append("A b\nC d\nE f\nlast one\n\nA b\nC d\nE f")
    texts.append("x y\nA b\nC d\nE f\nend")
    for i, t in enumerate(texts):
        rows.append((i, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 4}", len(t or ""), 1.0, "k"))
    rows.append(rows[5])
    rows.append((None, base, "en", "s1", 1, 1.0, "k"))
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring_dedup(spark, corpus):
    rows, df = corpus
    first = {}
    for r in rows:
        w = WORD.findall(r[1] or "")
        for k in range(len(w) - 49):
            if r[0] is not None:
                t = tuple(w[k : k + 50])
                first[t] = min(r[0], first.get(t, r[0]))
    want = collections.Counter()
    for r in rows:
        w = WORD.findall(r[1] or "")
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if r[0] is not None and first[tuple(w[k : k + 50])] < r[0]:
                keep[k : k + 50] = [False] * 50
        kept = " ".join(a for a, b in zip(w, keep) if b)
        want[(r[0], len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = collections.Counter(tuple(r) for r in substring_dedup.dedup(df).collect())
    assert got == want and sum(w[2] for w in want) > 0
    assert substring_dedup.dedup(empty(spark)).count() == 0


def test_jaccard_join(spark, corpus):
    rows, df = corpus
    sets = {}
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = collections.Counter(tuple(r) for r in jaccard_join.link(df).collect())
    assert got == collections.Counter((r[0], len(sets[r[0]]), comp.get(r[0])) for r in rows)
    assert jaccard_join.link(empty(spark)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    par = {}

    def find(x):
        while par.setdefault(x, x) != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in par)


def test_bpe(spark, corpus):
    tokenizers = pytest.importorskip("tokenizers")
    from voxelframe.llm.queries import tokenizer_path

    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    rows, df = corpus
    extra = [(900, "ΑΣ Σ don't <|endoftext|>x<|start é漢🎉\x1c　" + "ab" * 5000, "", "", 1, 1.0, "")]
    got = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(df.union(spark.createDataFrame(extra, SCHEMA)), tokenizer_path()).collect()}
    for r in rows + extra:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        assert (r[0], hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()) in got
    b = bpe.Bpe(tokenizer_path())
    assert b.text_of(b.encode("the quick brown fox")) == "the quick brown fox"


def test_topk(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 6)).round(1)
    rows = [(i, list(map(float, x))) for i, x in enumerate(v)] + [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (None, [1.0] * 6), (303, [1.0]), (320, [1e18, -1e18, 0.0, 0.0, 0.0, 0.0])]
    got = collections.defaultdict(list)
    for r in topk_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 7, data_chunk=64, query_block=4).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(64 * e)) for e in x] for i, x in rows if i is not None and x and len(x) == 6 and all(e is not None and np.isfinite(e) for e in x)}
    for q in [i for i in whole if i % 20 == 0]:
        clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        best = sorted(((-clip(sum(a * b for a, b in zip(whole[q], whole[i]))), i) for i in whole if i != q))[:7]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://a.COM", "http://com/x", "https://Example.com/en/1?q", "http://www.example.com/en/", "http://x.www.example.com/en/2#t", "http://a.net/es/5", "http://a.net/esx/5", "net/es/", "http://b.org/p/1://c.com/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(df).collect()}
    assert got[0] == got[1] == got[2] == got[10] == ("", "", None, "allow")
    assert got[3] == ("a.com", "", None, "allow") and got[4] == ("com", "/x", "com/", "allow")
    assert got[5] == ("example.com", "/en/1", "example.com/en/", "block") and got[7][2:] == ("www.example.com/en/", "allow")
    assert got[8][2:] == ("net/es/", "block") and got[9][2] is None and got[11][:2] == ("b.org", "/p/1://c.com/")
    many = [(k, f"http://h.org/{'bad' if k % 2 else 'ok'}/{k}", k % 2 == 1 if k < 80 else None) for k in range(100)]
    judged = url_filter.judge(spark.createDataFrame(many, "page_id long, url string, b boolean"), bad=F.col("b")).collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 1) for r in judged)


def test_mixing(spark, corpus):
    rows, df = corpus
    got = mixing.plan(df).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    left, total, target, weight = set(order), sum(sizes.values()), {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        target.update({s: 3 * sizes[s] for s in over})
        left -= over
    target.update({s: weight[s] * level for s in left})
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r[0]].add((len(WORD.findall(r[1] or "")), r[3]))
    for r in got:
        s = next(s for n, s in by_id[r.doc_id] if n == r.size)
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(df.repartition(1)).collect()))
    assert mixing.emit(df).columns == df.columns and mixing.plan(empty(spark)).count() == 0


def test_quality_rules(spark, corpus):
    rows, df = corpus
    got = {tuple(r)[:6] for r in quality_rules.judge(df).collect()}
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        c = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        cover = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r[0], len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(cover)) in got
    assert quality_rules.keep_good(df).columns == df.columns and quality_rules.judge(empty(spark)).count() == 0


def test_sharding(spark, corpus):
    rows, df = corpus
    got = sharding.assign(df, shards=5).collect()
    slots, text = collections.defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert text.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    rng = np.random.default_rng(1)
    for _ in range(50):
        sizes = rng.integers(1, 50, rng.integers(1, 12))
        k = int(rng.integers(1, 5))
        low, cuts = sharding.minimax_cuts(sizes, k)
        best = {0: 0}
        sums = np.concatenate([[0], np.cumsum(sizes)])
        for _ in range(k):
            best = {j: min(max(best[i], sums[j] - sums[i]) for i in best if i <= j) for j in range(len(sums))}
        parts = np.split(sizes, cuts)
        assert low == best[len(sizes)] and max(p.sum() for p in parts) == low and len(parts) == k
    assert sharding.assign(empty(spark)).count() == 0


def test_line_dedup(spark, corpus):
    rows, df = corpus
    out = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    last = max(r[0] for r in rows if r[0] is not None)
    assert out[last - 1] == "A b\nC d\nE f\nlast one\n" and out[last] == "x y\nend" and out[0] is None
    run = spark.createDataFrame([(1, "\n".join(["a"] * 6))], "doc_id long, text string")
    assert line_dedup.dedup(run).first().text == "a\na\na"
    assert line_dedup.dedup(empty(spark)).count() == 0


def test_site_bayes_held_out(spark):
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        docs.append((i, words(rng, 80) + (" vile venom" if toxic else ""), "en", f"s{i % 3}", 0, 1.0, "k"))
        if i % 2:
            labels.append((i, 1, int(toxic)))
    df = spark.createDataFrame(docs + [(None, None, None, None, 0, 0.0, "")], SCHEMA)
    got = {r.doc_id: r.kept for r in site_bayes.classify(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in range(600) if i % 2 == 0]
    assert sum(got[i] == (i % 5 != 0) for i in held) / len(held) > 0.97
    none = site_bayes.classify(df, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.where("not kept").count() == 0


def test_line_dedup_keeps_clashing_names(spark):
    rows = [(1, "a b\nc\nd\nx", 5, 6, 7), (2, "a b\nc\nd", 8, 9, 10), (None, "a b\nc\nd", 1, 1, 1), (2, "a b\nc\nd", 8, 9, 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone int, pos int, first int")
    got = sorted((tuple(r) for r in line_dedup.dedup(df).collect()), key=str)
    assert got == sorted([rows[0], (2, "", 8, 9, 10), (2, "", 8, 9, 10), rows[2]], key=str)
    long = "\n".join(f"l{k % 5000}" for k in range(10_000))
    assert line_dedup.dedup(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().text == "\n".join(f"l{k}" for k in range(5000))

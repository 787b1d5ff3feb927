"""Site rates against plain sums, unlabelled paths of labelled hosts, held-out accuracy, edge cases."""

import collections
import os

import numpy as np
import pytest

from voxelframe.llm import site_bayes as sb

SCHEMA = "doc_id long, text string, source string, lang string, host string, path string, n long, p_bad double"
LABELS = "doc_id long, quality int, toxic int"
DATA = "/root/testdata/sf0.1"


def test_site_rates_equal_plain_ones(spark):
    rng = np.random.default_rng(2)
    rows, taste = [], {(h, p): rng.beta(1 + h, 4) for h in range(6) for p in range(4)}
    for _ in range(900):
        h, p = int(rng.integers(0, 6)) ** 2 // 6, int(rng.integers(0, 4))
        rows.append((None if h == 1 else f"h{h}", None if p == 3 else f"p{p}", int(rng.random() < taste[h, p])))
    rows.append(("single", "x", 1))
    hosts, paths, mu = sb.site_rates(spark.createDataFrame(rows, "host string, path string, bad int"))
    n, k = collections.Counter(), collections.Counter()
    for h, p, b in rows:
        for key in ((h,), (h, p)):
            n[key] += 1
            k[key] += b
    total, bad = len(rows), sum(r[2] for r in rows)
    assert mu == pytest.approx(bad / total)
    hs = [x for x in n if len(x) == 1]


    between = sum(n[g] * (k[g] / n[g] - mu) ** 2 for g in hs)
    spread = total - sum(n[g] ** 2 for g in hs) / total
    a_host = min(max(mu * (1 - mu) / max((between - (len(hs) - 1) * mu * (1 - mu)) / spread, 1e-6) - 1, 2), 1000)
    p_site = {g[0]: (k[g] + a_host * mu) / (n[g] + a_host) for g in hs}
    b = w = c = v = t = 0.0
    for g in hs:
        inner = [x for x in n if len(x) == 2 and x[0] == g[0]]
        if len(inner) > 1:
            r = k[g] / n[g]
            b += sum(n[x] * (k[x] / n[x] - r) ** 2 for x in inner)
            w += n[g] - sum(n[x] ** 2 for x in inner) / n[g]
            c += (len(inner) - 1) * r * (1 - r)
            v, t = v + n[g] * r * (1 - r), t + n[g]
    a_path = min(max(v / t / max((b - c) / w, 1e-6) - 1, 2), 1000)
    assert {r.host: pytest.approx(r.p_site) for r in hosts.collect()} == p_site
    assert {(r.host, r.path): pytest.approx(r.p_path) for r in paths.collect()} == {x: (k[x] + a_path * p_site[x[0]]) / (n[x] + a_path) for x in n if len(x) == 2}


def test_unlabelled_paths_follow_their_host(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 50, 60))
    docs = [(i, text(), ("bad", "good")[i % 2], "seen", "h", "p", 0, 0.0) for i in range(400)]
    docs += [(900, text(), "bad", "new", "h", "p", 0, 0.0), (901, text(), "good", "new", "h", "p", 0, 0.0), (902, text(), "other", "new", "h", "p", 0, 0.0), (903, None, None, None, "h", "p", 0, 0.0), (903, "", None, None, "h", "p", 0, 0.0)]
    labels = [(i, 1, (i + 1) % 2) for i in range(400)] + [(i, 0, 0) for i in range(0, 40, 2)] + [(None, 1, 1), (5000, None, None)]
    got = collections.defaultdict(list)
    for r in sb.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, LABELS)).collect():
        got[r.doc_id].append(r)
    assert got[900][0].p_path == got[900][0].p_site > 0.9 and not got[900][0].kept
    assert got[901][0].p_path == got[901][0].p_site < 0.1 and got[901][0].kept
    assert got[902][0].p_site == pytest.approx(0.5) and len(got[903]) == 2
    nothing = sb.classify(spark.createDataFrame([], SCHEMA), spark.createDataFrame(labels, LABELS))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "p_doc", "p_site", "p_path", "p_bad", "kept"]
    one_class = sb.classify(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, 1, 0)], LABELS))
    assert one_class.where("not kept").count() == 0


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the driver's tables")
def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where("xxhash64(doc_id) % 2 = 0")
    judged = sb.classify(docs, fitted).join(labels.where("xxhash64(doc_id) % 2 <> 0"), "doc_id").toPandas()
    bad = (judged.toxic == 1) | (judged.quality == 0)
    recall, lost = (~judged.kept[bad]).mean(), (~judged.kept[~bad]).mean()
    print(f"held out: {len(judged)} documents, {int(bad.sum())} bad, recall {recall:.3f}, good ones lost {lost:.4f}, accuracy {(judged.kept != bad).mean():.3f}")
    assert recall >= 0.9 and lost <= 0.01

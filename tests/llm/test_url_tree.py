"""The template tree against a plain one, grown host by host with recursion."""

import collections
import math
import re

import numpy as np
from pyspark.sql import functions as F

from voxelframe.llm import url_filter as u

SCHEMA = "page_id long, url string, bad boolean, host string, seg string, branch string, p string, child string"


def differ(a, b):
    pool = (a[1] + b[1]) / (a[0] + b[0])
    return abs(a[1] / a[0] - b[1] / b[0]) > u.Z * math.sqrt(pool * (1 - pool) * (1 / a[0] + 1 / b[0]))


def plain(pages, depth, most):
    """{page_id: verdict} of pages (id, url, bad) that no rule fits."""
    split = {}
    for i, url, bad in pages:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        seg = ["*" if re.search("[0-9]", s) or len(s) > u.LONG_SEGMENT else s for s in path.split("/") if s]
        split[i] = (host, tuple(seg[:depth]) + (("**",) if len(seg) > depth else ()), bad)
    known = [b for _, _, b in split.values() if b is not None]
    overall = sum(known) / len(known) if known else 0.0
    out = {}

    def grow(rows, k, p):
        deep = [i for i in rows if len(split[i][1]) > k]
        for i in rows:
            if len(split[i][1]) <= k:
                out[i] = p
        names = {i: split[i][1][k] for i in deep}
        if len({n for n in names.values()} - {"*", "**"}) > most:
            names = {i: n if n == "**" else "*" for i, n in names.items()}
        told = {}
        for i, n in names.items():
            if split[i][2] is not None:
                a, b = told.get(n, (0, 0))
                told[n] = (a + 1, b + split[i][2])
        branches = []
        for n in sorted(told, key=lambda n: (told[n][1] / told[n][0], n)):
            if branches and not differ(branches[-1][1], told[n]):
                branches[-1] = (branches[-1][0] | {n}, tuple(map(sum, zip(branches[-1][1], told[n]))))
            else:
                branches.append(({n}, told[n]))
        for group, (a, b) in branches:
            grow([i for i in deep if names[i] in group], k + 1, (b + u.STRENGTH * p) / (a + u.STRENGTH))
        for n in set(names.values()) - set(told):
            grow([i for i in deep if names[i] == n], k + 1, p)

    for host in {h for h, _, _ in split.values()}:
        rows = [i for i in split if split[i][0] == host]
        told = [split[i][2] for i in rows if split[i][2] is not None]
        grow(rows, 0, (sum(told) + u.STRENGTH * overall) / (len(told) + u.STRENGTH))
        if not told:
            out.update({i: 0.0 for i in rows})
    return {i: "block" if round(p, 9) >= u.REJECT else "allow" for i, p in out.items()}


def judged(spark, pages, **more):
    rows = [(i, url, bad, "h", "s", "b", "p", "c") for i, url, bad in pages]  # columns whose names clash with inner ones
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return u.judge(df, rules=(), bad=F.col("bad"), **more).collect()


def test_tree_equals_plain_one(spark):
    rng = np.random.default_rng(4)
    pages = [(0, None, True), (1, "", None), (2, "x", False), (3, "s://", None), (4, "http://a.org", None)]
    taste = collections.defaultdict(lambda: rng.choice([0.02, 0.5, 0.97, 1.0]))
    for i in range(5, 2500):
        host = f"h{rng.integers(0, 4)}.org"
        names = [f"{'abcdefg'[rng.integers(0, 7)]}" for _ in range(rng.integers(0, 6))]
        if rng.random() < 0.2:
            names.append("crowd" + "abcdefghijklmnopqrstuvwxyz"[rng.integers(0, 26)])
        if rng.random() < 0.3:
            names.append(str(rng.integers(0, 99)))
        bad = bool(rng.random() < taste[host, *names[:1]]) if rng.random() < 0.5 else None
        pages.append((i, f"http://{host.upper()}/{'/'.join(names)}{'?q' * int(rng.integers(0, 2))}", bad))
    for depth, most in ((4, 24), (2, 3), (1, 5)):
        want = plain(pages, depth, most)
        got = {r.page_id: r.verdict for r in judged(spark, pages, depth=depth, most=most)}
        assert got == want and {"block", "allow"} == set(got.values())


def test_evidence_reaches_siblings(spark):
    names = [f"n{c}" for c in "abcdefghijklmnopqrst"]
    pages = [(i, f"http://h.org/a/{names[i % 20]}/p", True) for i in range(200)]
    pages += [(200 + i, f"http://h.org/b/{names[i % 20]}/p", False) for i in range(200)]
    pages += [(400 + i, f"http://h.org/a/new{c}/p", None) for i, c in enumerate("xyz")] + [(410, "http://h.org/b/newx/p", None), (411, "http://other.org/a/na/p", None)]
    got = {r.page_id: r.verdict for r in judged(spark, pages)}
    assert all(got[i] == ("block" if i < 200 or 400 <= i < 403 else "allow") for i in got) and len(got) == 405


def test_repeats_ties_and_nothing(spark):
    rules = (u.Rule("allow", "a.org/x"), u.Rule("block", "a.org/x"))
    df = spark.createDataFrame([(1, "http://a.org/x" + "y" * 100_000), (1, "http://a.org/x"), (1, "http://a.org/x")], "page_id long, url string")
    assert [r.verdict for r in u.judge(df, rules).collect()] == ["block"] * 3
    assert u.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in u.judge(df, ()).collect()} == {"allow"}

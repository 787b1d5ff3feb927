import duckdb
import numpy as np
import pandas as pd
import pytest

from voxelframe.llm.queries import QUERIES, SQL


def texts():
    """Null, empty and short texts, copies, near copies, shared passages, repeated lines, symbols."""
    rng = np.random.default_rng(11)
    words = lambda n: " ".join(f"the w{k}" for k in rng.integers(0, 300, n))
    base, passage = words(60), words(40)
    out = [None, "", " \n\t ", "one", "a b c d e", base, base, passage + " " + words(50), words(50) + "\n" + passage, "z " * 120, "# * $ x " * 20, "Wow! " * 60]
    out += [base.replace(f"w{k}", "Q", 1) for k in range(8)]
    out += ["A b\nC d\nE f\nlast\n\nA b\nC d\nE f", "x y\nA b\nC d\nE f\nend", "x y\nx y\nx y\nx y\nx y"]
    return out + [words(int(n)) for n in rng.integers(1, 90, 12)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(5)
    rows = [(i, t, [None, "a", "b", "c", "d"][i % 5], len(t or "")) for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    vectors = [(i, [float(x) for x in rng.integers(-3, 3, 4) / 2]) for i in range(60)]
    vectors += [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [1.0, float("nan"), 0.0, 0.0]), (63, [float("inf"), 0.0, 0.0, 0.0])]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    urls = [None, "", "x", "http://a.example.net", "http://b.org/é/1/2/3/4/5"] + [f"http{'s' * (i % 2)}://{'AbC'[i % 3]}.{('example.com', 'example.net', 'www.example.com', 'h.net')[i % 4]}/{('en', 'es', 'fr', 'de')[i // 4 % 4]}/{i % 9 if i % 5 else 'k' + chr(97 + i % 26)}{('', '/', '?q', '#t')[i % 4]}" for i in range(400)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{d}/pages.parquet")
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    d, con = tables
    got, want = QUERIES[name](spark, d).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    by = [c for c in ("doc_id", "query_id", "rank", "page_id") if c in got.columns]
    got = got.sort_values(by, ignore_index=True)[sorted(got.columns)]
    want = want.sort_values(by, ignore_index=True)[sorted(got.columns)]
    pd.testing.assert_frame_equal(got, want, check_dtype=False)

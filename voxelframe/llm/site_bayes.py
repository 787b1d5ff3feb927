"""Quality classifier: document evidence combined with hierarchical empirical Bayes over sites.

Document evidence: two ridge logistic models (toxic; of low quality) over which
words a text holds, hashed, and over a few shape ratios. They are trained here on a bounded,
deterministic sample of labelled documents (``SAMPLE`` ids of least hashes; the one
bounded step). Words enter a model when their presence differs between the classes by
``WORD_Z`` standard errors; they are counted by Spark, and the driver gets at most
``MOST_WORDS`` marks and the shapes of each sampled document.

Site evidence: over all labelled documents, bad ones are counted by host and by
path below it (here: source and language) in one grouped aggregation. A host's
rate is a beta posterior around the global rate, whose strength is estimated
from how much hosts differ beyond chance; a path's rate is a posterior around its
host's, with a strength from how much paths differ within their hosts. Sparse sites
thus shrink to their host, and hosts to the whole; a path without labels has its host's
rate, a host without labels the global one.

A document's odds of being bad are its classifier's odds times its path's odds over
the global odds; it is kept while the probability, rounded to 9 digits, is at most
``KEEP``, which is below one half because a bad text that stays costs more than a good one that goes.

Edge cases: a null or empty text has no words and gets the intercept's evidence;
null hosts and paths form their own groups; documents that repeat an id share
its label, and the text of least hash stands for them in the sample; labels that repeat
an id count once (the worst); without labelled documents of both classes the classifier
says nothing (its probability is the global rate, 0 without labels); a probability
of exactly ``KEEP`` keeps; a very long text costs its words once, in its own slice;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, slices, spent, words_of

SAMPLE = 20_000
BITS = 18
WORD_Z = 4.0
MOST_WORDS = 256
RIDGE = 0.3
KEEP = 0.3
GROUPS_BROADCAST = 50_000

SHAPES = ("log_words", "distinct", "again", "mean_len", "symbols", "loud", "pipes", "upper", "digits", "lines")


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, bounds, shapes): each row's distinct word buckets, and its SHAPES."""
    hashes, starts, ends, bounds = words_of(data, offsets, fold=True)
    rows = len(offsets) - 1
    counts = np.diff(bounds)
    row = np.repeat(np.arange(rows), counts)
    bucket = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(row * (1 << BITS) + bucket)
    row_of, bucket = key >> BITS, key & ((1 << BITS) - 1)
    at = np.searchsorted(row_of, np.arange(rows + 1))
    some = np.maximum(counts, 1)

    def per_row(mask):
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    size = np.maximum(np.diff(offsets), 1)
    same = np.zeros(len(hashes) + 1, np.int64)
    if len(hashes) > 1:
        same[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]))
    chars = np.concatenate([[0], np.cumsum(ends - starts)])
    symbol = np.isin(data, np.frombuffer(b"#*$%&<>", np.uint8))
    shapes = np.stack(
        [
            np.log1p(counts),
            np.diff(at) / some,
            (same[bounds[1:]] - same[bounds[:-1]]) / some,
            np.log1p((chars[bounds[1:]] - chars[bounds[:-1]]) / some),
            np.minimum(per_row(symbol) / some, 1),
            np.minimum(per_row(data == 33) / some, 1),
            np.minimum(per_row(data == 124) / some, 1),
            per_row((data >= 65) & (data <= 90)) / size,
            per_row((data >= 48) & (data <= 57)) / size,
            np.minimum(per_row(data == 10) / some, 1),
        ],
        axis=1,
    )
    return bucket, at, shapes


def _expand(shapes: np.ndarray) -> np.ndarray:
    """Ratios as they are, and as steps, so that a linear model can bend."""
    steps = [shapes[:, [k]] > c for k, cs in ((1, (0.2, 0.4)), (2, (0.05, 0.2)), (4, (0.05, 0.2)), (5, (0.1, 0.3)), (6, (0.05, 0.2)), (7, (0.2, 0.5)), (0, (2.0, 3.0, 4.0))) for c in cs]
    return np.concatenate([shapes, *steps], axis=1).astype(np.float64)


@dataclass
class Model:
    """Weights of one logistic model: word buckets and their weights, shape scaling, weights and intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    shape_weights: np.ndarray
    intercept: float

    def logit(self, bucket, at, shapes):
        x = (_expand(shapes) - self.mean) / self.scale
        out = x @ self.shape_weights + self.intercept
        if len(self.buckets):
            table = np.zeros(1 << BITS)
            table[self.buckets] = self.weights
            total = np.concatenate([[0.0], np.cumsum(table[bucket])])
            out = out + total[at[1:]] - total[at[:-1]]
        return np.clip(out, -30, 30)


def fit(y: np.ndarray, chosen: np.ndarray, bucket: np.ndarray, at: np.ndarray, shapes: np.ndarray) -> Model | None:
    """Ridge logistic regression by Newton steps over the ``chosen`` words (ascending) and the shapes; None unless both classes occur."""
    n = len(y)
    if not 0 < int(y.sum()) < n:
        return None
    row = np.repeat(np.arange(n), np.diff(at))
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    words = np.zeros((n, len(chosen)), np.float64)
    hit = place[bucket] >= 0
    words[row[hit], place[bucket[hit]]] = 1
    shape = _expand(shapes)
    mean, scale = shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-6)
    x = np.concatenate([words, (shape - mean) / scale, np.ones((n, 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), RIDGE)
    penalty[-1] = 1e-6
    for _ in range(25):
        prob = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (prob - y) + penalty * w
        h = (x.T * np.maximum(prob * (1 - prob), 1e-6)) @ x
        h[np.diag_indices_from(h)] += penalty
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    k = len(chosen)
    return Model(chosen, w[:k], mean, scale, w[k:-1], float(w[-1]))


def _labels(labels: DataFrame, id_col: str) -> DataFrame:
    bad = F.greatest(F.coalesce(F.col("toxic"), F.lit(0)), 1 - F.coalesce(F.col("quality"), F.lit(1))).cast("int")
    marked = labels.where(F.col(id_col).isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
    return marked.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).alias("quality"), F.max(bad).alias("bad"))


def _telling(words: DataFrame, y: str, n: int, pos: int) -> np.ndarray:
    """The word buckets whose presence tells the classes of ``y`` apart best, ``MOST_WORDS`` at most, ascending. words: (bucket, k, toxic, low), counts of documents."""
    if not 0 < pos < n:
        return np.zeros(0, np.int64)
    p = F.col("k") / n
    gap = F.col(y) / pos - (F.col("k") - F.col(y)) / (n - pos)
    z = F.abs(gap) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / pos + 1 / (n - pos)))
    best = words.select("bucket", z.alias("z")).where(F.col("z") > WORD_Z).orderBy(F.desc("z"), "bucket").limit(MOST_WORDS)
    return np.array(sorted(r["bucket"] for r in best.collect()), np.int64)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, Model | None]:
    """Fit both models on the ``sample`` labelled ids of the least hashes. docs: (doc_id, text); labels: (doc_id, toxic, quality)."""
    picked = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = cut(picked, "sample")

    def run(batches):
        for batch in batches:
            toxic, quality = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            for a, b, data, offsets in slices(batch.column(2)):
                bucket, at, shapes = features(data, offsets)
                arrays = [
                    batch.column(0).slice(a, b - a),
                    batch.column(1).slice(a, b - a),
                    pa.array(toxic[a:b].astype(np.int32)),
                    pa.array((1 - quality[a:b]).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32))),
                    pa.FixedSizeListArray.from_arrays(pa.array(shapes.ravel()), shapes.shape[1]).cast(pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "h", "toxic", "low", "buckets", "shapes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", F.xxhash64("text").alias("h"), "text", "toxic", "quality")  # ``sample`` rows at most
    rows = rows.mapInArrow(run, f"doc_id {kind}, h bigint, toxic int, low int, buckets array<int>, shapes array<double>")
    # One text for an id that repeats.
    rows = cut(rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("h"))).where("k = 1").drop("k"), "sample")
    spent(picked)
    n, toxic, low = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("low"), F.lit(0))).first()
    words = rows.select("toxic", "low", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("k"), F.sum("toxic").alias("toxic"), F.sum("low").alias("low"))
    words = cut(words.where("k >= 3"), "words")  # 2**BITS rows at most
    chosen = {"toxic": _telling(words, "toxic", n, toxic), "low": _telling(words, "low", n, low)}
    spent(words)
    marks = F.array(*(F.lit(int(x)) for x in sorted({*chosen["toxic"].tolist(), *chosen["low"].tolist()}))).cast("array<int>")
    table = rows.select("toxic", "low", F.array_intersect("buckets", marks).alias("words"), "shapes", "doc_id").orderBy("doc_id").drop("doc_id").toArrow()
    spent(rows)
    if not table.num_rows:
        return {"toxic": None, "low": None}
    lists = table.column("words").combine_chunks()
    at = np.asarray(lists.offsets).astype(np.int64)
    bucket = lists.flatten().to_numpy().astype(np.int64)
    shapes = table.column("shapes").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
    return {k: fit(table.column(k).to_numpy().astype(np.float64), chosen[k], bucket, at - at[0], shapes) for k in ("toxic", "low")}


def score(docs: DataFrame, models: dict[str, Model | None], mu: float) -> DataFrame:
    """From (doc_id, host, path, text): (doc_id, host, path, p_doc), the classifier's probability of being toxic or of low quality; ``mu`` without models."""
    used = docs.sparkSession.sparkContext.broadcast(models)  # two models of bounded size
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(3)):
                bucket, at, shapes = features(data, offsets)
                fine = np.ones(b - a)
                for m in used.value.values():
                    if m is not None:
                        fine *= 1 - 1 / (1 + np.exp(-m.logit(bucket, at, shapes)))
                if not any(m is not None for m in used.value.values()):
                    fine[:] = 1 - mu
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(3)), pa.array(1 - fine)], names=["doc_id", "host", "path", "p_doc"])

    return docs.select("doc_id", "host", "path", "text").mapInArrow(run, f"doc_id {id_kind}, host string, path string, p_doc double")


def strength(between: float, total: float, spread: float, chance: float, rate: float) -> float:
    """Prior observations of a beta prior: ``between`` is the counts' weighted sum of squares around their mean, of which
    ``chance`` is due to binomial noise and the rest to ``spread`` weights of true variance."""
    if spread <= 0 or total <= 0:
        return 50.0
    variance = max((between - chance) / spread, 1e-6)
    return float(min(max(rate / variance - 1, 2.0), 1000.0))


def site_rates(labelled: DataFrame) -> tuple[DataFrame, DataFrame, float]:
    """From (host, path, bad): (host, p_site) of labelled hosts, (host, path, p_path) of labelled paths, and the global rate."""
    paths = cut(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("bad").alias("k")), "paths")
    by_host = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"), F.count("*").alias("m"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    by_host = cut(by_host, "hosts")
    rate = F.col("hk") / F.col("hn")
    total = by_host.agg(F.sum("hn"), F.sum("hk"), F.count("*"), F.sum(F.col("hk") * F.col("hk") / F.col("hn")), F.sum(F.col("hn").cast("double") * F.col("hn"))).first()
    mu = min(max(total[1] / total[0], 1e-4), 1 - 1e-4) if total[0] else 0.0
    n, k, hosts, kk, nn = (float(x or 0) for x in total)
    # Sums of squares around a mean: sum of k * k / n less the mean's own.
    a_host = strength(kk - k * k / n, n, n - nn / n, (hosts - 1) * mu * (1 - mu), mu * (1 - mu)) if n else 50.0
    # Paths around their hosts: pooled over the hosts that have several.
    inner = by_host.where("m > 1").agg(F.sum(F.col("kk") - F.col("hk") * rate), F.sum("hn"), F.sum(F.col("hn") - F.col("nn") / F.col("hn")), F.sum((F.col("m") - 1) * rate * (1 - rate)), F.sum(F.col("hn") * rate * (1 - rate))).first()
    b, t, w, c, v = (float(x or 0) for x in inner)
    a_path = strength(b, t, w, c, v / t if t else 0.0)
    hosts = by_host.select("host", ((F.col("hk") + a_host * mu) / (F.col("hn") + a_host)).alias("p_site"))
    joined = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return hosts, joined.select("host", "path", ((F.col("k") + a_path * F.col("p_site")) / (F.col("n") + a_path)).alias("p_path")), mu


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= GROUPS_BROADCAST else df


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, p_doc, p_site, p_path, p_bad, kept."""
    src = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{path}`").cast("string").alias("path"), F.col(f"`{text}`").alias("text"))
    marks = _labels(labels, id_col)
    models = train(src.select("doc_id", "text"), marks, sample)
    hosts, paths, mu = site_rates(src.select("doc_id", "host", "path").join(marks.select("doc_id", "bad"), "doc_id").select("host", "path", "bad"))
    hosts = cut(hosts.select(F.col("host").alias("h"), "p_site"), "rates")
    paths = cut(paths.select(F.col("host").alias("g"), F.col("path").alias("q"), "p_path"), "rates")
    got = score(src, models, mu).join(_small(hosts), F.col("host").eqNullSafe(F.col("h")), "left")
    got = got.join(_small(paths), F.col("host").eqNullSafe(F.col("g")) & F.col("path").eqNullSafe(F.col("q")), "left")
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
    odds = lambda c: F.log(clip(c) / (1 - clip(c)))
    p_site = F.coalesce("p_site", F.lit(mu))
    p_path = F.coalesce(F.col("p_path"), p_site)
    bad = 1 / (1 + F.exp(-(odds(F.col("p_doc")) + odds(p_path) - odds(F.lit(mu)))))
    return got.select("doc_id", "p_doc", p_site.alias("p_site"), p_path.alias("p_path"), bad.alias("p_bad"), (F.round(bad, 9) <= keep).alias("kept"))

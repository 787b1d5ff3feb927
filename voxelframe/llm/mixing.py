"""Mixing sources to target weights.

Sizes are summed per source; weights repeat over the sources in code-point
order (null last) and share all words; a target stops at a limit of times its
source's size, and the excess is reshared by weight until none is above: a level
that rises turn by turn, each turn one sum over the sources. The repetition rate is
target / size; each document is taken floor(rate) times plus one Bernoulli copy drawn
from a seeded hash of its id, so reruns, retries and other partitionings agree.

Each source's taken words come near its target: the draws of its documents add a
standard deviation of sqrt(sum of size squared * f (1 - f)), f the rate's fraction, which
is small once no few documents hold most of a source's words.

Shuffles: the aggregation by source (map-side combine), and a range sort of the
sources that numbers them, a partition at a time; sources may be millions of hosts. Rates
come back to the rows by a broadcast when the sources are few (checked), else by a
shuffled join.

Edge cases: a null or empty text has size 0 and is never taken more than its
rate says (its taken words are 0); a source of no words has target 0; a null
source is one source, after all others; repeated rows draw the same number; rows of a
null id draw by their text; a very long text is one size; extra columns are kept by
:func:`emit`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_PATTERN, cut

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = 17
BROADCAST_ROWS = 10_000


def size_of(text: Column) -> Column:
    """Words of a text: the pieces between separators that are not empty."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN, -1)
    n = F.size(parts)
    edge = (F.element_at(parts, 1) == "").cast("int") + F.when(n > 1, (F.element_at(parts, -1) == "").cast("int")).otherwise(0)
    return (n - edge).cast("long")


def draw(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from a string: the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key)), 1, 13), 16, 10).cast("long")
    return bits / F.lit(float(1 << 52))


def _numbered(s: DataFrame) -> DataFrame:
    """Sources with ``i``, their place from 0 in code-point order, null last: sorted by ranges, numbered in each, and moved by the ranges before."""
    key = [F.col("source").isNull(), F.col("source")]
    ranges = cut(s.repartitionByRange(*key).withColumn("part", F.spark_partition_id()), "sources")
    before, starts = 0, []
    for r in sorted(ranges.groupBy("part").count().collect(), key=lambda r: r["part"]):  # a row a partition
        starts.append((r["part"], before))
        before += r["count"]
    starts = s.sparkSession.createDataFrame(starts, "part int, start long")
    own = F.row_number().over(Window.partitionBy("part").orderBy(*key))
    return ranges.withColumn("k", own).join(F.broadcast(starts), "part").withColumn("i", F.col("start") + F.col("k") - 1).drop("part", "k", "start")


def targets(sized: DataFrame, weights=WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """From rows (source, size): one row per source with source_size, target and rate."""
    s = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod("i", F.lit(len(weights))) + 1).cast("int"))
    s = cut(_numbered(s).select("source", "source_size", w.alias("w"), (F.col("source_size") * float(limit)).alias("cap")), "mix")
    total, share, stopped = *s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first(), -1
    level = total / share if share else 0.0
    while share:
        over = s.where(F.col("w") * level > F.col("cap")).agg(F.count("*"), F.sum("cap"), F.sum("w")).first()
        if over[0] == stopped or over[2] == share:
            break
        stopped, level = over[0], (total - (over[1] or 0.0)) / (share - (over[2] or 0.0))
    s = s.withColumn("target", F.round(F.least(F.col("cap"), F.col("w") * level), 6))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(limit)))).otherwise(0.0)
    return s.select("source", "source_size", "target", rate.alias("rate"))


def _with_rates(rows: DataFrame, source: str, rates: DataFrame, text_size: Column) -> DataFrame:
    side = F.broadcast(rates) if rates.count() <= BROADCAST_ROWS else rates
    side = side.select(*(F.col(c).alias(f"__mix_{c}") for c in rates.columns))
    return rows.withColumn("__mix_size", text_size).join(side, F.col(f"`{source}`").eqNullSafe(F.col("__mix_source")), "left")


def copies(id_col: Column, text: Column, seed: int = SEED) -> Column:
    rate = F.col("__mix_rate")
    whole = F.floor(rate)
    key = F.coalesce(id_col.cast("string"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))
    return (whole + (draw(key, seed) < rate - whole).cast("int")).cast("long")


def plan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    size = size_of(F.col(f"`{text}`"))
    rates = targets(docs.select(F.col(f"`{source}`").alias("source"), size.alias("size")), weights, limit)
    got = _with_rates(docs, source, rates, size)
    return got.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_size") * copies(F.col(f"`{id_col}`"), F.col(f"`{text}`"), seed)).alias("taken"))


def emit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, limit: int = LIMIT, seed: int = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as many times as it is taken."""
    size = size_of(F.col(f"`{text}`"))
    names = docs.columns
    rates = targets(docs.select(F.col(f"`{source}`").alias("source"), size.alias("size")), weights, limit)
    got = _with_rates(docs, source, rates, size).withColumn("__mix_n", copies(F.col(f"`{id_col}`"), F.col(f"`{text}`"), seed)).where("__mix_n > 0")
    return got.select(*(F.col(f"`{c}`") for c in names), F.explode(F.sequence(F.lit(1), F.col("__mix_n").cast("int"))).alias("__mix_k")).drop("__mix_k")

"""Connected components by alternating star contraction, all in DataFrames.

Large-star and small-star steps turn the link table into stars around each
component's least node in a number of rounds that grows with the logarithm of
the longest chain. Every step is an aggregation with map-side combine and a join
against its one-row-a-node result, so a node that a third of all links touch is
split like any other skewed key. Each round's table is written to the shared
folder, so a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lane_join, spent


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u. Point neighbours at the least node of each neighbourhood."""
    both = edges.union(edges.select(F.col("v"), F.col("u"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    got = lane_join(both, least, ["u"], ["v"], 2)
    if large:
        out = got.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = got.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """From links (a, b) of long ids: (node, component) for every node with a link; component is the least id reachable."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")

    def state(df):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        old, now = now, cut(_star(_star(now, True), False), "links")
        spent(old)
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def grow(comp: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the links between known components are contracted, then names are mapped. Both tables are deleted if they are cuts."""
    of = lambda side, out: comp.select(F.col("node").alias(side), F.col("component").alias(out))
    lifted = links.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b")
    more = components(lifted.distinct())
    renamed = comp.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    fresh = more.join(comp.select("node"), "node", "left_anti").select("node", "component")
    out = cut(renamed.union(fresh), "components")
    spent(comp, links)
    return out

"""URL filters by rules and path-template trees.

A url's longest fitting rule decides. Urls that no rule fits are judged by their
host's tree of path templates, which is grown from the root, a level a turn:

* Generalise: segments that hold a digit or are long are wildcards, and so are all
  children of a parent that has too many different ones; below ``depth`` segments
  the rest of a path is one wildcard.
* Merge: labelled children of a parent, in order of their share of bad pages, join
  the branch before them unless a two-sample test tells the two apart; a merged
  branch has one subtree.
* Purity: a branch's share of bad pages among its labelled ones is smoothed toward
  its parent's, a host's toward the whole table's. A child without labels has its
  parent's purity, so evidence reaches templates that were never labelled.

Templates whose smoothed purity reaches a threshold are rejected; a host without
labelled pages never is.

Pages are counted by (host, segments) once, with map-side combine; the levels work on
those counts, and a page meets its template in one join at the end. A parent has
``MOST_SIBLINGS`` + 2 children at most once it is generalised, so no group is
larger. Joins on a host are dealt by lanes. Labels default to the rules' own
verdicts.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is judged by the tree of the empty host; an empty path starts with
no rule's path; of fitting rules of one length the one given last decides; a very
long url is split as a whole, its tail falls to the last wildcard; repeated rows get
equal results; extra columns are ignored; without any label nothing is rejected; an
empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lane_join, spent

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEPTH = 4
LONG_SEGMENT = 32
MOST_SIBLINGS = 24
STRENGTH = 8.0
REJECT = 0.75
Z = 1.96


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"), Rule("block", "net/es/"), Rule("block", "net/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), F.regexp_extract(url, parts, 2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits, else nulls."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.pattern)):  # the last to be wrapped is asked first
        hit = r.fits(host, path)
        pattern, verdict = F.when(hit, F.lit(r.pattern)).otherwise(pattern), F.when(hit, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


def _segments(path: Column, depth: int = DEPTH) -> Column:
    """The path's first segments, the variable ones as ``*``; what lies deeper as ``**``."""
    parts = F.filter(F.split(path, "/", -1), lambda s: s != "")
    plain = F.transform(F.slice(parts, 1, depth), lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > LONG_SEGMENT), F.lit("*")).otherwise(s))
    return F.when(F.size(parts) > depth, F.concat(plain, F.array(F.lit("**")))).otherwise(plain)


def _differ(n1: Column, b1: Column, n2: Column, b2: Column) -> Column:
    """Two shares b/n differ by more than Z standard errors of their pooled share."""
    pool = (b1 + b2) / (n1 + n2)
    return F.abs(b1 / n1 - b2 / n2) > Z * F.sqrt(pool * (1 - pool) * (1 / n1 + 1 / n2))


def _branches(kids: Column) -> Column:
    """Merge sorted children (share, child, n, b) into branches (names, n, b): each joins the last branch unless the two differ."""
    kind = "array<struct<names:array<string>,n:double,b:double>>"

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        own = F.struct(F.array(x["child"]).alias("names"), x["n"].alias("n"), x["b"].alias("b"))
        both = F.struct(F.concat(last["names"], F.array(x["child"])).alias("names"), (last["n"] + x["n"]).alias("n"), (last["b"] + x["b"]).alias("b"))
        fresh = (F.size(acc) == 0) | _differ(last["n"], last["b"], x["n"], x["b"])
        return F.when(fresh, F.concat(acc, F.array(own))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(both)))

    return F.aggregate(kids, F.array().cast(kind), add)


def _level(leaves: DataFrame, k: int, strength: float, most: int) -> DataFrame:
    """Leaves (host, seg, labelled, bad, branch, p) moved from level ``k`` of their host's tree to the next."""
    names = leaves.columns
    child = F.get("seg", k)
    node = ["host", "branch"]
    here = leaves.withColumn("child", child)
    deep = F.size("seg") > k
    kids = here.where(deep & ~child.isin("*", "**")).select(*node, "child").distinct()
    wide = kids.groupBy(*node).agg(F.count("*").alias("kids")).where(F.col("kids") > most).select(*node, F.lit(True).alias("wide"))
    here = lane_join(here, wide, node, ["seg"], how="left")
    here = here.withColumn("child", F.when(F.col("wide") & (F.col("child") != "**"), "*").otherwise(F.col("child"))).drop("wide")
    told = here.where(deep).groupBy(*node, "child").agg(F.sum("labelled").cast("double").alias("n"), F.sum("bad").cast("double").alias("b"), F.min("p").alias("p")).where("n > 0")
    told = told.groupBy(*node).agg(F.array_sort(F.collect_list(F.struct((F.col("b") / F.col("n")).alias("share"), "child", "n", "b"))).alias("kids"), F.min("p").alias("up"))
    told = told.select(*node, "up", F.explode(_branches(F.col("kids"))).alias("x"))
    purity = (F.col("x.b") + strength * F.col("up")) / (F.col("x.n") + strength)
    told = told.select(*node, F.explode("x.names").alias("child"), F.array_join(F.array_sort("x.names"), "/").alias("label"), purity.alias("p_new"))
    here = lane_join(here, told, [*node, "child"], ["seg"], how="left")
    label = F.coalesce("label", "child")  # "/" joins merged names: no segment holds one
    here = here.withColumn("branch", F.when(deep, F.concat("branch", F.array(label))).otherwise(F.col("branch")))
    return here.withColumn("p", F.coalesce("p_new", "p")).select(*names)


def templates(counts: DataFrame, strength: float = STRENGTH, most: int = MOST_SIBLINGS) -> DataFrame:
    """From counts (host, seg, labelled, bad): those with branch (the template's labels, merged names joined by ``/``), p (its smoothed purity) and told (labelled pages of the host)."""
    counts = cut(counts, "leaves")
    total = counts.agg(F.sum("labelled"), F.sum("bad"), F.max(F.size("seg"))).first()
    overall = total[1] / total[0] if total[0] else 0.0
    hosts = counts.groupBy("host").agg(F.sum("labelled").alias("told"), F.sum("bad").alias("hb"))
    leaves = lane_join(counts, hosts, ["host"], ["seg"])
    leaves = leaves.withColumn("branch", F.array().cast("array<string>")).withColumn("p", (F.col("hb") + strength * overall) / (F.col("told") + strength)).drop("hb")
    for k in range(total[2] or 0):
        old, leaves = leaves if k else counts, cut(_level(leaves, k, strength, most), "leaves")
        spent(old)
    return leaves


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url: str = "url", bad: Column | None = None, depth: int = DEPTH, most: int = MOST_SIBLINGS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict. ``bad``: a label (boolean, null: none) over the pages' columns; by default what the rules say."""
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"), *([bad.alias("bad")] if bad is not None else []))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said)
    if bad is None:
        rows = rows.withColumn("bad", F.col("said") == "block")
    rows = rows.withColumn("seg", _segments(F.col("path"), depth))
    counts = rows.groupBy("host", "seg").agg(F.count("bad").alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    tree = templates(counts, most=most)
    rejected = tree.where((F.col("told") > 0) & (F.round("p", 9) >= REJECT)).select("host", "seg", F.lit(True).alias("rejected"))
    open_rows = lane_join(rows.where("rule is null"), rejected, ["host", "seg"], ["page_id", "path"], how="left")
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    return open_rows.select("page_id", "host", "path", "rule", own.alias("verdict")).union(rows.where("rule is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict")))

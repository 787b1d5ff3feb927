"""Line dedup by overlapping three-line windows, in DataFrame operations only.

Every run of ``width`` consecutive lines that hold a word is hashed; a hash
that occurs again later (order: document id, then line) marks its lines there
for removal; overlapping marks are merged. The first occurrence stays whole
even when a later one overlaps it. Blank lines are never removed.

Shuffles: windows by hash (counted with map-side combine, so a window that
millions of rows share is one row per task), then the few repeated windows by
document, and the texts once by document.

Edge cases: a null text counts as empty and comes back null; texts of fewer
than ``width`` such lines are left alone; rows that repeat both id and text
are judged as one row, and both get the result; rows of a null id are left
alone and mark nothing; a very long text is one row of windows, its lines and marks
arrays of its own length; extra columns, whatever their names, are kept by
:func:`dedup`; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, lane_join

WIDTH = 3


def windows(docs: DataFrame, id_col: str, text: str, width: int = WIDTH) -> DataFrame:
    """Rows (__id, __th, at, pos, h1, h2): each window of consecutive lines with words; at: rank of its first line among those, pos: its lines' places in the text."""
    src = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text}`").alias("__t")).where("__id is not null and __t is not null")
    lines = F.transform(F.split("__t", "\n", -1), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    src = src.select("__id", F.xxhash64("__t").alias("__th"), F.filter(lines, lambda e: e["x"].rlike(WORD_PATTERN)).alias("ls"))
    ls = F.col("ls")
    src = src.where(F.size(ls) >= width)
    wins = F.transform(
        F.slice(ls, 1, F.size(ls) - (width - 1)),
        lambda e, i: F.struct(
            i.alias("at"),
            F.array(e["i"], *(F.get(ls, i + k)["i"] for k in range(1, width))).alias("pos"),
            F.xxhash64(e["x"], *(F.get(ls, i + k)["x"] for k in range(1, width))).alias("h1"),
            F.xxhash64(F.lit(width), *(F.get(ls, i + k)["x"] for k in range(width - 1, 0, -1)), e["x"]).alias("h2"),
        ),
    )
    return src.select("__id", "__th", F.inline(wins))


def covered(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Rows (__id, __th, gone): the places of the lines that later occurrences of repeated windows cover."""
    wins = windows(docs, id_col, text, width)
    order = ("__id", "__th", "at")
    seen = wins.groupBy("h1", "h2").agg(F.min(F.struct(*order)).alias("first"), F.max(F.struct(*order)).alias("last")).where("first < last").drop("last")
    later = lane_join(wins, seen, ["h1", "h2"], ["__id", "at"]).where(F.struct(*order) > F.col("first"))
    same = (F.col("__id") == F.col("first.__id")) & (F.col("__th") == F.col("first.__th"))
    spared = F.when(same, F.greatest(F.lit(0), F.col("first.at") + width - F.col("at"))).otherwise(F.lit(0))
    marked = later.select("__id", "__th", "pos", spared.alias("spared")).where(F.col("spared") < width)
    marked = marked.select("__id", "__th", F.explode(F.slice("pos", F.col("spared") + 1, F.lit(width))).alias("line")).distinct()
    return marked.groupBy("__id", "__th").agg(F.collect_list("line").alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, info: bool = False) -> DataFrame:
    """``docs`` with the marked lines taken out of ``text``; with ``info`` also __n_lines and __n_removed."""
    marks = covered(docs, id_col, text, width).select("__id", "__th", F.col("gone").alias("__gone"))
    body, lines, gone = F.col(f"`{text}`"), F.col("__lines"), F.col("__gone")
    # The document travels as one struct, so no name of its columns can meet one of ours.
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc"), F.col(f"`{id_col}`").alias("__id"), F.xxhash64(body).alias("__th"))
    body = F.col("__doc")[text]
    got = keyed.join(marks, ["__id", "__th"], "left").withColumn("__lines", F.split(body, "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    kept = F.when(gone.isNull(), body).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    out = [F.col("__doc")[c].alias(c) if c != text else kept.alias(text) for c in docs.columns]
    if info:
        out += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("__n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__n_removed")]
    return got.select(*out)

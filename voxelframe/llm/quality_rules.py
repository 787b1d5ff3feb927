"""Quality rules: a table of thresholds compiled into one projection.

Every statistic is a built-in expression over the whole text, so a batch of
rules is evaluated in one pass over the rows, without a shuffle and without
user functions.

Edge cases: a null text counts as empty; an empty text has zero in every
count, fails the base rule and is not kept; repeated rows get equal results;
extra columns of the input are ignored by :func:`judge` and kept by
:func:`keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, WORD_PATTERN

#: Very frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it was on with as be at by this are or from an have not "
    "le la les de des et un une en du que qui dans pour est pas sur par au il ne se ce avec plus "
    "der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach "
    "el los las del y un una en que por con no para su al lo como más pero sus o este"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only while ``low <= expression <= high`` (an open end is None); a null value passes."""

    name: str
    expression: str
    low: float | None = None
    high: float | None = None


#: Ratios are of words unless named otherwise.
RULES = (
    Rule("mean_word_chars", "word_chars / nullif(n_words, 0)", 2.0, 12.0),
    Rule("symbol_share", "n_symbols / nullif(n_words, 0)", None, 0.1),
    Rule("stop_share", "n_stop_words / nullif(n_words, 0)", 0.02, None),
    Rule("dup_line_share", "n_dup_lines / nullif(n_lines, 0)", None, 0.3),
    Rule("loud_share", "n_loud / nullif(n_words, 0)", None, 0.3),
)

MIN_WORDS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(df: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """Add ``prefix`` + each statistic to ``df``: all of COUNTS, and n_lines, n_stop_words and n_loud (exclamation marks)."""
    p = prefix
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = df.withColumn(f"{p}words", F.regexp_extract_all(body, F.lit(f"({WORD_PATTERN})"), 1))
    words = F.col(f"{p}words")
    df = df.withColumn(f"{p}n_words", F.size(words).cast("long"))
    df = df.withColumn(
        f"{p}grams",
        F.sort_array(
            F.transform(
                F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                lambda w, i: F.struct(F.concat_ws(" ", w, words[i + 1], words[i + 2]).alias("g"), i.alias("i")),
            )
        ),
    )
    grams = F.col(f"{p}grams")
    df = df.withColumn(
        f"{p}again",
        F.filter(
            grams,
            lambda e, k: ((k > 0) & (F.get(grams, k - 1)["g"] == e["g"])) | ((k < F.size(grams) - 1) & (F.get(grams, k + 1)["g"] == e["g"])),
        ),
    )
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD_PATTERN))
    df = df.withColumn(f"{p}lines", lines)
    covered = F.flatten(F.transform(F.col(f"{p}again"), lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
    stop = F.array(*(F.lit(w) for w in sorted(set(STOP_WORDS))))
    return df.withColumns(
        {
            f"{p}word_chars": F.length(F.regexp_replace(body, SPACE_PATTERN, "")).cast("long"),
            f"{p}n_symbols": (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long"),
            f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
            f"{p}n_repeat_words": F.size(F.array_distinct(covered)).cast("long"),
            f"{p}n_lines": F.size(f"{p}lines").cast("long"),
            f"{p}n_loud": (F.length(body) - F.length(F.translate(body, "!", ""))).cast("long"),
            f"{p}n_stop_words": F.size(F.filter(words, lambda w: F.lower(w).isin(*sorted(set(STOP_WORDS))))).cast("long"),
        }
    ).drop(f"{p}words", f"{p}grams", f"{p}again", f"{p}lines")


def verdict(prefix: str = "q_", rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS) -> tuple[Column, Column]:
    """(base_failed, kept) over the columns of :func:`counts`."""
    import re

    base = (F.col(f"{prefix}n_words") < min_words) | (100 * F.col(f"{prefix}n_repeat_words") > 50 * F.col(f"{prefix}n_words"))
    good = F.lit(True)
    for r in rules:
        value = F.expr(re.sub(r"\b(n_\w+|word_chars)\b", rf"`{prefix}\1`", r.expression))
        if r.low is not None:
            good = good & F.coalesce(value >= r.low, F.lit(True))
        if r.high is not None:
            good = good & F.coalesce(value <= r.high, F.lit(True))
    return base, ~base & good


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: the id, COUNTS, base_failed and kept."""
    base, kept = verdict("", rules)
    got = counts(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", "")
    return got.select("doc_id", *COUNTS, base.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, all columns as they came."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    _, kept = verdict("__q_", rules)
    # A row number that the filter reads keeps the optimiser from writing the statistics out again inside the filter.
    rows = counts(docs, text, "__q_").withColumn("__q_row", F.monotonically_increasing_id())
    return rows.where(kept & (F.col("__q_row") >= 0)).select(*names)

"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of ``documents``.

Line dedup comes before the join of near copies: of a near copy that shares whole
lines with an earlier document, only what is its own reaches the join, which then
finds copies that differ within their lines. A document all of whose lines occur
earlier is a copy, and goes with them.

Edge cases, as the stages' operators define them: a null, empty or short text fails the
quality rules and goes; rows that repeat an id and text share every verdict, and all
stay where their document stays; a row of a null id is judged by the rules, is no
copy of anything and is mixed by a draw on its text; extra columns of any name pass
through all stages but the last; a text without words that lost no line stays as it is; a
very long text is one row throughout; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelframe.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules
from voxelframe.llm.common import WORD_PATTERN, cut, documents
from voxelframe.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows go, and with them documents that hold no word any more; n_chars follows the text."""
    out = line_dedup.dedup(docs, info=True)
    emptied = (F.col("__n_removed") > 0) & ~F.col("text").rlike(WORD_PATTERN)
    out = out.where(~F.coalesce(emptied, F.lit(False))).drop("__n_lines", "__n_removed")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one whose id names the group. Documents of no group, or of no id, stay."""
    return docs.join(jaccard_join.strays(docs), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with their digests. Workers remember fewer words here, as they outlive the stage."""
    return bpe.encode(docs, tokenizer_path(), ids=True, memo=200_000)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_copies), ("mixing", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: BPE has no SQL form; tests/llm/test_pipeline.py holds every stage and run() against plain versions.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

"""Exact top-k inner products with vector-approximation files.

Vectors become integers, floor(scale * x), and each gets a row number. The
approximation file holds a cell number of one byte for each component, packed in blocks
with their own grids: whole numbers from the block's least to its greatest value,
in cells of equal width (of width 1, and so exact, where 256 cells reach).

* Scan: blocks of queries meet chunks of the file. One matrix product gives every score
  at the cells' middles; a margin of the query and the grid makes it a lower and an
  upper bound. What can't reach the k-th best lower bound so far is dropped.
* Bound: the k-th best lower bound of each query over the whole file drops most of
  what the chunks have left. Only row numbers and bounds have travelled so far.
* Read: exact vectors are fetched by row number in order of their bounds: first
  each query's k likeliest, then, with their exact k-th score, the rest that can
  still reach it. After that the k-th result is certain.

Equal vectors score alike, so of a vector that many rows share only the k + 1 least ids
can be among any query's best (one of them may be the query's own): the others take no
part, which keeps a vector that a third of the rows hold from tying with all
queries.

Every chunk is scanned for every query, as an exact search without an index of
directions must: the file is shipped once a block of ``QUERY_BLOCK`` queries, at a byte a
component. Memory is a chunk of the file and a block of queries for each task.

Edge cases: vectors that are null, or hold null or non-finite components, and
rows of a null id take no part; vectors of another length than the query's are
no candidates; fewer candidates than k give all of them; equal scores go to the
smaller id; rows that repeat the query's id are not candidates, other repeated
rows count each; a query's id that repeats with other vectors asks for the best of
them all; scores beyond 64 bits become the nearest 64-bit integer; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, spent

#: Vectors of one chunk of the file, and queries of one block.
DATA_CHUNK = 1 << 17
QUERY_BLOCK = 8192
CELLS = 256
#: Queries whose bounds one matrix holds at a time.
STEP = 256
SAFE = 2.0**52
#: Scores beyond 64 bits are clipped, and so are their bounds, so that clipped scores tie.
RANGE = (-(2.0**63), 2.0**63)
#: Rows that a filter may broadcast.
ROWS_BROADCAST = 100_000


def _matrix(column) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) for each length of vectors."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(arr.offsets))
    out = []
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        flat = arr.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        out.append((int(n), rows, flat.reshape(len(rows), int(n)).astype(np.float64)))
    return out


def cells(vectors: np.ndarray, count: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, low, width): cell c of a component holds the whole numbers from low + c * width, ``width`` of them."""
    low = vectors.min(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
    span = (vectors.max(axis=0) if len(vectors) else low) - low
    width = np.maximum(np.ceil((span + 1) / count), 1)
    return np.minimum((vectors - low) // width, count - 1).astype(np.uint8), low, width


def bounds(queries: np.ndarray, codes: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(scores, base, margin): a query's score with a vector lies within margin of scores + base."""
    half = (width - 1) / 2
    step = queries * width
    size = np.abs(step).sum(axis=1) * CELLS + np.abs(queries) @ (np.abs(low) + width)
    small = bool((size < 1e30).all())
    scores = (step.astype(np.float32) @ codes.astype(np.float32).T) if small else step @ codes.astype(np.float64).T
    # Rounding of the product and of the sums, bounded by the size of what is summed.
    loss = size * (queries.shape[1] + 4) * (2.0**-23 if small else 2.0**-50)
    return scores, queries @ (low + half), np.abs(queries) @ half + loss


def scan(blocks: list, q_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, lower, upper) of what the cells of ``blocks`` can't rule out. blocks: (ids, rows, codes, low, width)."""
    out = []
    for at in range(0, len(q_ids), STEP):
        ids, q = q_ids[at : at + STEP], queries[at : at + STEP]
        floor = np.full(len(ids), -np.inf)
        order = np.argsort(ids, kind="stable")
        kept = []
        for v_ids, rows, codes, low, width in blocks:
            scores, base, margin = bounds(q, codes, low, width)
            scores = scores.astype(np.float64)
            # A query's own id is no candidate.
            first, last = np.searchsorted(ids[order], v_ids, "left"), np.searchsorted(ids[order], v_ids, "right")
            for j in np.flatnonzero(first < last):
                scores[order[first[j] : last[j]], j] = -np.inf
            if scores.shape[1] >= k:
                kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                floor = np.maximum(floor, np.clip(kth + base - margin, *RANGE))
            x, j = np.nonzero((np.clip(scores + (base + margin)[:, None], *RANGE) >= floor[:, None]) & (scores > -np.inf))
            s = scores[x, j] + base[x]
            kept.append((x, rows[j], np.clip(s - margin[x], *RANGE), np.clip(s + margin[x], *RANGE)))
        if kept:
            x, row, lower, upper = (np.concatenate(c) for c in zip(*kept))
            fine = upper >= floor[x]
            out.append((x[fine] + at, row[fine], lower[fine], upper[fine]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))


def exact(q: np.ndarray, v: np.ndarray) -> list[int]:
    """Inner products of rows of whole numbers, as 64-bit integers."""
    size = np.abs(q).max(initial=0) * max(1.0, np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if size < SAFE:
        return np.einsum("ij,ij->i", q, v).astype(np.int64).tolist()
    return [max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(x, y)))) for x, y in zip(q, v)]


def _whole(table: DataFrame, queries: Column, id_col: str, vector: str, scale: int) -> DataFrame:
    """(row, id, v, h1, h2, is_query) of rows that take part, written once, so that row numbers hold."""
    v = F.col(f"`{vector}`")
    fine = F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))

    def whole(e: Column) -> Column:
        x = e.cast("double") * scale
        return F.when(F.abs(x) < F.lit(SAFE), F.floor(x).cast("double")).otherwise(x)  # beyond, doubles are whole

    rows = table.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(v, whole).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    rows = rows.where(F.forall("v", lambda e: F.abs(e) < F.lit(float("inf"))))
    return cut(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}), "vectors")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= ROWS_BROADCAST else df


def _candidates(rows: DataFrame, k: int) -> DataFrame:
    """Of a vector that more than k + 1 rows hold, the rows of its k + 1 least ids, k of each at most; all others as they are."""
    name = ["h1", "h2"]
    crowded = cut(rows.groupBy(*name).agg(F.count("*").alias("c")).where(F.col("c") > k + 1).select(*name), "crowded")
    if crowded.isEmpty():
        return rows
    light = rows.select("row", "id", *name).join(_few(crowded), name)
    light = light.withColumn("i", F.row_number().over(Window.partitionBy(*name, "id").orderBy("row"))).where(F.col("i") <= k)
    light = light.withColumn("i", F.dense_rank().over(Window.partitionBy(*name).orderBy("id"))).where(F.col("i") <= k + 1)
    keep = cut(light.select("row"), "kept")
    return rows.join(_few(crowded), name, "left_anti").select(*rows.columns).union(rows.join(_few(keep), "row", "left_semi").select(*rows.columns))


def _file(rows: DataFrame, chunks: int, q_blocks: int) -> DataFrame:
    """The approximation file: (chunk, q_block, ids, rows, codes, low, width), a row for each Arrow batch and length, repeated for every block of queries."""

    def run(batches):
        for batch in batches:
            for _, at, m in _matrix(batch.column(2)):
                codes, low, width = cells(m)
                take = pa.array(at)
                one = [batch.column(0).take(take), batch.column(1).take(take)]
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), x) for x in one]
                arrays += [pa.array([codes.tobytes()], pa.binary()), pa.array([low.tolist()], pa.list_(pa.float64())), pa.array([width.tolist()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["rows", "ids", "codes", "low", "width"])

    packed = cut(rows.select("row", "id", "v").mapInArrow(run, "rows array<bigint>, ids array<bigint>, codes binary, low array<double>, width array<double>"), "cells")
    chunk = F.pmod(F.xxhash64(F.get("rows", 0)), F.lit(chunks)).cast("int").alias("chunk")
    return packed.select(chunk, F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"), "ids", "rows", "codes", "low", "width")


def _read(pairs: DataFrame, asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Exact scores of pairs (query_id, q_row, row): (query_id, q_row, row, vec_id, score)."""

    def run(batches):
        for batch in batches:
            q, v = ({n: (at, m) for n, at, m in _matrix(batch.column(c))} for c in (4, 5))
            score = np.zeros(len(batch), object)
            for n, (at, m) in q.items():
                for z in range(0, len(at), 4096):
                    score[at[z : z + 4096]] = exact(m[z : z + 4096], v[n][1][z : z + 4096])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(score.tolist(), pa.int64())], names=["query_id", "q_row", "row", "vec_id", "score"])

    got = pairs.select("query_id", "q_row", "row").join(rows.select("row", F.col("id").alias("vec_id"), "v"), "row").join(asked.select("q_row", "q"), "q_row")
    return got.select("query_id", "q_row", "row", "vec_id", "q", "v").mapInArrow(run, "query_id bigint, q_row bigint, row bigint, vec_id bigint, score bigint")


def search(table: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", scale: int = 64, data_chunk: int = DATA_CHUNK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query row's k best others: query_id, rank, vec_id, score. ``queries`` is a condition on the rows."""
    rows = _whole(table, queries, id_col, vector, scale)
    asked = rows.where("is_query").groupBy("id", "h1", "h2").agg(F.min_by("v", "row").alias("q"), F.min("row").alias("q_row"))
    asked = cut(asked.select(F.col("id").alias("query_id"), "q_row", "q"), "asked")
    chunks, q_blocks = max(1, -(-rows.count() // data_chunk)), max(1, -(-asked.count() // query_block))
    left = _file(_candidates(rows, k), chunks, q_blocks)
    right = asked.select(F.pmod(F.xxhash64("q_row"), F.lit(q_blocks)).cast("int").alias("to_block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("to_chunk"), "query_id", "q_row", "q")

    def run(file: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        if file.num_rows and block.num_rows:
            by_length: dict[int, list] = {}
            for r in range(file.num_rows):
                ids, at, raw, low, width = (file.column(c)[r] for c in ("ids", "rows", "codes", "low", "width"))
                low, width = low.values.to_numpy(), width.values.to_numpy()
                codes = np.frombuffer(raw.as_buffer(), np.uint8).reshape(len(ids.values), len(low))
                by_length.setdefault(len(low), []).append((ids.values.to_numpy(), at.values.to_numpy(), codes, low, width))
            q_id, q_row = block.column("query_id").to_numpy(), block.column("q_row").to_numpy()
            for n, at, q in _matrix(block.column("q")):
                if n in by_length:
                    x, row, lower, upper = scan(by_length[n], q_id[at], q, k)
                    out.append((q_id[at][x], q_row[at][x], row, lower, upper))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)] * 2
        return pa.table(dict(zip(("query_id", "q_row", "row", "low", "up"), cols)))

    found = left.groupBy("q_block", "chunk").cogroup(right.groupBy("to_block", "to_chunk")).applyInArrow(run, "query_id bigint, q_row bigint, row bigint, low double, up double")
    # Places by lower bound give the k-th one; what it doesn't rule out, in order of upper bounds, is to be read.
    found = cut(found, "found")
    kth = found.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))).where(F.col("i") <= k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("low")).alias("floor"))
    left_over = found.join(kth, "query_id").where(F.col("floor").isNull() | (F.col("up") >= F.col("floor")))
    left_over = cut(left_over.withColumn("i", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("up"), "row"))).drop("floor", "low"), "left")
    first = cut(_read(left_over.where(F.col("i") <= k), asked, rows), "read")
    sure = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("sure"))
    rest = left_over.where(F.col("i") > k).join(sure, "query_id").where(F.col("sure").isNull() | (F.col("up") >= F.col("sure").cast("double")))
    scored = first.union(_read(rest, asked, rows))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    spent(found)
    return out

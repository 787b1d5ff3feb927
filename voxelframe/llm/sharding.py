"""Sharding by minimax contiguous partition, in DataFrame operations only.

Rows of equal text form one atomic group; groups are ordered by their text's MD5.
The smallest capacity for which a greedy scan of the groups needs no more than the
wanted shards is found without bringing the groups to the driver:

* One aggregation with map-side combine gives each group's size, written once.
* The driver works on atoms, ranges of the order: first the 65,536 of a 16-bit prefix.
  A binary search over whole atoms bounds the capacity from above; one that may cut
  atoms of several groups anywhere bounds it from below.
* While the bounds differ, the atoms that a cut between them may fall into are split
  by the next 8 bits and read again. Others stay as they are, so the driver holds some
  hundred atoms a cut and turn more, whatever the input's size.

The cuts then stay within the capacity and lie as near to even shares as it allows. A
row's shard is a projection of its text's hash.

Slots: rows are counted by (shard, lane), a lane being a hash of the id, and
numbered within their lane; lanes grow in number with the table, so no task holds a whole
shard and one text that a third of the rows share is spread over the lanes of its shard.

Edge cases: a null text has no bytes, counts as the empty text and has its
checksum (0); a group larger than an even share gets a shard of its size; with
fewer groups than shards the last shards are empty; rows of a null id, and repeated
rows, each get a slot of their own (ties fall in any order among equal rows); a very
long text is one size; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import cut, spent

#: Hex digits of the first atoms, and of each split.
FIRST_DIGITS, MORE_DIGITS = 4, 2
#: Lanes of a shard: so many at least, and one for so many rows.
LANES, LANE_ROWS = 64, 50_000


def need_from(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """need[i]: the shards that a greedy scan from the end takes for atoms i and after; the last entry is 0."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    need = np.zeros(len(sizes) + 1, np.int64)
    # Furthest end that one shard reaches from each start; greedy needs are monotone, so need[i] = 1 + need[reach[i]].
    reach = np.searchsorted(sums, sums[:-1] + capacity, "right") - 1
    for i in range(len(sizes) - 1, -1, -1):
        need[i] = 1 + need[reach[i]]
    return need


def feasible(sums: np.ndarray, shards: int, capacity: int) -> bool:
    at, end = 0, len(sums) - 1
    for _ in range(shards):
        at = int(np.searchsorted(sums, sums[at] + capacity, "right")) - 1
        if at >= end:
            return True
    return at >= end


def fluid(sums: np.ndarray, whole: np.ndarray, shards: int, capacity: int) -> list[int] | None:
    """Ends of greedy shards when atoms that aren't ``whole`` may be cut anywhere; None if the shards don't suffice."""
    at, end, ends = 0, int(sums[-1]), []
    for _ in range(shards):
        to = at + capacity
        if to >= end:
            return [*ends, end]
        j = int(np.searchsorted(sums, to, "right")) - 1
        to = int(sums[j]) if whole[j] else to
        if to <= at:
            return None
        at = to
        ends.append(at)
    return ends if at >= end else None


def least(fits, low: int, high: int) -> int:
    """The least capacity that fits."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


def between(sizes: np.ndarray, whole: np.ndarray, shards: int) -> tuple[int, int, np.ndarray]:
    """(lower, upper) bounds of the capacity, and which atoms to split: those of several groups that a cut between the two may fall into."""
    sums = np.concatenate([[0], np.cumsum(sizes)])
    even = -(-int(sums[-1]) // shards)
    high = least(lambda c: feasible(sums, shards, c), max(int(sizes.max()), even), int(sums[-1]))
    low = least(lambda c: fluid(sums, whole, shards, c) is not None, max(int(sizes[whole].max(initial=0)), even), high)
    split = np.zeros(len(sizes), bool)
    if low < high:
        # Shard ends grow with the capacity, so those of any between lie between these.
        first, last = fluid(sums, whole, shards, low), fluid(sums, whole, shards, high)
        last += [int(sums[-1])] * (len(first) - len(last))
        for x, y in zip(first, last):
            split[max(0, int(np.searchsorted(sums, x, "right")) - 2) : int(np.searchsorted(sums, y, "left")) + 1] = True
        split[sizes > low] = True
        split &= ~whole
    return low, high, split


def minimax_cuts(sizes, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and for shards 1.. the index of their first atom (shards - 1 cuts)."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return 0, [0] * (shards - 1)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    low = least(lambda c: feasible(sums, shards, c), max(int(sizes.max()), -(-int(sums[-1]) // shards)), int(sums[-1]))
    need, cuts, at = need_from(sizes, low), [], 0
    for k in range(1, shards):
        left = shards - k
        furthest = int(np.searchsorted(sums, sums[at] + low, "right")) - 1
        # need[] falls along the atoms: the nearest cut that leaves enough shards for the rest.
        nearest = at + int(np.searchsorted(-need[at:], -left, "left"))
        even = sums[at] + (sums[-1] - sums[at]) / (left + 1)
        j = int(np.searchsorted(sums, even))
        if j > 0 and even - sums[j - 1] <= sums[min(j, len(sums) - 1)] - even:
            j -= 1
        at = min(max(j, nearest), furthest)
        cuts.append(at)
    return low, cuts


def _atoms(groups: DataFrame, digits) -> dict[str, tuple[int, bool]]:
    """{prefix: (size, one group only)} of the groups (m, size), by their first ``digits`` (a number or a column)."""
    got = groups.groupBy(F.substring("m", 1, digits).alias("p") if isinstance(digits, int) else digits.alias("p")).agg(F.sum("size").alias("s"), (F.min("m") == F.max("m")).alias("one"))
    return {r["p"]: (r["s"], r["one"]) for r in got.collect()}


def starts(groups: DataFrame, shards: int) -> list[str | None]:
    """For shards 1.. the prefix of the MD5 at which each starts (None: it is empty). groups: (m, size), one row for each text."""
    atoms = _atoms(groups, FIRST_DIGITS)
    while True:
        names = sorted(atoms)
        sizes, whole = np.array([atoms[p][0] for p in names], np.int64), np.array([atoms[p][1] for p in names], bool)
        if not names:
            return [None] * (shards - 1)
        low, high, split = between(sizes, whole, shards)
        if low == high or not split.any():
            break
        by_length: dict[int, list[str]] = {}
        for p in np.array(names, object)[split]:
            by_length.setdefault(len(p), []).append(p)
            del atoms[p]
        for n, wanted in by_length.items():
            some = groups.sparkSession.createDataFrame([(p,) for p in wanted], "p string")  # atoms that cuts fall into: hundreds a cut at most
            inside = groups.withColumn("p", F.substring("m", 1, n)).join(F.broadcast(some), "p", "left_semi").select("m", "size")
            atoms.update(_atoms(inside, n + MORE_DIGITS))
    _, cuts = minimax_cuts(sizes, shards)
    return [names[c] if c < len(names) else None for c in cuts]


def assign(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shards: int = 24, overhead: int = 8) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``bytes``)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    raw = F.encode(body, "UTF-8")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(body) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.md5(raw).alias("m"))
    # What the passes below read: 48 bytes a row instead of its text.
    rows = cut(rows, "rows")
    groups = cut(rows.groupBy("m").agg(F.sum("size").alias("size")), "groups")
    shard = F.lit(0)
    for p in starts(groups, shards):
        shard = shard + (F.col("m") >= p).cast("int") if p is not None else shard
    spent(groups)
    lanes = max(LANES, -(-rows.count() // (shards * LANE_ROWS)))
    lane = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "m")), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("shard", shard).withColumn("lane", F.pmod(lane, F.lit(lanes)).cast("int"))
    total, before = {}, []
    for r in sorted(rows.groupBy("shard", "lane").count().collect(), key=lambda r: (r["shard"], r["lane"])):
        before.append((r["shard"], r["lane"], total.get(r["shard"], 0)))
        total[r["shard"]] = total.get(r["shard"], 0) + r["count"]
    offsets = spark.createDataFrame(before, T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("lane", T.IntegerType()), T.StructField("before", T.LongType())]))
    numbered = rows.withColumn("k", F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size")))
    # A row for each lane: a small share of the table's rows, LANE_ROWS to one.
    got = numbered.join(F.broadcast(offsets), ["shard", "lane"])
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two sets of sizes m and n reach Jaccard p/100 only if they share
T = ceil(p (m + n) / (100 + p)) members. The lists of a set's n - ceil(p n / 100) + 1
rarest members (by a counting sketch of all documents) are indexed; the L others,
one fewer than any partner must share, are only probed. So every partner occurs in
T - L indexed lists at least.

* Index: a shuffled, sorted stream over (member, set); lists of one set go. Salts cut
  lists that the sketch finds to be very long.
* First links: each set probes the leader of most of its lists, so a group of
  thousands of near copies becomes one component for a probe a set. Only components are
  asked for, so lists that hold a single one are closed from then on.
* Search: queries, sets that share an open list with a larger component, are dealt
  into bins of bounded work, and each list is shipped once to every bin that asks for it. For
  each query and band of sizes, DivideSkip sets the longest lists aside, merges the
  short ones with a heap that skips what can't reach the count, and looks the
  candidates up in the long ones by binary search. A query whose lists are longer than
  a task's share is split by its candidates, each with all of its occurrences.
* Candidates are probed: binary search of one's sorted members in the other's whole
  array; pairs that reach T are links. The first turns probe each query's likeliest
  candidates, which merges most components; the last probes every one that is left
  (none, as a rule), so no link between components is lost.

Work is the sum of the open lists' lengths over the queries, and a task holds
``TASK_ENTRIES`` list entries whatever the input. Documents of equal sets are one class,
represented by its least id.

Edge cases: null and empty texts have no shingles, are linked with nothing and
are their own component; fewer words than the shingle length give one shingle of
them all; a row of a null id has no component; rows that repeat an id are one
document whose texts are linked; a very long text is one sorted array of 8 bytes a
shingle; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, claim, cut, lane_join, mix, slices, spent, words_of
from .components import components, grow

SHINGLE = 5
PERCENT = 80
SKETCH_BITS = 20
CHUNK = 1 << 14
#: Rows of one member's list that one task may hold in a run before the list is salted.
RUN_ROWS = 4096
#: List entries that one task of the search takes, and the least number of bins of queries.
TASK_ENTRIES, LEAST_BINS = 500_000, 32
#: Ids that a filter of texts may broadcast, at 8 bytes each.
IDS_BROADCAST = 500_000
#: Likeliest candidates of each query that the first turns probe; a last turn probes all that are left, if any are.
TRIES = (8, 1000)
#: DivideSkip's weight of a probe against a merge step, and the bands of sizes around a query's.
MU = 0.0085
BANDS = (0.0, 0.85, 0.9, 0.95, 1.0, 1.06, 1.12, 1.18, math.inf)

_ROLL = Rolling(0xB5AD4ECEDA1CE2A9)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row: (hashes, bounds), each row's hashes ascending."""
    hashes, _, _, bounds = words_of(data, offsets, fold=True)
    counts = np.diff(bounds)
    rows = len(counts)
    take = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(rows), take)
    base = np.cumsum(take) - take
    start = bounds[:-1][row] + (np.arange(len(row)) - base[row])
    stop = np.minimum(start + width, bounds[1:][row])
    sums = _ROLL.prefix(hashes)
    got = _ROLL.of(sums, start, stop) ^ mix((stop - start).astype(np.uint64))
    order = np.lexsort((got, row))
    got, row = got[order], row[order]
    new = np.ones(len(got), bool)
    new[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
    got, row = got[new], row[new]
    return got, np.searchsorted(row, np.arange(rows + 1))


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[np.uint64(0)], np.cumsum(values, dtype=np.uint64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def needed(m, n, percent: int = PERCENT):
    """Members that sets of m and n members must share."""
    return -(-percent * (m + n) // (100 + percent))


def short_lists(n, percent: int = PERCENT):
    """The number of short lists of a set of n members."""
    return n - (-(-percent * n // 100)) + 1


def _survey(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """One pass over the texts: a row for each document (its set's size and 128-bit name) and counts for the sketch, in chunks."""
    schema = pa.schema([("chunk", pa.int32()), ("counts", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64())])

    def run(batches):
        claim("jaccard_join")
        counts, seen = np.zeros(1 << bits, np.int64), False
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                got, bounds = shingles(data, offsets, width)
                seen = seen or bool(len(got))
                counts += np.bincount(got >> np.uint64(64 - bits), minlength=1 << bits)
                f1, f2 = mix(_sums(mix(got), bounds)), mix(_sums(mix(got * np.uint64(0x8CB92BA72F3D8DD7) + np.uint64(1)), bounds))
                rows = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), batch.column(0).slice(a, rows), pa.array(np.diff(bounds)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64))], schema=schema
                )
        if seen:
            parts = range(-(-(1 << bits) // CHUNK))
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int32()), pa.array([counts[k * CHUNK : (k + 1) * CHUNK].astype(np.int64).tobytes() for k in parts], pa.binary()), *(pa.nulls(len(parts), pa.int64()) for _ in range(4))], schema=schema
            )

    return docs.mapInArrow(run, "chunk int, counts binary, doc_id bigint, n bigint, f1 bigint, f2 bigint")


def _add_chunks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum the count arrays of each key: batches of a group are added as they come."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("counts"):
                x = np.frombuffer(raw.as_py(), np.int64)
                total = x.copy() if total is None else total + x
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.int32()) for k in key), pa.array([total.tobytes()], pa.binary())], names=[*keys, "counts"])

    return df.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} int" for k in keys) + ", counts binary")


def sketch(survey: DataFrame, bits: int) -> np.ndarray:
    """Document counts by the members' first ``bits`` bits, over all documents: 2**bits numbers, whatever the input's size."""
    parts = survey.where("chunk is not null").select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).cast("int").alias("lane"))
    parts = _add_chunks(_add_chunks(parts, ["chunk", "lane"]).select("chunk", "counts"), ["chunk"])
    total = np.zeros(1 << bits, np.int64)
    for r in parts.collect():
        x = np.frombuffer(r["counts"], np.int64)
        total[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(x)] = x
    return total


def _short_rows(docs: DataFrame, counts, width: int, percent: int, bits: int, run_rows: int) -> DataFrame:
    """Rows (key, salt, f1, n): each set's members with short lists. A task emits a set that it meets again only once."""
    schema = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("f1", pa.int64()), ("n", pa.int32())])

    def run(batches):
        claim("jaccard_join")
        frequency, met = counts.value, set()
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                got, bounds = shingles(data, offsets, width)
                n = np.diff(bounds)
                f1 = mix(_sums(mix(got), bounds))
                fresh = np.zeros(len(n), bool)
                for r, name in enumerate(f1.tolist()):
                    if n[r] and name not in met:
                        if len(met) > 100_000:
                            met.clear()
                        met.add(name)
                        fresh[r] = True
                row = np.repeat(np.arange(len(n)), n)
                keep = fresh[row]
                got, row = got[keep], row[keep]
                often = frequency[got >> np.uint64(64 - bits)]
                order = np.lexsort((got, often, row))
                got, row, often = got[order], row[order], often[order]
                first = np.searchsorted(row, row)
                short = np.arange(len(row)) - first < short_lists(n, percent)[row]
                got, row, often = got[short], row[short], often[short]
                lanes = np.maximum(often // run_rows, 1)
                salt = np.where(lanes > 1, 1 + (mix(f1[row]) % lanes.astype(np.uint64)).astype(np.int64), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(got.view(np.int64)), pa.array(salt), pa.array(f1[row].view(np.int64)), pa.array(n[row].astype(np.int32))], schema=schema)

    return docs.select("text").mapInArrow(run, "key bigint, salt int, f1 bigint, n int")


def _merge_lists(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Stream the short lists in order of (key, salt, n, f1): (key, salt, f1, n, lead, lead_n) of each distinct set in a list of two sets or more, and of every set in a salted list."""
    schema = pa.schema([("key", pa.int64()), ("salt", pa.int32()), ("f1", pa.int64()), ("n", pa.int32()), ("lead", pa.int64()), ("lead_n", pa.int32())])

    def run(batches):
        last = None  # of the stream so far: key, salt, f1, leader, leader's n, if the leader's row is out
        for batch in batches:
            if not len(batch):
                continue
            key, salt, f1, n = (batch.column(i).to_numpy() for i in range(4))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            carried = last is not None and last[0] == key[0] and last[1] == salt[0]
            new[0] = not carried
            group = np.cumsum(new) - 1 + carried
            heads = np.flatnonzero(new)
            lead = np.concatenate([[last[3]], f1[heads]])[group] if carried else f1[heads][group]
            lead_n = np.concatenate([[last[4]], n[heads]])[group] if carried else n[heads][group]
            same = np.zeros(len(key), bool)
            same[1:] = ~new[1:] & (f1[1:] == f1[:-1])
            same[0] = carried and last[2] == f1[0]
            link = ~same & ~new & (f1 != lead)
            # A leader's row goes out when the first other set of its list appears.
            others = np.flatnonzero(link)
            firsts = others[np.unique(group[others], return_index=True)[1]] if len(others) else others
            if carried and last[5]:
                firsts = firsts[group[firsts] != 0]
            # A salted list's leader goes out at once: its key's other salts may hold sets.
            firsts = np.concatenate([firsts[salt[firsts] == 0], np.flatnonzero(new & (salt > 0))])
            at = np.concatenate([others, firsts])
            own_f1 = np.concatenate([f1[others], lead[firsts]])
            own_n = np.concatenate([n[others], lead_n[firsts]])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(salt[at]), pa.array(own_f1), pa.array(own_n), pa.array(lead[at]), pa.array(lead_n[at])], schema=schema)
            shown = salt[-1] > 0 or bool(len(others)) and bool((group[others] == group[-1]).any()) or (carried and last[5] and group[-1] == 0)
            last = (key[-1], salt[-1], f1[-1], lead[-1], lead_n[-1], shown)

    sorted_rows = (rows.repartition(parts, "key", "salt") if parts else rows.repartition("key", "salt")).sortWithinPartitions("key", "salt", "n", "f1")
    return sorted_rows.mapInArrow(run, "key bigint, salt int, f1 bigint, n int, lead bigint, lead_n int")


def _arrays(src: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc, members): the sorted members of the documents of ``ids`` (doc_id). A task emits an id's text that it meets again only once."""

    def run(batches):
        claim("jaccard_join")
        met = set()
        for batch in batches:
            ids = batch.column(0)
            for a, b, data, offsets in slices(batch.column(1)):
                got, bounds = shingles(data, offsets, width)
                f1 = mix(_sums(mix(got), bounds))
                fresh = []
                for r, name in enumerate(zip(ids.slice(a, b - a).to_pylist(), f1.tolist())):
                    if bounds[r] < bounds[r + 1] and name not in met:
                        if len(met) > 100_000:
                            met.clear()
                        met.add(name)
                        fresh.append(r)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(got.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a).take(pa.array(fresh, pa.int64())), lists.take(pa.array(fresh, pa.int64()))], names=["doc", "members"])

    # A filter of ids is a broadcast while they are few (checked), else a shuffled join.
    ids = cut(ids.where("doc_id is not null").distinct(), "ids")
    some = src.join(F.broadcast(ids) if ids.count() <= IDS_BROADCAST else ids, "doc_id", "left_semi")
    out = cut(some.select("doc_id", "text").mapInArrow(run, "doc bigint, members array<bigint>"), "members")
    spent(ids)
    return out


def _probe(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of document ids, those whose whole sets share enough: binary search of one's sorted members in the other's."""

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            sides = []
            for c in (2, 3):
                lists = batch.column(c)
                sides.append((np.asarray(lists.offsets), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)))
            (xo, xs), (yo, ys) = sides
            ok = np.zeros(len(batch), bool)
            for i in range(len(batch)):
                x, y = xs[xo[i] : xo[i + 1]], ys[yo[i] : yo[i + 1]]
                if len(x) > len(y):
                    x, y = y, x
                if not len(x) or len(x) < needed(len(x), len(y), percent):
                    continue
                k = np.searchsorted(y, x)
                k[k == len(y)] = 0
                both = int((y[k] == x).sum())
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], schema=schema)

    one = arrays.select(F.col("doc").alias("a"), F.col("members").alias("x"))
    two = arrays.select(F.col("doc").alias("b"), F.col("members").alias("y"))
    # A leader repeats in b: both sides come from exchanges of this join alone, so adaptive execution can split it.
    got = pairs.join(one, "a").join(two, "b")
    return got.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint").distinct()


# ---------------------------------------------------------------- the search


def threshold(n, m, percent: int = PERCENT):
    """Indexed lists that sets of n and m members must share: T - L."""
    most = np.maximum(n, m)
    return needed(n, m, percent) - (most - short_lists(most, percent))


def divide_skip(lists: list[list[int]], theta: int) -> list[tuple[int, int]]:
    """(id, number of lists) of every id that ``theta`` of the ascending lists hold.

    The longest lists are set aside; the others are merged by a heap of their
    heads. A head that too few lists hold can't be an answer, nor can any id before the
    head that the next lists bring: they skip to it by binary search. Candidates are
    then looked up in the long lists, the longest last, until theta is out of reach.
    """
    if len(lists) < theta:
        return []
    lists = sorted(lists, key=len)
    aside = min(theta - 1, int(theta / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    least = theta - aside
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    at, found = [0] * len(short), []
    while len(heap) >= least:
        head, popped = heap[0][0], []
        while heap and heap[0][0] == head:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= least:
            found.append((head, len(popped)))
            for k in popped:
                at[k] += 1
                if at[k] < len(short[k]):
                    heapq.heappush(heap, (short[k][at[k]], k))
            continue
        while heap and len(popped) < least - 1:
            popped.append(heapq.heappop(heap)[1])
        if not heap:
            break
        for k in popped:
            at[k] = bisect_left(short[k], max(heap[0][0], head + 1), at[k])
            if at[k] < len(short[k]):
                heapq.heappush(heap, (short[k][at[k]], k))
    out = []
    for head, count in found:
        for left, x in zip(range(len(long), 0, -1), long):
            if count + left < theta:
                break
            j = bisect_left(x, head)
            count += j < len(x) and x[j] == head
        if count >= theta:
            out.append((head, count))
    return out


def _search(lists: pa.Table, queries: pa.Table, percent: int, most: int | None):
    """Candidates (query, set) of one task, the ``most`` likeliest of each query, the number of all, and the ids that all hold."""
    out_a, out_b, total, met = [], [], 0, set()
    if not lists.num_rows or not queries.num_rows:
        return out_a, out_b, total, met
    key, doc, n, comp, w = (lists.column(c).to_numpy() for c in ("key", "doc", "n", "comp", "w"))
    # Sets get local names in order of size, so that a band of sizes is a range of every list.
    order = np.lexsort((doc, n))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (n[order][1:] != n[order][:-1])
    name = np.empty(len(order), np.int64)
    name[order] = np.cumsum(new) - 1
    one = order[new]
    ids, sizes = doc[one], n[one].astype(np.int64)
    qc, qw = queries.column("comp").to_numpy(), queries.column("w").to_numpy()
    # Places of components in one order, shared by sets and queries.
    allc, allw = np.concatenate([comp[one], qc]), np.concatenate([w[one], qw])
    by = np.lexsort((allc, allw))
    place = np.empty(len(by), np.int64)
    place[by] = np.cumsum(np.concatenate([[0], (allc[by][1:] != allc[by][:-1]) | (allw[by][1:] != allw[by][:-1])]))
    place, q_place = place[: len(one)], place[len(one) :]
    by_key = np.lexsort((name, key))
    key, name = key[by_key], name[by_key]
    keys, first = np.unique(key, return_index=True)
    last = np.append(first[1:], len(key))
    q_id, q_n = queries.column("doc").to_numpy(), queries.column("n").to_numpy().astype(np.int64)
    asked = queries.column("keys").combine_chunks()
    asked_at, flat = np.asarray(asked.offsets), asked.values.to_numpy(zero_copy_only=False)
    where = np.minimum(np.searchsorted(keys, flat), len(keys) - 1)
    there = keys[where] == flat
    for q in range(len(q_id)):
        z = where[asked_at[q] : asked_at[q + 1]][there[asked_at[q] : asked_at[q + 1]]]
        count = last[z] - first[z]
        if not len(z):
            continue
        base = np.repeat(first[z] - (np.cumsum(count) - count), count)
        t, k = name[base + np.arange(int(count.sum()))], np.repeat(np.arange(len(z)), count)
        size = int(q_n[q])
        edges = np.searchsorted(sizes, [-(-percent * size // 100), 100 * size // percent + 1])
        keep = (t >= edges[0]) & (t < edges[1]) & (place[t] > q_place[q])
        t, k = t[keep], k[keep]
        if not len(t):
            continue
        found: list[tuple[int, int]] = []
        cuts = np.searchsorted(sizes, [b * size if math.isfinite(b) else 1 << 62 for b in BANDS])
        for lo, hi in zip(cuts, cuts[1:]):
            mine = (t >= lo) & (t < hi)
            if mine.any():
                tt, kk = t[mine], k[mine]
                theta = max(1, int(threshold(size, sizes[[tt.min(), tt.max()]], percent).min()) - 1)
                heads = np.flatnonzero(np.append(True, kk[1:] != kk[:-1]))
                if len(heads) >= theta:
                    plain = tt.tolist()
                    found += divide_skip([plain[a:b] for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(plain)])], theta)
        if not found:
            continue
        hit, c = np.array([x for x, _ in found]), np.array([x for _, x in found])
        fine = c >= threshold(size, sizes[hit], percent)
        hit, c = hit[fine], c[fine]
        if not len(hit):
            continue
        total += len(hit)
        met.add(int(q_id[q]))
        met.update(ids[hit].tolist())
        best = np.lexsort((ids[hit], -c / np.maximum(sizes[hit], size)))[:most]
        out_a += [int(q_id[q])] * len(best)
        out_b += ids[hit[best]].tolist()
    return out_a, out_b, total, met


def _candidates(sets: DataFrame, comp: DataFrame, percent: int, most: int | None, task_entries: int, bins: int) -> DataFrame | None:
    """(a, b, total, met): queries and sets of other components that occur together in enough indexed lists; None if no list is open.

    Only the ``most`` likeliest of each query come out. Other rows have the number of
    all candidates, and the ids that they hold, once a task.
    """
    sized = comp.join(comp.groupBy("component").agg(F.count("*").alias("w")), "component").select(F.col("node").alias("doc"), "component", "w")
    rows = sets.join(sized, "doc", "left").select("key", "doc", "n", F.coalesce("component", "doc").alias("comp"), F.coalesce("w", F.lit(1)).alias("w"))
    rows = cut(rows, "entries")
    # Of two components the smaller asks: in each open list all but the largest one's sets are queries.
    rank = F.struct("w", "comp")
    some = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("f"), F.max(rank).alias("top")).where("x < y").select("key", "f", "top")
    opened = cut(lane_join(rows, some, ["key"], ["doc"]), "open")
    spent(rows)
    asks = opened.where(rank < F.col("top"))
    queries = cut(asks.groupBy("doc", "n", "comp", "w").agg(F.collect_list("key").alias("keys"), F.sum("f").alias("work"), F.min("key").alias("lead")), "queries")
    total = queries.agg(F.sum("work"), F.max("work")).first()
    if not total[0]:
        return None
    shards = -(-total[1] // task_entries)
    share = shards * task_entries
    bins = max(bins, -(-total[0] // share))
    # Queries of one least member, likely ones that share many lists, share a bin and so a copy of those, a piece at a time.
    own = queries.groupBy("lead").agg(F.ceil(F.sum("work") / F.lit(float(share))).cast("int").alias("pieces"))
    dealt = lane_join(queries, own, ["lead"], ["doc"])
    piece = F.pmod(F.xxhash64("doc"), F.col("pieces"))
    dealt = cut(dealt.select("doc", "n", "comp", "w", "keys", F.pmod(F.xxhash64("lead", piece), F.lit(bins)).cast("int").alias("bin")), "dealt")
    need = dealt.select("bin", F.explode("keys").alias("key")).distinct()
    shard = F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int").alias("shard")
    left = lane_join(opened.select("key", "doc", "n", "comp", "w"), need, ["key"], ["doc"]).select("bin", shard, "key", "doc", "n", "comp", "w")
    right = dealt.select(F.col("bin").alias("to"), F.explode(F.sequence(F.lit(0), F.lit(int(shards) - 1))).alias("part"), "doc", "n", "comp", "w", "keys")

    def run(lists: pa.Table, asked: pa.Table) -> pa.Table:
        claim("jaccard_join")
        a, b, all_of, met = _search(lists, asked, percent, most)
        ids = [*[None] * len(a), *sorted(met)]
        more = [None] * len(met)
        return pa.table({"a": pa.array([*a, *more], pa.int64()), "b": pa.array([*b, *more], pa.int64()), "total": pa.array([all_of, *[0] * (len(ids) - 1)] if ids else [], pa.int64()), "met": pa.array(ids, pa.int64())})

    found = cut(left.groupBy("bin", "shard").cogroup(right.groupBy("to", "part")).applyInArrow(run, "a bigint, b bigint, total bigint, met bigint"), "pairs")
    spent(opened, queries, dealt)
    return found


def link(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT, bits: int = SKETCH_BITS, run_rows: int = RUN_ROWS, task_entries: int = TASK_ENTRIES, bins: int = LEAST_BINS, tries: tuple[int, ...] = TRIES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable by links). The numbers after ``percent`` deal the work out and change no result."""
    spark = docs.sparkSession
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    survey = cut(_survey(src, width, bits), "survey")
    members = survey.where("chunk is null").select("doc_id", "n", "f1", "f2")
    classes = members.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top"))
    # Copies point at their class's representative; an id that repeats with other texts ties those classes together.
    same_id = members.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    tied = members.join(same_id, "doc_id").join(classes, ["f1", "f2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")

    counts = spark.sparkContext.broadcast(sketch(survey, bits))  # 2**bits counters: a fixed bound
    rows = _short_rows(src.where("text is not null"), counts, width, percent, bits, run_rows)
    lists = cut(_merge_lists(rows), "lists")
    reps = classes.where("rep is not null").select("f1", "n", "rep")
    named = cut(
        lists.join(reps.withColumn("n", F.col("n").cast("int")), ["f1", "n"])
        .join(reps.select(F.col("f1").alias("lead"), F.col("n").cast("int").alias("lead_n"), F.col("rep").alias("leader")), ["lead", "lead_n"])
        .select("key", "salt", F.col("rep").alias("doc"), "n", "leader", "lead_n"),
        "short",
    )
    spent(lists)
    sets = cut(named.select("key", "doc", "n").distinct(), "sets")
    fits = f"100 * least(n, lead_n) >= {percent} * greatest(n, lead_n)"
    # Leaders of one list's salts meet at the least of them.
    heads = named.where("salt > 0 and doc = leader").select("key", "doc", "n")
    chief = heads.groupBy("key").agg(F.min(F.struct("n", "doc")).alias("x")).select("key", F.col("x.doc").alias("leader"), F.col("x.n").alias("lead_n"))
    star = named.select("doc", "n", "leader", "lead_n").union(heads.join(chief, "key").select("doc", "n", "leader", "lead_n"))
    t = F.expr(f"({percent} * (n + lead_n) + {100 + percent} - 1) div {100 + percent} - ({percent} * greatest(n, lead_n) + 99) div 100 + 1")
    star = star.where(f"doc <> leader and {fits}").groupBy("doc", "leader").agg(F.count("*").alias("c"), F.max(t).alias("t"))
    # Each set's likeliest leader, if likely at all: one probe a set, so a group of copies costs its size.
    star = star.where(F.col("c") >= F.col("t")).groupBy("doc").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader"))
    pairs = cut(star.select(F.col("doc").alias("a"), F.col("leader").alias("b")), "star")
    arrays = _arrays(src, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")), width)
    links = cut(_probe(pairs, arrays, percent), "probed")
    comp = cut(components(links.union(tied)), "components")
    spent(links, named, pairs, arrays)
    arrays = None

    # The first turns try each query's likeliest candidates, which merges most components; the last tries all that are left.
    for most in (*tries, None):
        found = _candidates(sets, comp, percent, most, task_entries, bins)
        if found is None:
            break
        counted = found.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count("a")).first()
        if arrays is None:  # candidates of later turns are among those of the first
            arrays = _arrays(src, found.select(F.col("met").alias("doc_id")), width)
        pairs = found.where("a is not null").select("a", "b").distinct()
        links = cut(_probe(pairs, arrays, percent), "probed")
        spent(found)
        comp = grow(comp, links)
        if counted[0] <= counted[1]:  # all were probed
            break
    spent(sets)
    if arrays is not None:
        spent(arrays)

    ranked = classes.select("f1", "f2", "n", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component_id"))
    linked = lane_join(members.where("n > 0 and doc_id is not null"), ranked, ["f1", "f2", "n"], ["doc_id"])
    alone = members.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return linked.select(*names).union(alone.select(*names))


def strays(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Ids of documents that are not the representative of their group."""
    return link(docs, id_col, text, width, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(id_col)).distinct()

"""Substring dedup by recompression.

Words covered by a window of ``window`` consecutive words that also starts in a
document of smaller id are removed. Recompression (see ``recompression``) gives
every window an anchor, a symbol in its interior that depends on the
window's words alone; an anchor is named with the words around it that all its
windows share. Names that occur in one document only can't be part of a repeat.

Spark climbs in rounds. In each it names the anchors of the windows that are left, all
over the corpus, and keeps those whose name two documents share: first
symbols of up to 4 words, named with 6 words on either side, which rule out most of all text;
then, for what is left, symbols of up to 8 words with 14 on either side, which
a chance overlap of a phrase doesn't share. Windows around names that are still shared are
verified by a 128-bit hash of their words, and the smallest id of each hash decides.

Shuffles: texts by document, once; sparse anchors (about one for twenty words) by name, shared names by
document, windows around shared anchors by hash. Whole copies are found first, by
their digest, and take no part in the rest. Hot digests, names
and hashes are aggregated before they are shuffled, and joined from the side
with one row for each, so skewed partitions can be split.

Edge cases: a null or empty text has no words and the digest of the empty
string; texts shorter than the window lose nothing; repeats inside one document
lose nothing; rows that repeat an id don't count as smaller, and rows that
repeat id and text get equal results; rows of a null id lose nothing and
make nobody lose anything; a text of any length is hashed whole, in a slice of its own if it
passes a slice's bytes; extra columns are ignored; an empty table gives no
rows. Positions are counted in words of the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, lane_join, mix, slices, words_of
from .recompression import CLIMBS, anchors, context

WINDOW = 50

_FIRST, _SECOND, _AROUND = Rolling(0xA24BAED4963EE407), Rolling(0x9FB21C651E98DF25), Rolling(0xE7037ED1A0B428DB)


def _keys(hashes, bounds, window, limits):
    """Windows' first words, the key of each one's anchor and its row."""
    at, anchor, end, row = anchors(hashes, bounds, window, limits)
    margin = context(limits)
    around = _AROUND.prefix(hashes)
    own = anchor < 0
    start = np.where(own, at, anchor - margin)
    stop = np.where(own, at + window, end + margin)
    key = _AROUND.of(around, start, stop)
    return at, np.where(own, ~key, mix(key ^ (stop - start).astype(np.uint64))), row


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.hash(F.col(f"`{text}`")).alias("th"), F.col(f"`{text}`").alias("text"))


def _among(key, row, rows, lists):
    """Which windows' keys are in their row's list."""
    list_at, flat = lists
    out = np.zeros(len(key), bool)
    edges = np.searchsorted(row, np.arange(rows + 1))
    for r in np.flatnonzero(edges[1:] > edges[:-1]):
        one = slice(edges[r], edges[r + 1])
        out[one] = np.isin(key[one].view(np.int64), flat[list_at[r] : list_at[r + 1]])
    return out


def _lists(column: pa.ListArray, a: int, b: int):
    at = np.asarray(column.offsets)[a : b + 1]
    return at, column.values.to_numpy(zero_copy_only=False)


def anchor_rows(docs: DataFrame, window: int, limits, before=None) -> DataFrame:
    """Distinct (key, doc_id, th) of windows: of all from (doc_id, th, text, copy) without copies; with ``before``, of those from (doc_id, th, text, keys) whose key of that climb is among ``keys`` (null: none)."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int32())])

    def run(batches):
        for batch in batches:
            keep = pc.is_valid(batch.column(3)) if before else pc.and_(pc.is_valid(batch.column(0)), pc.is_null(batch.column(3)))
            batch = batch.filter(keep)
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(batch.column(2)):
                hashes, _, _, bounds = words_of(data, offsets)
                _, key, row = _keys(hashes, bounds, window, limits)
                if not len(key):
                    continue
                if before:
                    left = _among(_keys(hashes, bounds, window, before)[1], row, b - a, _lists(batch.column(3), a, b))
                    key, row = key[left], row[left]
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                key, row = key[new], row[new] + a
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row]), pa.array(ths[row])], schema=schema)

    return docs.mapInArrow(run, "key bigint, doc_id bigint, th int")


def window_rows(docs: DataFrame, window: int, limits) -> DataFrame:
    """From (doc_id, th, text, keys): (h1, h2, doc_id, th, at) of every window whose key of the climb is among ``keys`` (null: none)."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("th", pa.int32()), ("at", pa.int32())])

    def run(batches):
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column(3)))
            ids, ths = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in slices(batch.column(2)):
                hashes, _, _, bounds = words_of(data, offsets)
                at, key, row = _keys(hashes, bounds, window, limits)
                if not len(key):
                    continue
                wanted = _among(key, row, b - a, _lists(batch.column(3), a, b))
                at, row = at[wanted], row[wanted]
                p, q = _FIRST.prefix(hashes), _SECOND.prefix(mix(hashes))
                h1, h2 = _FIRST.of(p, at, at + window), _SECOND.of(q, at, at + window)
                where = (at - bounds[row]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[row + a]), pa.array(ths[row + a]), pa.array(where)], schema=schema)

    return docs.mapInArrow(run, "h1 bigint, h2 bigint, doc_id bigint, th int, at int")


def kept_rows(docs: DataFrame, window: int = WINDOW, text_out: bool = False) -> DataFrame:
    """From (doc_id, th, text, copy, hits): doc_id, n_words, n_removed, kept_sha256 (and kept_text)."""
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    if text_out:
        fields.append(("kept_text", pa.string()))
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            copy, hits = batch.column(3), batch.column(4).to_pylist()
            for a, b, data, offsets in slices(batch.column(2)):
                _, starts, ends, bounds = words_of(data, offsets)
                n, gone, digests, texts = [], [], [], []
                # Words joined by one space: keep each word's bytes and a space after it.
                for r in range(a, b):
                    lo, hi = bounds[r - a], bounds[r - a + 1]
                    s, e = starts[lo:hi], ends[lo:hi]
                    removed = 0
                    if copy[r].is_valid and hi - lo >= window:
                        removed, s, e = int(hi - lo), s[:0], e[:0]
                    elif hits[r]:
                        change = np.zeros(hi - lo + 1, np.int64)
                        at = np.asarray(hits[r], np.int64)
                        np.add.at(change, at, 1)
                        np.add.at(change, at + window, -1)
                        keep = np.cumsum(change)[:-1] == 0
                        removed = int((hi - lo) - keep.sum())
                        s, e = s[keep], e[keep]
                    body = _joined(data, s, e)
                    n.append(int(hi - lo))
                    gone.append(removed)
                    digests.append(hashlib.sha256(body).hexdigest())
                    if text_out:
                        texts.append(body.decode("utf-8"))
                arrays = [ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
                if text_out:
                    arrays.append(pa.array(texts, pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * text_out)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words' bytes joined by one space."""
    if not len(starts):
        return b""
    low, high = int(starts[0]), int(ends[-1])
    change = np.zeros(high - low + 1, np.int8)
    change[starts - low] += 1
    change[ends - low] -= 1
    keep = np.cumsum(change[:-1], dtype=np.int8).astype(bool)
    part = data[low:high].copy()
    glue = ends[:-1] - low
    part[glue] = 32
    keep[glue] = True
    return part[keep].tobytes()


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, text_out: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and kept_text if asked for."""
    climbs = [c for c in CLIMBS if window >= 2 * context(c) + 2 * c[-1]]
    if not climbs:
        raise ValueError(f"a window needs {2 * context(CLIMBS[0]) + 2 * CLIMBS[0][-1]} words at least")
    rows = _keyed(docs, id_col, text)
    # Whole copies of a text with a smaller id lose every word; neither windows nor anchors of theirs are needed.
    # Text goes through one exchange, by id: every join below reads that one again.
    named = rows.where("doc_id is not null and text is not null").select("doc_id", "th", F.md5(F.encode("text", "UTF-8")).alias("m"))
    firsts = named.groupBy("m").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    copies = lane_join(named, firsts, ["m"], ["doc_id"]).where("doc_id > low").select("doc_id", "th", F.lit(True).alias("copy")).distinct()
    rows = rows.join(copies, ["doc_id", "th"], "left").select("doc_id", "th", "text", "copy")
    keys, before = None, None
    for limits in climbs:
        source = rows if keys is None else rows.join(keys, ["doc_id", "th"], "left").select("doc_id", "th", "text", "keys")
        found = anchor_rows(source, window, limits, before)
        shared = found.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("key")
        keys, before = lane_join(found, shared, ["key"], ["doc_id"], 2).groupBy("doc_id", "th").agg(F.collect_set("key").alias("keys")), limits
    wins = window_rows(rows.join(keys, ["doc_id", "th"], "left").select("doc_id", "th", "text", "keys"), window, before)
    first = wins.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    hits = lane_join(wins, first.select("h1", "h2", "low"), ["h1", "h2"], ["doc_id"], 2).where("doc_id > low").select("doc_id", "th", "at").distinct()
    hits = hits.groupBy("doc_id", "th").agg(F.collect_list("at").alias("hits"))
    return kept_rows(rows.join(hits, ["doc_id", "th"], "left").select("doc_id", "th", "text", "copy", "hits"), window, text_out)

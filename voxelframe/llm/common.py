"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these code points: U+0020 and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"

SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder in local mode; on a cluster that is an error."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(sc, "_voxelframe_shared", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="voxelframe-")
        sc._voxelframe_shared = own
    return own


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that outlives executors. :func:`spent` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxelframe_path = path
    return out


def spent(*tables: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``tables``, once everything that reads them is written itself."""
    for df in tables:
        path = getattr(df, "_voxelframe_path", None)
        if path is not None:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


# ---------------------------------------------------------------- what worker processes keep between tasks

_KEPT: dict = {}


def claim(owner: str, release=None) -> None:
    """Called where an operator's work starts in a worker process: drops what other operators keep there. ``release`` drops the owner's own."""
    for name in [k for k in _KEPT if k != owner]:
        _KEPT.pop(name)()
    if release is not None:
        _KEPT[owner] = release


# ---------------------------------------------------------------- words in numpy

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_BYTE_BASE = 0xD6E8FEB86659FD93
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_TABLE[_SPACE] = 0


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                a = np.full(m, b, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_BYTE_POWERS = _Powers(_BYTE_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _MULT
    return x ^ (x >> _U(32))


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yield (first row, last row, utf-8 bytes, row offsets) of runs of rows of at most ``limit`` bytes (one row at least); nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, len(column))
        yield row, last, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def words_of(data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a slice: 64-bit hashes, start and end bytes, and for each row the index of its first word (one more at the end).

    ``fold`` lower-cases A-Z first.
    """
    if fold:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    n = len(data)
    if not n:
        e = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), e, e, np.zeros(len(offsets), np.int64)
    space = _SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | first[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, bounds
    up, down = _BYTE_POWERS.get(n)
    values = _BYTE_TABLE[data]
    values *= up[:n]
    hashes = np.add.reduceat(values, starts)
    hashes *= down[starts]
    return mix(hashes), starts, ends, bounds


class Rolling:
    """Hashes of runs of consecutive words by prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.powers = _Powers(base | 1)

    def prefix(self, hashes: np.ndarray) -> np.ndarray:
        up, _ = self.powers.get(len(hashes) + 1)
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.powers.down[start])


# ---------------------------------------------------------------- joins that skew can't hurt


def lane_join(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], lanes: int = 4, how: str = "inner") -> DataFrame:
    """Join of ``many`` with ``one``, which has one row a key, for keys that may hold a large share of all rows.

    ``many`` is dealt by key and a lane hashed from ``by``; ``one`` is repeated
    for each lane. The deal differs from that of the aggregation that made
    ``one``, so the join reads two exchanges of its own, and adaptive execution
    can split what is still too large.
    """
    left = many.withColumn("__lane", F.pmod(F.xxhash64(*by), F.lit(lanes)).cast("int"))
    right = one.withColumn("__lane", F.explode(F.array(*(F.lit(k) for k in range(lanes)))))
    return left.join(right, [*keys, "__lane"], how).drop("__lane")

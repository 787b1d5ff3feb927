"""NIfTI-1 images as rows, read in parallel by file and written one file an image."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Data types of the format by code.
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER = 348


def parse(raw: bytes) -> tuple[dict, np.ndarray]:
    """(header, values as (t, z, y, x)); stored values are only cast, never scaled."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    end = "<" if struct.unpack("<i", raw[:4])[0] == HEADER else ">"
    dim = struct.unpack(end + "8h", raw[40:56])
    code = struct.unpack(end + "h", raw[70:72])[0]
    if code not in KINDS:
        raise ValueError(f"data type {code} is not supported")
    size = [max(1, d) if k < dim[0] else 1 for k, d in enumerate(dim[1:5])]
    offset = int(struct.unpack(end + "f", raw[108:112])[0])
    values = np.frombuffer(raw, end + KINDS[code], int(np.prod(size)), offset).reshape(size[::-1])
    step = struct.unpack(end + "8f", raw[76:108])
    return {"dim": tuple(size), "voxel": step[1:4], "tr": step[4], "slice_code": raw[122]}, values


def read(spark: SparkSession, path: str) -> DataFrame:
    """(image, x, y, z, t, v) of every image that ``path`` matches; names need .nii or .nii.gz after their first dot."""
    files = spark.read.format("binaryFile").load(path)

    def run(batches):
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                base = name.rsplit("/", 1)[-1]
                if base.partition(".")[2] not in ("nii", "nii.gz"):
                    raise ValueError(f"{base} is no NIfTI name")
                _, a = parse(raw)
                for t in range(a.shape[0]):
                    z, y, x = (g.ravel().astype(np.int32) for g in np.meshgrid(*(np.arange(n) for n in a.shape[1:]), indexing="ij"))
                    yield pd.DataFrame({"image": base, "x": x, "y": y, "z": z, "t": np.int32(t), "v": a[t].ravel().astype(float)})

    return files.select("path", "content").mapInPandas(run, "image string, x int, y int, z int, t int, v double")


def write_file(path: str, a: np.ndarray, voxel=(1.0, 1.0, 1.0), tr: float = 1.0) -> None:
    """One float32 image from (z, y, x) or (t, z, y, x)."""
    a = np.asarray(a, "<f4")
    a4 = a if a.ndim == 4 else a[None]
    t, z, y, x = a4.shape
    head = bytearray(352)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, 4 if t > 1 else 3, x, y, z, t, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1.0, *map(float, voxel), float(tr), 0, 0, 0)
    struct.pack_into("<f", head, 108, 352.0)
    struct.pack_into("<2f", head, 124, float(a4.max(initial=0)), float(a4.min(initial=0)))
    head[344:348] = b"n+1\0"
    data = bytes(head) + a4.tobytes()
    with open(path, "wb") as f:
        f.write(gzip.compress(data) if path.endswith(".gz") else data)


def with_suffix(name: str, suffix: str) -> str:
    """Put ``suffix`` before the first dot."""
    stem, dot, rest = name.partition(".")
    return stem + suffix + dot + rest


def write(df: DataFrame, folder: str, size: tuple[int, int, int, int], voxel=(1.0, 1.0, 1.0), tr: float = 1.0) -> DataFrame:
    """Write each ``image`` of (image, x, y, z, t, v) into a folder that all executors share; returns (image, path)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros(size[::-1], np.float32)
        a[pdf["t"], pdf["z"], pdf["y"], pdf["x"]] = pdf["v"]
        name = pdf["image"].iloc[0]
        path = f"{folder}/{name}" if ".nii" in name else f"{folder}/{name}.nii"
        write_file(path, a, voxel, tr)
        return pd.DataFrame({"image": [name], "path": [path]})

    return df.groupBy("image").applyInPandas(run, "image string, path string")

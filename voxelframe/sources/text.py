"""Readers of small text inputs: designs, contrasts, classes, affines; of event files and event tables of any size."""

from __future__ import annotations

import os
import re
import shutil
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an event file that a task reads, and that it holds at once. The driver reads files of one block, as the other text files.
RANGE, BLOCK = 16 << 20, 1 << 20


def _numbers(path: str, names: tuple[str, ...]) -> tuple[list[int], list[list[float]]]:
    """Leading ``Name count`` lines, then rows of numbers."""
    with open(path) as f:
        lines = [x.split() for x in f if x.strip()]
    head = []
    for name, line in zip(names, lines):
        if line[0] != name:
            raise ValueError(f"{path}: {name} expected, {line[0]} found")
        head.append(int(line[1]))
    return head, [list(map(float, x)) for x in lines[len(names) :]]


def design(path: str, subjects: bool = False) -> np.ndarray:
    head, rows = _numbers(path, ("NumRegressors", "NumSubjects") if subjects else ("NumRegressors",))
    x = np.array(rows)
    if x.shape[1] != head[0] or (subjects and (len(x) != head[1] or head[0] > head[1])):
        raise ValueError(f"{path}: the matrix doesn't have the size that the file names")
    return x


def contrasts(path: str, regressors: int | None = None) -> np.ndarray:
    head, rows = _numbers(path, ("NumRegressors", "NumContrasts"))
    c = np.array(rows)
    if c.shape != (head[1], head[0]) or (regressors is not None and head[0] != regressors):
        raise ValueError(f"{path}: contrasts don't fit the design")
    return c


def _lines(path: str, start: int, stop: int) -> list[list[str]]:
    """Words of the lines that begin in these bytes of a file, ``start`` at least 1. Lines end as :func:`open` has it; blank ones are left out."""
    with open(path, "rb") as f:
        f.seek(start - 1)
        raw = f.read(stop - start + 1)
        end = re.search(rb"[\r\n]", raw)
        raw = raw[end.end() :] if end else b""
        while raw and raw[-1] not in b"\r\n" and (more := f.read(1 << 16)):  # the last line ends beyond
            end = re.search(rb"[\r\n]", more)
            raw += more[: end.end()] if end else more
    return [words for x in raw.decode().replace("\r", "\n").split("\n") if (words := x.split())]


def _event_rows(path: str, start: int, stop: int) -> np.ndarray:
    """Onset, duration and value of the events whose lines begin in these bytes of a file."""
    lines = _lines(path, start, stop)
    for x in lines:
        if len(x) != 3:
            raise ValueError(f"{path}: onset, duration and value expected, {' '.join(x)} found")
    return np.array([list(map(float, x)) for x in lines]).reshape(-1, 3)


def events(spark: SparkSession, path: str) -> DataFrame:
    """(idx, onset, duration, value) of a three-column event file; none for ``NumEvents 0``.

    A file of more than a block is read by the executors, which must mount its folder, in ranges of bytes: at once to check
    it and count each range's events, and again, numbered from there, by what uses the result.
    """
    import pyarrow as pa

    path, schema = os.path.abspath(path), "idx int, onset double, duration double, value double"
    with open(path, "rb") as f:
        head = re.match(rb"\s*([^\r\n]*)", f.read(BLOCK))
    words, body, size = head[1].decode().split(), head.end(), os.path.getsize(path)
    if len(words) < 2 or words[0] != "NumEvents":
        raise ValueError(f"{path}: NumEvents expected, {' '.join(words[:2])} found")

    def check(found: int) -> None:
        if found != int(words[1]):
            raise ValueError(f"{path}: {words[1]} events expected, {found} found")

    if size <= BLOCK:
        rows = _event_rows(path, body, size)
        check(len(rows))
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows.tolist())], schema)

    def blocks(k: int):
        stop = min(body + (k + 1) * RANGE, size)
        for start in range(body + k * RANGE, stop, BLOCK):
            yield _event_rows(path, start, min(start + BLOCK, stop))

    def count(batches):
        for batch in batches:
            for k in batch["id"].to_pylist():
                try:
                    n, wrong = sum(map(len, blocks(k))), None
                except ValueError as e:
                    n, wrong = 0, str(e)
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "n": pa.array([n], pa.int64()), "wrong": pa.array([wrong], pa.string())})

    tasks = -(-(size - body) // RANGE)
    ranges = spark.range(0, tasks, 1, tasks)
    counts = sorted(ranges.mapInArrow(count, "k long, n long, wrong string").collect())  # a row for each 16 MB
    for row in counts:
        if row["wrong"]:
            raise ValueError(row["wrong"])
    first = np.cumsum([0] + [row["n"] for row in counts]).tolist()
    check(first[-1])

    def number(batches):
        for batch in batches:
            for k in batch["id"].to_pylist():
                i = first[k]
                for rows in blocks(k):
                    idx = pa.array(np.arange(i, i + len(rows)), pa.int32())
                    i += len(rows)
                    yield pa.RecordBatch.from_arrays([idx, *(pa.array(c) for c in rows.T.copy())], ["idx", "onset", "duration", "value"])

    return ranges.mapInArrow(number, schema)


def write_events(table: DataFrame, path: str, *order: str) -> None:
    """Events (onset, duration, value) as a file that :func:`events` reads, in the given order. The executors write its parts, in a folder that they must mount; the driver only appends the parts' bytes."""
    path = os.path.abspath(path)
    parts = f"{path}.parts"
    line = F.concat("onset", F.lit(" "), "duration", F.lit(" "), "value")
    table.orderBy(*order).select(F.coalesce(line, F.raise_error(F.lit("an event lacks its onset, duration or value")))).write.mode("overwrite").option("compression", "none").text(f"file://{parts}")
    with open(path, "wb") as out:
        out.write(f"NumEvents {table.sparkSession.read.text(f'file://{parts}').count()}\n".encode())
        for part in sorted(Path(parts).glob("part-*"), key=lambda p: (int(p.name.split("-")[1]), p.name)):
            with open(part, "rb") as f:
                shutil.copyfileobj(f, out, BLOCK)
    shutil.rmtree(parts)


def classes(path: str) -> list[int]:
    """Labels by volume; 9999 is censored."""
    head, rows = _numbers(path, ("NumVolumes",))
    out = [int(x) for r in rows for x in r]
    if len(out) != head[0]:
        raise ValueError(f"{path}: {head[0]} labels expected, {len(out)} found")
    return out


def column(path: str, length: int | None = None) -> np.ndarray:
    """One value a line: raw regressors, slice times in milliseconds."""
    x = np.loadtxt(path, ndmin=1)
    if length is not None and len(x) != length:
        raise ValueError(f"{path}: {length} values expected, {len(x)} found")
    return x


def slice_times(path: str, depth: int, tr: float) -> list[float]:
    ms = column(path, depth)
    if ms.min() < 0 or ms.max() > tr * 1000:
        raise ValueError(f"{path}: times must lie between 0 and TR")
    return (ms / 1000).tolist()


def affine(path: str) -> np.ndarray:
    """12 parameters (less the identity) of a 4 x 4 matrix in rows."""
    from ..operators.registration import from_matrix

    return from_matrix(np.loadtxt(path).reshape(4, 4))


def permutations(path: str, one_based: bool = True, count: int | None = None, subjects: int | None = None) -> np.ndarray:
    """A row of subjects for each permutation; every row must hold each subject once."""
    out = np.loadtxt(path, dtype=int, ndmin=2) - one_based
    n = out.shape[1] if subjects is None else subjects
    if out.shape[1] != n or (count is not None and len(out) != count) or (np.sort(out, axis=1) != np.arange(n)).any():
        raise ValueError(f"{path}: {count or 'rows'} permutations of {n} subjects expected")
    return out


def signs(path: str, count: int | None = None, subjects: int | None = None) -> np.ndarray:
    """A row of 1 and -1 for each permutation."""
    out = np.loadtxt(path, dtype=int, ndmin=2)
    if (np.abs(out) != 1).any() or (count is not None and len(out) != count) or (subjects is not None and out.shape[1] != subjects):
        raise ValueError(f"{path}: {count or 'rows'} rows of {subjects or 'any number of'} signs expected")
    return out


def write_vectors(path: str, table: np.ndarray, one_based: bool = True) -> None:
    """Permutations, counted from 1, or signs, one row a line, as :func:`permutations` and :func:`signs` read them."""
    np.savetxt(path, np.asarray(table) + one_based, fmt="%d")


def regressors(spark: SparkSession, path: str, tr: float, times: int, raw: bool = False) -> np.ndarray:
    """T x R design of a regressor list: ``NumRegressors R``, then R names of event files (a boxcar each) or, if ``raw``, of files with a value a volume; names are relative to the list."""
    from ..operators import design as d

    words = Path(path).read_text().split()
    if len(words) < 2 or words[0] != "NumRegressors" or len(words) - 2 != int(words[1]):
        raise ValueError(f"{path}: NumRegressors and as many file names expected")
    files = [str(Path(path).parent / w) for w in words[2:]]
    return np.column_stack([column(f, times) if raw else d.sampled(d.boxcar(events(spark, f), tr, times, strict=True), times) for f in files])


def raw_floats(spark: SparkSession, path: str, shape: tuple[int, ...]) -> DataFrame:
    """(file, i, v): the 32-bit floats of raw files; each must hold as many as ``shape`` has cells, the first axis running fastest."""
    import pandas as pd

    cells = int(np.prod(shape))

    def run(batches):
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                v = np.frombuffer(raw, "<f4")
                if len(v) != cells:
                    raise ValueError(f"{name}: {cells} floats expected, {len(v)} found")
                at = np.unravel_index(np.arange(cells), shape, order="F")
                yield pd.DataFrame({"file": name.rsplit("/", 1)[-1], **{f"i{k}": a.astype(np.int32) for k, a in enumerate(at)}, "v": v.astype(float)})

    names = ", ".join(f"i{k} int" for k in range(len(shape)))
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, {names}, v double")


def bids_events(spark: SparkSession, path: str, duration: str = "duration", height: str | None = None, only: str | None = None) -> DataFrame:
    """(trial_type, onset, duration, value) of event tables: names without ``/``, spaces as ``_``."""
    df = spark.read.csv(path, sep="\t", header=True)
    name = F.regexp_replace(F.regexp_replace("trial_type", "/", ""), " ", "_")
    value = F.col(height).cast("double") if height else F.lit(1.0)
    out = df.select(name.alias("trial_type"), F.col("onset").cast("double").alias("onset"), F.col(duration).cast("double").alias("duration"), value.alias("value"))
    return out.where(F.col("trial_type") == only) if only else out


def discover_runs(spark: SparkSession, folder: str) -> DataFrame:
    """(subject, task, run, image, events) of a dataset's folder, from file names alone: functional images sub-S[_..]_task-T[_run-R]_bold.nii[.gz], with the event table of the same name if there is one."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract(name, rf"(?:^|_){k}-([A-Za-z0-9]+)", 1)
    key = [part("sub").alias("subject"), part("task").alias("task"), F.when(part("run") == "", "1").otherwise(part("run")).cast("int").alias("run")]
    images = files.where(name.rlike(r"_bold\.nii(\.gz)?$")).select(*key, F.col("path").alias("image"))
    tables = files.where(name.rlike(r"_events\.tsv$")).select(*key, F.col("path").alias("events"))
    return images.join(tables, ["subject", "task", "run"], "left")


def group_copes(copes: DataFrame, subjects: list[str]) -> DataFrame:
    """(x, y, z, t, v): the subjects' copes (subject, x, y, z, v) one after the other, t in the order given."""
    order = F.create_map(*(F.lit(v) for k, s in enumerate(subjects) for v in (s, k)))
    return copes.where(F.col("subject").isin(subjects)).select("x", "y", "z", order[F.col("subject")].alias("t"), "v")


def pad_conditions(events_by_run: DataFrame, runs: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every run with every condition; missing ones have no events (null onset)."""
    return runs.join(conditions, how="cross").join(events_by_run, ["run", "trial_type"], "left")


def concatenate_runs(df: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """Runs one after the other along t."""
    total, offset = 0, []
    for run in sorted(lengths):
        offset += [F.lit(run), F.lit(total)]
        total += lengths[run]
    return df.withColumn("t", F.col("t") + F.create_map(*offset)[F.col("run")])


def output_name(path: str, suffix: str, given: str | None = None) -> str:
    """The input's name with a suffix before its first dot (of the last path part), unless a name is given."""
    if given:
        return given
    folder, slash, name = path.rpartition("/")
    stem, dot, rest = name.partition(".")
    return f"{folder}{slash}{stem}{suffix}{dot}{rest}"


def motion(path: str, times: int | None = None) -> np.ndarray:
    """T x 6 motion regressors."""
    x = np.loadtxt(path, ndmin=2)
    if x.shape[1] != 6 or (times is not None and len(x) != times):
        raise ValueError(f"{path}: {times or 'T'} x 6 values expected, {x.shape} found")
    return x


def matrix_columns(spark: SparkSession, path: str) -> DataFrame:
    """(regressor, t, value) of a design file whose numbers follow a ``/Matrix`` line."""
    with open(path) as f:
        lines = [x.strip() for x in f]
    if "/Matrix" not in lines:
        raise ValueError(f"{path}: no /Matrix line")
    rows = [list(map(float, x.split())) for x in lines[lines.index("/Matrix") + 1 :] if x]
    return spark.createDataFrame([(j, t, v) for t, row in enumerate(rows) for j, v in enumerate(row)], "regressor int, t int, value double")


def design_lines(x: np.ndarray) -> list[str]:
    """A line a volume: six decimals, two spaces after each."""
    return ["".join(f"{v:.6f}  " for v in row) for row in np.atleast_2d(x)]


def write_design(path: str, x: np.ndarray) -> None:
    with open(path, "w") as f:
        f.writelines(line + "\n" for line in design_lines(x))


def write_distribution(null: DataFrame, path: str, value: str = "max_stat") -> None:
    """A null distribution as text, one value a line, in order of its permutations."""
    null.orderBy("p").select(F.col(value).cast("string")).coalesce(1).write.mode("overwrite").text(path)


def displacement(ux: DataFrame, uy: DataFrame, uz: DataFrame) -> DataFrame:
    """(x, y, z, ux, uy, uz) of three volumes of one size."""
    parts = [d.select("x", "y", "z", F.col("v").alias(n)) for d, n in ((ux, "ux"), (uy, "uy"), (uz, "uz"))]
    return parts[0].join(parts[1], ["x", "y", "z"]).join(parts[2], ["x", "y", "z"])


def condition_files(table: DataFrame) -> DataFrame:
    """(run, trial_type, text): the three-column event file of each condition; a condition without events gives ``NumEvents 0``."""
    line = F.concat_ws(" ", *(F.col(c).cast("string") for c in ("onset", "duration", "value")))
    g = table.groupBy("run", "trial_type").agg(F.sort_array(F.collect_list(F.when(F.col("onset").isNotNull(), F.struct("onset", line.alias("l"))))).alias("e"))
    text = F.concat_ws("\n", F.array(F.concat(F.lit("NumEvents "), F.size("e").cast("string"))), F.transform("e", lambda s: s["l"]))
    return g.select("run", "trial_type", text.alias("text"))

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.plans.files import QUERIES, SQL
from voxelframe.sources import nifti, text


def test_nifti_round_trip(spark, tmp_path):
    a = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    for name in ("v.nii", "v.nii.gz"):
        nifti.write_file(str(tmp_path / name), a, (1, 1, 2), 2.0)
        head, back = nifti.parse((tmp_path / name).read_bytes())
        assert head["dim"][:4] == (4, 3, 2, 1) and np.array_equal(back[0], a)
    got = nifti.read(spark, str(tmp_path / "v.nii"))
    assert got.count() == 24 and got.where("x = 3 and y = 2 and z = 1").first()["v"] == 23


def test_text_formats(spark, tmp_path):
    (tmp_path / "e.txt").write_text("NumEvents 2\n0 1 1\n5.5 2 3\n")
    assert text.events(spark, str(tmp_path / "e.txt")).count() == 2
    (tmp_path / "d.txt").write_text("NumRegressors 2\n1 0\n1 1\n1 2\n")
    assert text.design(str(tmp_path / "d.txt")).shape == (3, 2)
    (tmp_path / "c.txt").write_text("NumRegressors 2\nNumContrasts 1\n0 1\n")
    assert text.contrasts(str(tmp_path / "c.txt"), 2).tolist() == [[0, 1]]
    (tmp_path / "m.txt").write_text("1 0 0 2\n0 1 0 3\n0 0 1 4\n0 0 0 1\n")
    assert text.affine(str(tmp_path / "m.txt"))[:3].tolist() == [2, 3, 4]
    (tmp_path / "b.tsv").write_text("onset\tduration\ttrial_type\n1\t2\tgo/left hand\n3\t2\tstop\n")
    assert {r.trial_type for r in text.bids_events(spark, str(tmp_path / "b.tsv")).collect()} == {"goleft_hand", "stop"}


def test_event_file_past_the_driver(spark, tmp_path):
    """s7_events on a file of three blocks: the driver holds none of its 200,000 events."""
    i = F.col("id") * 7919 % 200_000  # ids in no order
    ts = F.timestamp_seconds(1_704_067_200 + i * 37)
    spark.range(0, 200_000, 1, 5).select(i.alias("event_id"), ts.alias("ts"), F.lit("view").alias("event_type")).write.parquet(f"{tmp_path}/events.parquet")
    tracemalloc.start()
    try:
        got = QUERIES["s7_events"](spark, str(tmp_path))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 8e6
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(SQL["s7_events"]).df().sort_values("idx", ignore_index=True)
    assert got.toPandas().sort_values("idx", ignore_index=True).equals(want[got.columns])


def test_event_file_in_ranges(spark, tmp_path, monkeypatch):
    """Every cut of a file gives each line once, whatever ends it; the executors number them as the driver does."""
    rows = [(k * 1.5, float(k % 3), 10.0 ** (k % 40 - 20)) for k in range(60)]
    ends = ["\n", "\r\n", "\r", "\n\n", " \n\t\n\u00a0\r\n"]
    body = "".join(f"{'  ' * (k % 2)}{a}\t{b!r} \u00a0{c!r}{ends[k // 3 % 5] if k < 59 else ''}" for k, (a, b, c) in enumerate(rows))
    at = tmp_path / "e.txt"
    at.write_bytes(f"\n \r\nNumEvents {len(rows)} \r{body}".encode())
    start, size = at.read_bytes().index(b"60") + 3, at.stat().st_size
    for step in (*range(1, 60), 1000, size):
        got = [x for k in range(start, size, step) for x in text._event_rows(str(at), k, min(k + step, size)).tolist()]
        assert list(map(tuple, got)) == rows
    assert sorted(map(tuple, text.events(spark, str(at)).collect())) == [(k, *x) for k, x in enumerate(rows)]
    monkeypatch.setattr(text, "BLOCK", 50)
    monkeypatch.setattr(text, "RANGE", 170)
    assert [tuple(x) for x in text.events(spark, str(at)).collect()] == [(k, *x) for k, x in enumerate(rows)]
    for wrong, why in ((f"NumEvents 61\n{body}", "61 events expected, 60 found"), (f"NumEvents 61\n{body}\n1 2\n", "1 2 found"), (f"NumEvents 61\n{body}\n1 2 x\n", "x"), (body, "NumEvents expected"), ("", "NumEvents expected")):
        at.write_text(wrong)
        with pytest.raises(ValueError, match=why):
            text.events(spark, str(at))


def test_written_event_file(spark, tmp_path):
    events = spark.createDataFrame([(k, k / 3, float(k % 5), 1e300 * k) for k in range(40)], "k int, onset double, duration double, value double").repartition(7)
    at = tmp_path / "e.txt"
    text.write_events(events, str(at), "k")
    assert at.read_text().startswith("NumEvents 40\n0.0 0.0 0.0\n") and not (tmp_path / "e.txt.parts").exists()
    assert sorted(map(tuple, text.events(spark, str(at)).collect())) == sorted(map(tuple, events.collect()))
    text.write_events(events.where("k < 0"), str(at), "k")
    assert at.read_text() == "NumEvents 0\n" and text.events(spark, str(at)).count() == 0
    with pytest.raises(Exception, match="an event lacks"):
        text.write_events(events.withColumn("value", F.expr("nullif(value, 0)")), str(at), "k")

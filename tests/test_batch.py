"""The whole batch, plug-ins and images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise import config
from lanewise.operators import images, plugins
from lanewise.plans import batch


def test_batch(spark, tmp_path):
    rows, reads = [], []
    for clip, shift in ((60, 0.0), (61, 0.0)):
        for i, y in enumerate([1000.0, 1100.0, 1250.0, 1350.0]):
            rows.append((f"c({clip}).mp4", 7, i * 0.4 + shift + (320.0 if clip == 60 else 1.0), 900.0, y, "car"))
            rows.append((f"c({clip}).mp4", 8, i * 0.4, 2200.0, 800.0 + i, "car"))
        reads += [(f"c({clip}).mp4", 7, k, "PCW2492", 0.9, 0.8, 0.9) for k in range(2)]
    points = spark.createDataFrame(rows, "clip_id string, track_id bigint, t_s double, x double, y double, vehicle_class string")
    readings = spark.createDataFrame(reads, "clip_id string, track_id bigint, ord int, text string, ocr_conf double, det_conf double, plate_score double")
    clips = spark.createDataFrame([(f"c({k}).mp4", f"/v/c({k}).mp4", k) for k in (60, 61)], "clip_id string, path string, clip_order int")
    found = batch.run(spark, points, readings, clips, str(tmp_path / "s"), "R1", 1).orderBy("event_timestamp").collect()
    assert [(r.event_id, r.direction, r.plate_status) for r in found] == [("EVT_(61)_0007_1", "ENTRADA", "OK"), ("EVT_(60)_0007_320", "ENTRADA", "OK")]
    assert {r.event_id: r.duplicate_of for r in found}["EVT_(61)_0007_1"] == "EVT_(60)_0007_320"
    assert [r.datetime_str for r in found] == ["2026-09-09 16:22:47", "2026-09-09 16:22:36"]
    again = batch.run(spark, points, readings, clips, str(tmp_path / "s"), "R2", 2)
    assert {r.processing_run_id for r in again.collect()} == {"R1"}
    redone = batch.run(spark, points, readings, clips, str(tmp_path / "s"), "R3", 3, resume=False)
    assert {r.processing_run_id for r in redone.collect()} == {"R3"} and redone.count() == 2


def test_batch_reads_changed_files_again(spark, tmp_path):
    points = spark.createDataFrame([("c(1).mp4", 7, 0.4 * i, 900.0, y, "car") for i, y in enumerate([1000.0, 1100.0, 1250.0, 1350.0])] + [("c(2).mp4", 3, 1.0, 500.0, 700.0, "car")], "clip_id string, track_id bigint, t_s double, x double, y double, vehicle_class string")
    readings = spark.createDataFrame([("c(1).mp4", 7, k, "PCW2492", 0.9, 0.8, 0.9) for k in range(2)] + [("c(1).mp4", 7, 5, "AB", 0.1, 0.1, 0.1)], "clip_id string, track_id bigint, ord int, text string, ocr_conf double, det_conf double, plate_score double")
    clips = lambda h, status: spark.createDataFrame([("c(1).mp4", "/v/c(1).mp4", 1, h, None), ("c(2).mp4", "/v/c(2).mp4", 2, "x", status)], "clip_id string, path string, clip_order int, file_hash string, status string")
    out = str(tmp_path / "s")
    go = lambda h, run, n, status="CORRUPTED": batch.run(spark, points, readings, clips(h, status), out, run, n, rejections=f"{out}/rejected").collect()
    (row,) = go("a", "R1", 1)
    assert row.processing_run_id == "R1" and "PCW2492" in row.ocr_votes
    assert go("a", "R2", 2)[0].processing_run_id == "R1"  # same content
    assert go("b", "R3", 3)[0].processing_run_id == "R3"  # changed
    state = {r.clip_id: r.status for r in batch.store.read(spark, f"{out}/clips", ["clip_id"]).collect()}
    assert state == {"c(1).mp4": "COMPLETED", "c(2).mp4": "CORRUPTED"}
    go("b", "R4", 4, None)
    assert {r.reason for r in spark.read.json(f"{out}/rejected").collect()} == {"track_never_crossed"}


def test_plugins(spark):
    frames = spark.createDataFrame([("c", 1), ("c", 2)], "clip_id string, frame_idx int")

    def broken():
        raise OSError("no device")

    def plain():
        return lambda pdf: [[(0.0, 0.0, 1.0, 1.0, 0.9, 2)] * int(i) for i in pdf.frame_idx]

    found = plugins.detect(frames, [broken, plain], ["clip_id", "frame_idx"]).orderBy("frame_idx", "det_idx").collect()
    assert [(r.frame_idx, r.det_idx, r.error) for r in found] == [(1, 0, None), (2, 0, None), (2, 1, None)]

    def failing():
        def model(pdf):
            raise ValueError("bad batch")

        return model

    assert {r.error for r in plugins.detect(frames, [failing], ["clip_id", "frame_idx"]).collect()} == {"ValueError: bad batch"}
    with pytest.raises(RuntimeError):
        plugins.first_loaded([broken])
    status = spark.createDataFrame([(None,), ("corrupt header",), ("boom",)], "error string")
    assert [r.status for r in plugins.failed_clips(status).collect()] == ["COMPLETED", "CORRUPTED", "FAILED: boom"]


def test_images(spark):
    image = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    box = images.letterboxed(image, 10, 10)
    assert box.shape == (10, 10, 3) and not box[0].any() and box[5].any()
    assert images.contact_sheet([image] * 3, 2, 4, 5).shape == (8, 10, 3)
    assert len(images.shrunk_nv12(bytes(8 * 8 * 3 // 2), 8, 8, 4, 4)) == 24
    rows = spark.createDataFrame([(image.tobytes(), 4, 5), (None, 0, 0)], "p binary, h int, w int")
    back = rows.select(images.as_png(F.col("p"), F.col("h"), F.col("w")).alias("b")).collect()
    assert bytes(back[0].b[:8]) == b"\x89PNG\r\n\x1a\n" and back[1].b is None


def test_settings(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("cooldown_seconds: 25\nother: 1\n")
    s = config.load(str(path))
    assert (s.cooldown_seconds, s.extra, s.history) == (25, {"other": 1}, 50) and s.key != config.DEFAULT.key

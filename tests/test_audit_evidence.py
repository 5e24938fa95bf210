"""Matching by clip and id, audits, fusion figures, pictures, and streams against windows."""

import random
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import fusion, images, matching, vision
from lanewise.sources import files, store, workbook
from lanewise.streaming import windows as live


def test_unknown_clips_meet_any(spark):
    rng = random.Random(5)
    clips = ["1", "2", None]
    left = [(k, float(rng.randrange(60)), rng.choice(clips)) for k in range(60)]
    right = [(k, float(rng.randrange(60)), rng.choice(clips)) for k in range(40)]
    got = matching.nearest_by_clip(
        spark.createDataFrame(left, "k int, a double, clip string"), spark.createDataFrame(right, "g int, b double, clip string"), "k", "a", "b", 3.0, "g"
    )
    want = {}
    for k, a, c in left:
        near = [(abs(a - b), g) for g, b, d in right if abs(a - b) <= 3 and (c is None or d is None or c == d)]
        want[k] = min(near)[1] if near else None
    assert {r.k: r.g for r in got.collect()} == want


def test_event_ids_name_clip_and_second(spark):
    events = spark.createDataFrame([("EVT_(60)_0023_27",), ("EVT_(61)_0001_27",), ("EVT_cam_1_27",), ("EVT_(60)_0001_100",)], "event_id string")
    truth = spark.createDataFrame([(0, 30.0, "cam(60).mp4"), (1, 24.0, "cam(60)(61).mp4"), (2, 115.0, "cam(60).mp4")], "gt_idx int, gt_s double, video_source string")
    got = {r.event_id: r.gt_idx for r in matching.by_event_id(events, truth, "event_id").collect()}
    assert got == {"EVT_(60)_0023_27": 0, "EVT_(61)_0001_27": 1, "EVT_cam_1_27": None, "EVT_(60)_0001_100": None}


def test_dataset_of_candidates(spark, tmp_path):
    m = spark.createDataFrame([("EVT_(1)_1_5", 0, 5.0), ("EVT_(1)_1_5", 1, 5.0), ("EVT_(2)_1_5", 0, 5.0), (None, 0, None)], "event_id string, candidate_idx int, timestamp double")
    t = spark.createDataFrame([(0, "GT1", "c(1).mp4", 9.0, "ABC1234", None, "Azuay", "bus")], "pos int, ground_truth_id string, video_source string, approx_timestamp double, plate_text string, plate_legible boolean, province string, vehicle_type string")
    got = matching.labelled(m, t, "pos")
    rows = {(r.event_id, r.candidate_idx): (r.ground_truth_plate, r.plate_legible, r.vehicle_type) for r in got.collect()}
    assert rows == {("EVT_(1)_1_5", 0): ("ABC1234", True, "bus"), ("EVT_(1)_1_5", 1): ("ABC1234", True, "bus"), ("EVT_(2)_1_5", 0): (None, False, None), (None, 0): (None, False, None)}
    store.write_records(got, str(tmp_path / "set"))
    assert "null" in "".join(p.read_text() for p in (tmp_path / "set").glob("*.json"))
    assert files.manifest(spark, str(tmp_path / "set"), lines=True).count() == 4


def test_audit_log(spark):
    cells = lambda plate, t: [plate, "car", None, None, t, None, None, None, "2", "note", None, None, None]
    rows = spark.createDataFrame([(2, cells(" abc1234 ", "9:05")), (3, cells(None, "9:5:7")), (4, cells("", "")), (5, cells("X", "25:00")), (6, cells("Y", "soon"))], "row_idx int, cells array<string>")
    assert {r.row_idx: (r.plate, r.cam2_s) for r in files.audit_log(rows).collect()} == {2: ("ABC1234", 32700), 3: (None, 32707), 5: ("X", None), 6: ("Y", None)}


def test_audit_outside_windows(spark):
    audit = spark.createDataFrame([(1, "ABC1234", 10.0), (2, "XYZ9876", 500.0), (3, "QQQ1111", None), (4, "ZZZ0000", 20.0)], "audit_idx int, audit_plate string, audit_s double")
    events = spark.createDataFrame([(7, "ABC1234", 12.0), (8, "XYZ9876", 500.0)], "evt_idx int, event_plate string, event_s double")
    windows = spark.createDataFrame([(0, 0.0, 100.0)], "win_idx int, win_start double, win_end double")
    report = matching.audit_report(audit, events, windows, 5.0, 100.0)
    got = {r.audit_idx: (r.win_idx, r.evt_idx, r.reason) for r in report.collect()}
    assert got == {1: (0, 7, None), 2: (None, None, "no cubierta por clips actuales"), 3: (None, None, "Sin hora en Cam 2"), 4: (0, None, None)}
    assert tuple(matching.audit_recall(report).first()) == (2, 1, 50.0, 2)
    assert tuple(matching.audit_recall(report.limit(0)).first()) == (0, 0, 0.0, 0)


def test_matrix_has_every_cell(spark):
    reads = [(m, e, o, p, 0.9, 1.0) for m in "xy" for e, p in ((1, "PAA1234"), (2, "GBB1234")) for o in range(4)]
    truth = spark.createDataFrame([(1, "PAA-1234", True), (2, "PBB1234", None), (3, "GGG1111", True)], "event_id int, plate string, legible boolean")
    found = fusion.matrix(spark.createDataFrame(reads, "model string, event_id int, ord int, text string, ocr_conf double, plate_score double"), truth, "event_id", "ord")
    rows = found.collect()
    assert len(rows) == 2 * 3 * 2 * 4
    assert {(r.exact_match_pct, r.char_acc_pct, r.pos0_acc_pct, r.evaluated_events) for r in rows} == {(50.0, 92.9, 50.0, 2)}
    assert [r.model for r in fusion.best(found, 15).collect()] == ["x"] * 15


def test_largest_crops(spark):
    rows = spark.createDataFrame([("a", k, s) for k, s in enumerate(["10x2", "3x3", "4x5", "bad", None, "100x1"])], "t string, k int, s string")
    assert [r.k for r in fusion.largest_crops(rows, ["t"], "s", ["k"], 3).orderBy("place").collect()] == [5, 0, 2]


def test_difference_of_channels(spark):
    a, b = np.zeros((2, 2, 3), np.uint8), np.zeros((2, 2, 3), np.uint8)
    b[..., 2] = 6
    row = spark.createDataFrame([(a.tobytes(), b.tobytes(), 2, 2)], "a binary, b binary, h int, w int").select(vision.difference(*[F.col(c) for c in "abhw"]).alias("d")).first().d
    assert (row.mae, row.mae_b, row.mae_g, row.mae_r) == (2.0, 0.0, 0.0, 6.0)


def test_evidence_files_and_workbook(spark, tmp_path):
    pixels = bytes(range(12)) * 4
    rows = spark.createDataFrame([("E1", pixels, 4, 4, pixels[:12], 2, 2), ("E2", pixels, 4, 4, None, None, None)], "event_id string, vehicle_pixels binary, vehicle_h int, vehicle_w int, plate_pixels binary, plate_h int, plate_w int")
    folder = f"file://{tmp_path}/shots"
    got = {r.event_id: (r.vehicle_crop_path, r.plate_crop_path) for r in images.write_evidence(rows, folder).collect()}
    assert got == {"E1": (f"{folder}/E1_veh.png", f"{folder}/E1_plate.png"), "E2": (f"{folder}/E2_veh.png", None)}
    assert sorted(p.name for p in (tmp_path / "shots").iterdir()) == ["E1_plate.png", "E1_veh.png", "E2_veh.png"]
    events = spark.createDataFrame(
        [("E1", "R", None, 1.0), ("E2", "R", "E1", 2.0)], "event_id string, processing_run_id string, duplicate_of string, event_timestamp double"
    ).withColumns({c: F.lit(None).cast("string") for c in ("datetime_str", "direction", "vehicle_type", "plate_raw", "plate_corrected", "plate_status", "ocr_votes", "plate_correction_reason", "video_source")})
    book = str(tmp_path / "r.xlsx")
    assert len(workbook.export(events.withColumn("confidence_ocr", F.lit(0.5)), book, images.evidence(rows))) == 2
    assert sorted(workbook.extract(book, str(tmp_path / "back"))) == ["E1_plate.png", "E1_veh.png", "E2_veh.png"]
    for name in ("E1_plate.png", "E1_veh.png", "E2_veh.png"):
        assert (tmp_path / "back" / name).read_bytes() == (tmp_path / "shots" / name).read_bytes()
    with zipfile.ZipFile(book) as z:
        assert "Foto Veh" in z.read("xl/worksheets/sheet1.xml").decode()


def test_too_many_pictures(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MAX_PICTURES", 3)
    shots = spark.createDataFrame([("E1", b"1234", None)], "event_id string, vehicle_png binary, plate_png binary")
    with pytest.raises(ValueError, match="pictures"):
        workbook._held(shots, [type("R", (), {"event_id": "E1"})()])


def test_stream_in_windows(spark, tmp_path):
    rng = random.Random(3)
    rows = spark.createDataFrame([(k, rng.uniform(-50, 1100) if k % 9 else None) for k in range(200)], "k int, at double")
    windows = spark.createDataFrame([(k, 100.0 * k, 100.0 * k + rng.choice([40.0, 130.0])) for k in range(10)], "win_idx int, win_start double, win_end double")
    src = str(tmp_path / "in")
    rows.repartition(5).write.parquet(src)
    stream = live.in_windows(live.files(spark, src, rows.schema, most=2), windows, "at", 5.0, 130.0)
    q = stream.writeStream.format("memory").queryName("placed_rows").option("checkpointLocation", str(Path(tmp_path) / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert len({p["batchId"] for p in q.recentProgress if p["numInputRows"]}) >= 3
    got = {r.k: r.win_idx for r in spark.table("placed_rows").collect()}
    want = {r.k: r.win_idx for r in matching.in_windows(rows, windows, "at", 5.0, 130.0).collect()}
    assert got == want and any(v is not None for v in got.values())

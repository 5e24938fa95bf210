"""Files, workbook, images, and streams against their batch forms."""

import json
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import tracks, vision
from lanewise.sources import files, store, workbook
from lanewise.streaming import tracks as live


def _box(kind, size=16):
    return struct.pack(">I4s", size, kind) + b"\0" * (size - 8)


def test_container_walk():
    assert files.box_walk(_box(b"ftyp") + _box(b"mdat") + _box(b"moov"))
    assert not files.box_walk(_box(b"ftyp") + _box(b"mdat"))
    assert not files.box_walk(b"short")
    wide = struct.pack(">I4sQ", 1, b"mdat", 24) + b"\0" * 8
    assert files.box_walk(wide + _box(b"moov"))


def test_video_files(spark, tmp_path):
    for name in ("cam(10).mp4", "cam(9).mp4", "sub/b.avi", "x.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(_box(b"ftyp") + (_box(b"moov") if "9" in name else b""))
    found = files.work_list(files.video_files(spark, str(tmp_path)))
    assert [r.path.rsplit("/", 1)[-1] for r in found.collect()] == ["cam(9).mp4", "cam(10).mp4", "b.avi"]
    assert files.work_list(files.video_files(spark, str(tmp_path)), [10], 1).count() == 1
    rows = spark.read.format("binaryFile").load(str(tmp_path / "*.mp4"))
    ok = rows.select("path", files.playable(F.col("path"), F.col("content")).alias("ok")).collect()
    assert {r.path[-8:]: r.ok for r in ok} == {"m(9).mp4": True, "(10).mp4": False}


def test_probe(spark):
    text = json.dumps({"streams": [{"codec_name": "h264", "width": 2960, "height": 1664, "avg_frame_rate": "0/0", "r_frame_rate": "50/2", "duration": "10.0"}]})
    row = spark.createDataFrame([(text,), ("{}",)], "p string").select(*[c.alias(k) for k, c in files.probe_fields(F.col("p")).items()]).collect()
    assert (row[0].codec, row[0].width, row[0].fps, row[0].total_frames) == ("h264", 2960, 25.0, 250)
    assert (row[1].fps, row[1].total_frames) == (25.0, 0)


def test_workbook_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.xlsx")
    workbook.write(path, {"One": (["Placa", "Tipo", "x", "h1", "h2"], [("pba-1234", None, 1, "12:45:30", "08:20"), (None, "bus", 2, None, None), ("XBA12", "truck", 3, "bad", None)])})
    rows = files.audit_sheet(files.workbook_rows(spark, path).where("row_idx > 1")).orderBy("row_idx").collect()
    assert [(r.plate_text, r.vehicle_type, r.time_cam1, r.time_cam2, r.province) for r in rows] == [
        ("PBA1234", "car", "12:45:30", "08:20:00", "Pichincha"), ("XBA12", "truck", None, None, "Cotopaxi")
    ]


def test_report_export(spark, tmp_path):
    rows = [("E1", "R", 1.0, "2024-01-01 00:00:01", "ENTRADA", "car", "PCW2492", "PCW2492", "OK", 0.99, "[]", "ok", "v.mp4", None), ("E2", "R", 2.0, "2024-01-01 00:00:02", "ENTRADA", "car", "PCW2492", "PCW2492", "OK", 0.99, "[]", "ok", "v.mp4", "E1")]
    events = spark.createDataFrame(rows, "event_id string, processing_run_id string, event_timestamp double, datetime_str string, direction string, vehicle_type string, plate_raw string, plate_corrected string, plate_status string, confidence_ocr double, ocr_votes string, plate_correction_reason string, video_source string, duplicate_of string")
    path = str(tmp_path / "r.xlsx")
    assert workbook.export(events, path) == list(workbook.SHEETS)
    assert workbook.export(events.where("duplicate_of is null"), path) == [workbook.SHEETS[0]]
    with zipfile.ZipFile(path) as z:
        assert b"PCW2492" in z.read("xl/worksheets/sheet1.xml")


def test_frames_source(spark, tmp_path):
    a = tmp_path / "a.raw"
    a.write_bytes(bytes(range(12)) * 3 + b"xx")
    spark.dataSource.register(files.FramesSource)
    rows = spark.read.format("frames").options(paths=str(a), height=2, width=2, fps=10).load().orderBy("frame_idx").collect()
    assert [(r.clip_id, r.frame_idx, r.t_s) for r in rows] == [("a.raw", 0, 0.0), ("a.raw", 1, 0.1), ("a.raw", 2, 0.2)]


def test_rejections(spark, tmp_path):
    a = spark.createDataFrame([("c", 1.0)], "clip_id string, timestamp double")
    b = spark.createDataFrame([("c", 2.0, 7)], "clip_id string, timestamp double, track_id int")
    store.write_rejections(str(tmp_path / "r"), parked_curb_filter=a, track_never_crossed=b)
    assert spark.read.json(str(tmp_path / "r")).groupBy("reason").count().count() == 2
    with pytest.raises(ValueError):
        store.rejections(other=a)


def test_images(spark):
    flat, noisy = np.full((72, 128, 3), 200, np.uint8), np.random.default_rng(1).integers(0, 256, (72, 128, 3), np.uint8)
    bright = np.full((72, 128, 3), 255, np.uint8)
    rows = spark.createDataFrame([(k, i.tobytes(), 72, 128) for k, i in enumerate([flat, noisy, bright])] + [(3, None, 0, 0)], "k int, p binary, h int, w int")
    args = (F.col("p"), F.col("h"), F.col("w"))
    got = rows.select("k", vision.sharpness(*args).alias("s"), vision.overexposure(*args).alias("o"), vision.histogram(*args).alias("hist")).orderBy("k").collect()
    assert got[0].s == 0 and got[1].s > 1000 and got[3].s == 0 and (got[0].o, got[2].o, got[3].o) == (0.0, 1.0, 1.0)
    assert sum(got[1].hist) == 72 * 128 and got[3].hist is None
    moved = rows.select(vision.motion(F.col("p"), F.lit(flat.tobytes()), F.col("h"), F.col("w")).alias("m")).collect()
    assert [r.m for r in moved] == [False, True, True, False]
    nv12 = np.concatenate([np.full(72 * 128, 100, np.uint8), np.full(72 * 64, 128, np.uint8)])
    back = spark.createDataFrame([(nv12.tobytes(), 72, 128)], "p binary, h int, w int").select(vision.nv12_to_bgr(*args).alias("b")).first().b
    assert set(back) == {100} and len(back) == 72 * 128 * 3
    same = rows.where("k < 2").select(vision.difference(F.col("p"), F.lit(flat.tobytes()), F.col("h"), F.col("w")).alias("d")).collect()
    assert same[0].d.mae == 0 and same[1].d.rmse > 10


def test_clock(spark):
    rng = np.random.default_rng(2)
    digits = {str(d): (rng.random((20, 12)) > 0.5).astype(np.uint8) * 255 for d in range(10)}
    text = "20240102030405"
    image = np.concatenate([digits[c] for c in text], axis=1)
    slots = [(12 * k, 0, 12, 20) for k in range(14)]
    rows = spark.createDataFrame([(image.tobytes(), 20, 168), (np.zeros((20, 168), np.uint8).tobytes(), 20, 168)], "p binary, h int, w int")
    read = rows.select(vision.clock_digits(F.col("p"), F.col("h"), F.col("w"), digits, slots).alias("t"))
    found = read.select("t", vision.clock_time(F.col("t")).alias("at")).collect()
    assert (found[0].t, str(found[0]["at"])) == (text, "2024-01-02 03:04:05") and found[1].t is None and found[1]["at"] is None


def _points(spark):
    rng, rows = np.random.default_rng(3), []
    for t in range(40):
        y = 1100.0
        for i in range(8):
            rows.append((1, t, float(t + i * 0.5), float(rng.uniform(500, 2000)), y))
            y += float(rng.choice([-60.0, -10.0, 15.0, 40.0, 80.0]))
    return spark.createDataFrame(rows, "clip_id int, track_id bigint, t_s double, x double, y double").withColumn("at", F.timestamp_micros((F.col("t_s") * 1e6).cast("bigint") + 1_700_000_000_000_000))


def test_stream_crossings_equal_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    points = _points(spark).cache()
    path = tmp_path / "in"
    for k in range(3):  # three batches cut every track
        points.where(F.expr(f"pmod(cast(floor(t_s * 2) as int) - track_id * 2, 8) between {3 * k} and {3 * k + 2}")).coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    query = live.crossings(stream.select("clip_id", "track_id", "at", "t_s", "x", "y"), "1 hour").writeStream.format("memory").queryName("crossed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = {(r.track_id, r.direction, r.crossing_s) for r in spark.table("crossed").where("state = 'COMMITTED'").collect()}
    batch = tracks.crossings(points, ["clip_id", "track_id"], ["t_s"]).where("state = 'COMMITTED'")
    assert found == {(r.track_id, r.direction, r.crossing_s) for r in batch.collect()} and found


def test_stream_counts_and_first_plates(spark, tmp_path):
    rows = [("car", 1.0, "P1", "IN", k) for k in range(10)] + [("bus", 2.0, "P1", "IN", 5)]
    frame = spark.createDataFrame(rows, "event_type string, value double, plate string, direction string, s int").withColumn("at", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    frame.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    for name, rows_ in (("windows", live.counts(source(), "1 second", "5 seconds")), ("firsts", live.first_plates(source()))):
        mode = "complete" if name == "windows" else "append"
        rows_.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(60)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 11
    assert spark.table("firsts").count() == 1


def test_stream_sampling_equals_batch(spark, tmp_path):
    from lanewise.operators import sampling

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = np.random.default_rng(5)
    rows = [(c, k, k * 0.13, bool(rng.random() < 0.2), bool(rng.random() < 0.1)) for c in (1, 2) for k in range(120)]
    frames = spark.createDataFrame(rows, live.FRAME)
    for k in range(3):
        frames.where(f"frame_idx div 40 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.sampled(stream).writeStream.format("memory").queryName("gate").trigger(availableNow=True).start().awaitTermination(120)
    batch = sampling.adaptive_sampling(frames.withColumn("frame_idx", F.col("frame_idx").cast("int")))
    key = lambda rows_: sorted((r.clip_id, r.frame_idx, r.state, r.run) for r in rows_)
    assert key(spark.table("gate").collect()) == key(batch.collect())

"""The camera's relations, derived from the provided tables by fixed rules.

events stand for track points and plate readings, lineitem for detections, readings and stage times, orders for clips,
audit entries and ground truth.  Every rule is one expression that any SQL engine can repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"
WEEK = 604_800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts: str):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{EPOCH}', {ts}) / 1e6").cast("double")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, track_id, event_id, t_s, x, y, vehicle_class): a user's week is a track of that week's clip."""
    k = F.get_json_object("props", "$.k").cast("int")
    t = _seconds("ts")
    return table(spark, sf_dir, "events").select(
        F.floor(t / WEEK).cast("int").alias("clip_id"),
        F.col("user_id").alias("track_id"),
        "event_id",
        t.alias("t_s"),
        (F.lit(400.0) + F.lit(18.0) * k.cast("double")).alias("x"),
        (F.lit(1000.0) + F.least(F.lit(4.0) * F.col("value"), F.lit(600.0))).alias("y"),
        F.expr("case event_type when 'click' then 'car' when 'view' then 'truck' when 'purchase' then 'bus' else 'motorcycle' end").alias("vehicle_class"),
        k.alias("k"),
        "value",
    )


def plate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, t_s, direction, plate, ocr_conf, raw): one reading for each event, with confused characters and gaps;
    time is compressed so that the cooldown is full of events."""
    events = table(spark, sf_dir, "events")
    n = events.agg(F.count("*").alias("n")).first().n
    k = F.get_json_object("props", "$.k").cast("int")
    letter = lambda m: F.char(F.lit(65) + F.pmod(F.col("user_id") * m, F.lit(26)))
    plate = F.concat(letter(1), letter(7), letter(11), F.lpad(F.pmod(F.col("user_id") * 37, F.lit(10000)).cast("string"), 4, "0"))
    read = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 10 == 1, F.translate(plate, "OISBZGA", "0158264")).otherwise(plate)
    return events.select(
        "event_id",
        (_seconds("ts") / 30.0 * (n / 10000.0)).alias("t_s"),
        F.when(F.col("value") >= 50, "ENTRADA").otherwise("SALIDA").alias("direction"),
        read.alias("plate"),
        (F.lit(0.60) + (k % 40).cast("double") / 100.0).alias("ocr_conf"),
        plate.alias("true_plate"),
        k.alias("k"),
        "user_id",
        "event_type",
    )


def readings(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """(event_id, ord, text, ocr_conf, det_conf, plate_score): an order is an event, its lines are readings of one
    plate, some with a wrong character.  Placed ones also tell where they stand: (file, row)."""
    i = F.col("l_linenumber")
    seed = F.col("l_orderkey")
    letter = lambda m: F.char(F.lit(65) + F.pmod(seed * m, F.lit(26)))
    plate = F.concat(letter(3), letter(5), letter(9), F.lpad(F.pmod(seed * 37, F.lit(10000)).cast("string"), 4, "0"))
    wrong = F.when(F.pmod(F.col("l_partkey"), F.lit(5)) == 0, F.translate(plate, "0158264", "OISBZGA")).when(
        F.pmod(F.col("l_partkey"), F.lit(7)) == 0, F.concat(F.substring(plate, 1, 6), F.pmod(F.col("l_partkey"), F.lit(10)).cast("string"))
    ).when(F.pmod(F.col("l_partkey"), F.lit(11)) == 0, F.lit("CHEVROLET")).otherwise(plate)
    return table(spark, sf_dir, "lineitem").select(
        seed.alias("event_id"),
        i.cast("int").alias("ord"),
        wrong.alias("text"),
        (F.lit(0.55) + F.pmod(F.col("l_suppkey"), F.lit(45)).cast("double") / 100.0).alias("ocr_conf"),
        (F.lit(0.40) + F.pmod(F.col("l_partkey"), F.lit(60)).cast("double") / 100.0).alias("det_conf"),
        (F.lit(0.20) + F.pmod(F.col("l_partkey"), F.lit(80)).cast("double") / 100.0).alias("plate_score"),
        *([F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")] if placed else []),
    )


def order_plates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, plate): the true plates behind readings()."""
    k = F.col("o_orderkey")
    letter = lambda m: F.char(F.lit(65) + F.pmod(k * m, F.lit(26)))
    plate = F.concat(letter(3), letter(5), letter(9), F.lpad(F.pmod(k * 37, F.lit(10000)).cast("string"), 4, "0"))
    return table(spark, sf_dir, "orders").select(k.alias("event_id"), plate.alias("plate"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, det_idx, x1, y1, x2, y2, conf, class_id, sharpness): an order is a frame, its lines are detections in
    the crop."""
    p, q = F.col("l_partkey"), F.col("l_suppkey")
    x1 = F.pmod(p * 13, F.lit(2000)).cast("double") + F.pmod(q, F.lit(10)).cast("double") / 10.0
    y1 = F.pmod(p * 7, F.lit(800)).cast("double") + 0.5
    w, h = (F.lit(30) + F.pmod(q * 11, F.lit(270))).cast("double"), (F.lit(20) + F.pmod(q * 17, F.lit(240))).cast("double")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("frame_id"),
        F.col("l_linenumber").cast("int").alias("det_idx"),
        x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"),
        (F.lit(0.25) + F.pmod(p * 3 + q, F.lit(75)).cast("double") / 100.0).alias("conf"),
        F.pmod(p + q, F.lit(9)).cast("int").alias("class_id"),
        F.pmod(p * 31, F.lit(900)).cast("double").alias("sharpness"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """processed_clips: an order is a clip of the run that its customer stands for."""
    k = F.col("o_orderkey")
    part = lambda m, n, d: (F.pmod(k * m, F.lit(n)).cast("double") / F.lit(float(d)))
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Camara_20240101("), k.cast("string"), F.lit(").mp4")).alias("clip_id"),
        F.concat(F.lit("RUN_"), F.pmod(F.col("o_custkey"), F.lit(50)).cast("string")).alias("run_id"),
        (F.lit(300.0) + part(7, 600, 10)).alias("duration_sec"),
        (F.lit(6000) + F.pmod(k * 11, F.lit(3000))).cast("bigint").alias("total_frames"),
        F.pmod(k, F.lit(9)).cast("bigint").alias("processed_events"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "CORRUPTED").otherwise("FAILED: x").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        (F.lit(20.0) + part(13, 400, 10)).alias("wall_clock_seconds"),
        part(17, 300, 10).alias("decode_seconds"),
        part(19, 200, 10).alias("vehicle_detection_seconds"),
        part(23, 90, 10).alias("staging_seconds"),
        part(29, 50, 10).alias("file_hash_seconds"),
        part(31, 30, 10).alias("clock_read_seconds"),
        k.alias("clip_no"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """processing_runs: (run_id, started_at, status), one for each run that has clips."""
    return clips(spark, sf_dir).groupBy("run_id").agg(
        F.max("started_at").alias("started_at"), F.max("status").alias("status"), F.count("*").alias("total_videos")
    )


def store_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finished event table of the readings of events; every eighth event repeats the one before it."""
    e = plate_events(spark, sf_dir)
    return e.select(
        F.concat(F.lit("EVT_"), F.col("event_id").cast("string")).alias("event_id"),
        F.concat(F.lit("RUN_"), F.pmod(F.col("user_id"), F.lit(10)).cast("string")).alias("processing_run_id"),
        F.concat(F.lit("Camara("), F.pmod(F.col("user_id"), F.lit(20)).cast("string"), F.lit(").mp4")).alias("video_source"),
        F.round("t_s", 3).alias("event_timestamp"),
        F.date_format(F.expr(f"timestampadd(SECOND, cast(floor(t_s) as bigint), timestamp_ntz'{EPOCH}')"), "yyyy-MM-dd HH:mm:ss").alias("datetime_str"),
        "direction",
        F.expr("case event_type when 'click' then 'car' when 'view' then 'truck' when 'purchase' then 'bus' else 'motorcycle' end").alias("vehicle_type"),
        F.col("plate").alias("plate_raw"),
        "ocr_conf",
        F.when(F.pmod(F.col("event_id"), F.lit(8)) == 0, F.concat(F.lit("EVT_"), (F.col("event_id") - 1).cast("string"))).alias("duplicate_of"),
        F.pmod(F.col("k"), F.lit(3)).alias("n_votes"),
        "true_plate",
        "user_id",
    )


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(audit_idx, audit_plate, audit_s): what a person noted for each event, some seconds off, now and then with a wrong
    character."""
    e = plate_events(spark, sf_dir)
    wrong = F.concat(F.substring("true_plate", 1, 5), F.lit("77"))
    return e.select(
        F.col("event_id").alias("audit_idx"),
        F.when(F.pmod(F.col("event_id"), F.lit(15)) == 0, wrong).otherwise(F.col("true_plate")).alias("audit_plate"),
        (F.col("t_s") + F.pmod(F.col("event_id") * 13, F.lit(61)).cast("double") - 30.0).alias("audit_s"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, gt_idx, gt_s, direction, plate, legible): the events as ground truth of their videos, some seconds late."""
    e = plate_events(spark, sf_dir)
    return e.select(
        F.pmod(F.col("user_id"), F.lit(20)).cast("string").alias("video"),
        F.col("event_id").alias("gt_idx"),
        (F.col("t_s") + F.pmod(F.col("event_id"), F.lit(9)).cast("double")).alias("gt_s"),
        "direction",
        F.when(F.pmod(F.col("event_id"), F.lit(4)) != 1, F.col("true_plate")).alias("plate"),
        (F.pmod(F.col("event_id"), F.lit(3)) != 0).alias("legible"),
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video, det_idx, det_s, direction, plate): the events as a run found them."""
    e = plate_events(spark, sf_dir)
    return e.select(
        F.pmod(F.col("user_id"), F.lit(20)).cast("string").alias("video"),
        F.col("event_id").alias("det_idx"),
        F.col("t_s").alias("det_s"),
        "direction",
        "plate",
    )

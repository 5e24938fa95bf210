"""The relations of lanewise.sources.bridge as SQL common table expressions."""

from __future__ import annotations

T = "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6::DOUBLE"
KIND = "CASE event_type WHEN 'click' THEN 'car' WHEN 'view' THEN 'truck' WHEN 'purchase' THEN 'bus' ELSE 'motorcycle' END"


def _letter(key: str, m: int) -> str:
    return f"chr((65 + ({key} * {m}) % 26)::INT)"


def _plate(key: str, a: int, b: int, c: int) -> str:
    return f"{_letter(key, a)} || {_letter(key, b)} || {_letter(key, c)} || lpad((({key} * 37) % 10000)::VARCHAR, 4, '0')"


RELATIONS = {
    "points": f"""
      SELECT floor({T} / 604800)::INT AS clip_id, user_id AS track_id, event_id, {T} AS t_s,
             400.0::DOUBLE + 18.0::DOUBLE * (json_extract(props, '$.k')::INT)::DOUBLE AS x,
             1000.0::DOUBLE + least(4.0::DOUBLE * value, 600.0::DOUBLE) AS y,
             {KIND} AS vehicle_class, json_extract(props, '$.k')::INT AS k, value
      FROM events""",
    "plate_events": f"""
      SELECT event_id, {T} / 30.0::DOUBLE * ((SELECT count(*) FROM events)::DOUBLE / 10000.0::DOUBLE) AS t_s,
             CASE WHEN value >= 50 THEN 'ENTRADA' ELSE 'SALIDA' END AS direction,
             CASE WHEN k % 7 = 0 THEN NULL WHEN k % 10 = 1 THEN translate(true_plate, 'OISBZGA', '0158264') ELSE true_plate END AS plate,
             0.60::DOUBLE + (k % 40)::DOUBLE / 100.0::DOUBLE AS ocr_conf, true_plate, k, user_id, event_type
      FROM (SELECT *, json_extract(props, '$.k')::INT AS k, {_plate("user_id", 1, 7, 11)} AS true_plate FROM events)""",
    "readings": f"""
      SELECT l_orderkey AS event_id, l_linenumber::INT AS ord,
             CASE WHEN l_partkey % 5 = 0 THEN translate(p, '0158264', 'OISBZGA')
                  WHEN l_partkey % 7 = 0 THEN substr(p, 1, 6) || (l_partkey % 10)::VARCHAR
                  WHEN l_partkey % 11 = 0 THEN 'CHEVROLET' ELSE p END AS text,
             0.55::DOUBLE + (l_suppkey % 45)::DOUBLE / 100.0::DOUBLE AS ocr_conf,
             0.40::DOUBLE + (l_partkey % 60)::DOUBLE / 100.0::DOUBLE AS det_conf,
             0.20::DOUBLE + (l_partkey % 80)::DOUBLE / 100.0::DOUBLE AS plate_score
      FROM (SELECT *, {_plate("l_orderkey", 3, 5, 9)} AS p FROM lineitem)""",
    "order_plates": f"""SELECT o_orderkey AS event_id, {_plate("o_orderkey", 3, 5, 9)} AS plate FROM orders""",
    "named_detections": """
      SELECT *, 'EVT_' || CASE WHEN det_idx % 41 <> 0 THEN '(' || video || ')' ELSE 'cam' END || '_' || det_idx::VARCHAR || '_' || floor(det_s)::BIGINT::VARCHAR AS event_id,
             CASE WHEN det_idx % 41 <> 0 THEN video END AS clip FROM detections""",
    "named_truth": """SELECT *, CASE WHEN gt_idx % 37 <> 0 THEN video END AS clip FROM truth""",
    "boxes": """
      SELECT frame_id, det_idx, x1, y1, x1 + w AS x2, y1 + h AS y2, conf, class_id, sharpness FROM (
        SELECT l_orderkey AS frame_id, l_linenumber::INT AS det_idx,
               ((l_partkey * 13) % 2000)::DOUBLE + (l_suppkey % 10)::DOUBLE / 10.0::DOUBLE AS x1,
               ((l_partkey * 7) % 800)::DOUBLE + 0.5::DOUBLE AS y1,
               (30 + (l_suppkey * 11) % 270)::DOUBLE AS w, (20 + (l_suppkey * 17) % 240)::DOUBLE AS h,
               0.25::DOUBLE + ((l_partkey * 3 + l_suppkey) % 75)::DOUBLE / 100.0::DOUBLE AS conf,
               ((l_partkey + l_suppkey) % 9)::INT AS class_id, ((l_partkey * 31) % 900)::DOUBLE AS sharpness
        FROM lineitem)""",
    "clips": """
      SELECT 'Camara_20240101(' || o_orderkey::VARCHAR || ').mp4' AS clip_id, 'RUN_' || (o_custkey % 50)::VARCHAR AS run_id,
             300.0::DOUBLE + ((o_orderkey * 7) % 600)::DOUBLE / 10.0::DOUBLE AS duration_sec,
             (6000 + (o_orderkey * 11) % 3000)::BIGINT AS total_frames, (o_orderkey % 9)::BIGINT AS processed_events,
             CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'CORRUPTED' ELSE 'FAILED: x' END AS status,
             strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS started_at,
             20.0::DOUBLE + ((o_orderkey * 13) % 400)::DOUBLE / 10.0::DOUBLE AS wall_clock_seconds,
             ((o_orderkey * 17) % 300)::DOUBLE / 10.0::DOUBLE AS decode_seconds,
             ((o_orderkey * 19) % 200)::DOUBLE / 10.0::DOUBLE AS vehicle_detection_seconds,
             ((o_orderkey * 23) % 90)::DOUBLE / 10.0::DOUBLE AS staging_seconds,
             ((o_orderkey * 29) % 50)::DOUBLE / 10.0::DOUBLE AS file_hash_seconds,
             ((o_orderkey * 31) % 30)::DOUBLE / 10.0::DOUBLE AS clock_read_seconds, o_orderkey AS clip_no
      FROM orders""",
    "runs": "SELECT run_id, max(started_at) AS started_at, max(status) AS status, count(*) AS total_videos FROM clips GROUP BY run_id",
    "store_events": f"""
      SELECT 'EVT_' || event_id::VARCHAR AS event_id, 'RUN_' || (user_id % 10)::VARCHAR AS processing_run_id,
             'Camara(' || (user_id % 20)::VARCHAR || ').mp4' AS video_source, round(t_s, 3) AS event_timestamp,
             strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(floor(t_s)::BIGINT), '%Y-%m-%d %H:%M:%S') AS datetime_str, direction,
             {KIND} AS vehicle_type, plate AS plate_raw, ocr_conf,
             CASE WHEN event_id % 8 = 0 THEN 'EVT_' || (event_id - 1)::VARCHAR END AS duplicate_of, k % 3 AS n_votes, true_plate, user_id
      FROM plate_events""",
    "audit": """
      SELECT event_id AS audit_idx, CASE WHEN event_id % 15 = 0 THEN substr(true_plate, 1, 5) || '77' ELSE true_plate END AS audit_plate,
             t_s + ((event_id * 13) % 61)::DOUBLE - 30.0::DOUBLE AS audit_s
      FROM plate_events""",
    "truth": """
      SELECT (user_id % 20)::VARCHAR AS video, event_id AS gt_idx, t_s + (event_id % 9)::DOUBLE AS gt_s, direction,
             CASE WHEN event_id % 4 <> 1 THEN true_plate END AS plate, event_id % 3 <> 0 AS legible
      FROM plate_events""",
    "detections": """
      SELECT (user_id % 20)::VARCHAR AS video, event_id AS det_idx, t_s AS det_s, direction, plate
      FROM plate_events""",
}
_NEEDS = {
    "runs": ["clips"], "store_events": ["plate_events"], "audit": ["plate_events"], "truth": ["plate_events"], "detections": ["plate_events"],
    "named_detections": ["plate_events", "detections"], "named_truth": ["plate_events", "truth"],
}


def with_relations(sql: str, *names: str, recursive: bool = False, then: str = "") -> str:
    """A query over the named relations; `then` holds more common table expressions."""
    order: list[str] = []
    for n in names:
        order += [x for x in (*_NEEDS.get(n, []), n) if x not in order]
    parts = [f"{n} AS MATERIALIZED ({RELATIONS[n]})" for n in order] + ([then] if then else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {sql}"

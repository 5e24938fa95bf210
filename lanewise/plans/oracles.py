"""The queries of lanewise.plans.queries as SQL for DuckDB, over the same relations."""

from __future__ import annotations

from ..config import DEFAULT
from ..functions import plates as p
from .bridge_sql import with_relations as rel

D = "::DOUBLE"
_X1, _Y1, _X2, _Y2 = 400.0, 1200.0, 2250.0, 1200.0
CROSS = "(1850.0::DOUBLE * (y - 1200.0::DOUBLE) - 0.0::DOUBLE * (x - 400.0::DOUBLE))"
PCROSS = "(1850.0::DOUBLE * (py - 1200.0::DOUBLE) - 0.0::DOUBLE * (px - 400.0::DOUBLE))"


def _left(ax, ay, bx, by, cx, cy) -> str:
    return f"(({cy} - {ay}) * ({bx} - {ax}) > ({by} - {ay}) * ({cx} - {ax}))"


def _meets(ax, ay, bx, by, x1, y1, x2, y2) -> str:
    a, b = _left(ax, ay, x1, y1, x2, y2), _left(bx, by, x1, y1, x2, y2)
    c, d = _left(ax, ay, bx, by, x1, y1), _left(ax, ay, bx, by, x2, y2)
    return f"({a} <> {b} AND {c} <> {d})"


MEETS = _meets("px", "py", "x", "y", *(f"{v}::DOUBLE" for v in (_X1, _Y1, _X2, _Y2)))


def _fsm(source: str, by: str) -> str:
    """CTEs stepped, marked and crossed over a relation of points."""
    return f"""
    stepped AS (SELECT *, row_number() OVER w - 1 AS i, {CROSS} >= 0 AS side, abs({CROSS}) / 1850.0::DOUBLE AS dist,
                       lag(x) OVER w AS px, lag(y) OVER w AS py
                FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY t_s, event_id)),
    marked AS (SELECT *, min(CASE WHEN i >= 1 AND (side <> ({PCROSS} >= 0) OR {MEETS}) THEN i END) OVER (PARTITION BY {by}) AS c FROM stepped),
    settled AS (SELECT *, min(CASE WHEN i > c AND (dist > 20 OR i >= 3) THEN i END) OVER (PARTITION BY {by}) AS m FROM marked),
    crossed AS (
      SELECT {by}, count(*) AS n_points, max(CASE WHEN i = 0 THEN y END) AS y0,
             max(CASE WHEN i = c THEN t_s END) AS crossing_s, max(CASE WHEN i = c THEN y END) AS crossing_y,
             max(CASE WHEN i = c THEN (side OR y > py)::INT END) AS up, max(CASE WHEN i = m THEN y END) AS ym,
             max(CASE WHEN i = m THEN t_s END) AS committed_s, max((dist < 180)::INT) AS near, max(c) AS c, max(m) AS m
      FROM settled GROUP BY {by}),
    fsm AS (
      SELECT *, CASE WHEN m IS NOT NULL THEN 'COMMITTED' WHEN c IS NOT NULL THEN 'CROSSED' WHEN near = 1 THEN 'APPROACHING' ELSE 'OUTSIDE' END AS state,
             CASE WHEN m IS NOT NULL AND abs(ym - y0) > 30 THEN CASE WHEN ym > y0 THEN 'ENTRADA' ELSE 'SALIDA' END
                  WHEN c IS NOT NULL THEN CASE WHEN up = 1 THEN 'ENTRADA' ELSE 'SALIDA' END END AS direction
      FROM crossed)"""


TRACK_FSM = _fsm("points", "clip_id, track_id")

F1 = [f"trunc({c} + {o}.0::DOUBLE)::INT" for c, o in (("x1", 300), ("y1", 600), ("x2", 300), ("y2", 600))]


def _polygon(x: str, y: str) -> str:
    poly = DEFAULT.polygon
    odd, edge = [], []
    for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1], strict=True):
        if y1 != y2:
            odd.append(f"({y} >= {min(y1, y2)} AND {y} < {max(y1, y2)} AND {x} < {x1}.0::DOUBLE + ({y} - {y1}) * {x2 - x1}.0::DOUBLE / {y2 - y1}.0::DOUBLE)::INT")
        edge.append(f"(({x} - {x1}) * ({y2 - y1}) = ({y} - {y1}) * ({x2 - x1}) AND {x} BETWEEN {min(x1, x2)} AND {max(x1, x2)} AND {y} BETWEEN {min(y1, y2)} AND {max(y1, y2)})")
    return f"(({' + '.join(odd)}) % 2 = 1 OR {' OR '.join(edge)})"


FRAMED = f"framed AS (SELECT frame_id, det_idx, {', '.join(f'{e} AS f{c}' for e, c in zip(F1, ('x1', 'y1', 'x2', 'y2'), strict=True))} FROM boxes)"
INSIDE = _polygon("floor((fx1 + fx2) / 2.0::DOUBLE)", "fy2::DOUBLE")
PARKED = "(fx2 <= 460 AND fy2 > 1200)"

VEHICLE_SCORE = """CASE WHEN (x2 - x1) * (y2 - y1) > 0 THEN greatest(0.0::DOUBLE,
  0.35::DOUBLE * least(1.0::DOUBLE, sharpness / 400.0::DOUBLE) + 0.35::DOUBLE * least(1.0::DOUBLE, (x2 - x1) * (y2 - y1) / 160000.0::DOUBLE)
  + 0.20::DOUBLE * conf - 0.10::DOUBLE * (CASE WHEN least(x1, y1, 2300 - x2, 1064 - y2) > 30.0 THEN 0.0::DOUBLE
  ELSE 1 - least(x1, y1, 2300 - x2, 1064 - y2) / 30.0::DOUBLE END)) ELSE 0.0::DOUBLE END"""
_R = "((x2 - x1) / (y2 - y1))"
PLATE_SCORE = f"""greatest(0.0::DOUBLE, 0.10::DOUBLE * conf + 0.40::DOUBLE * least(1.0::DOUBLE, (x2 - x1) * (y2 - y1) / 6050.0::DOUBLE)
  + 0.35::DOUBLE * least(1.0::DOUBLE, sharpness * 10 / 6500.0::DOUBLE)
  + 0.10::DOUBLE * (CASE WHEN {_R} BETWEEN 1.4::DOUBLE AND 2.8::DOUBLE OR {_R} BETWEEN 0.85::DOUBLE AND 1.35::DOUBLE THEN 1.0::DOUBLE
    WHEN ({_R} >= 1.2::DOUBLE AND {_R} < 1.4::DOUBLE) OR ({_R} > 2.8::DOUBLE AND {_R} <= 3.4::DOUBLE) THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END)
  - 0.05::DOUBLE * ((frame_id % 10) / 10.0::DOUBLE))"""

RAW = """raw AS (SELECT *, CASE (event_id + ord) % 9
    WHEN 6 THEN NULL WHEN 0 THEN substr(text, 1, 3) || '-' || substr(text, 4, 9) WHEN 1 THEN '  ' || lower(text) || ' '
    WHEN 2 THEN substr(text, 1, 6) WHEN 3 THEN substr(text, 1, 2) WHEN 4 THEN '---' WHEN 5 THEN substr(text, 1, 2) || substr(text, 4, 4)
    ELSE text END AS raw FROM readings)"""


def _norm(c: str) -> str:
    return f"nullif(upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g')), '')"


def _digits(c: str) -> str:
    return f"translate({c}, '{p.LETTERS}', '{p.AS_DIGITS}')"


def _letters(c: str) -> str:
    return f"translate({c}, '{p.DIGITS}', '{p.AS_LETTERS}')"


def _moto(n: str) -> str:
    return f"(length({n}) = 6 AND regexp_matches({n}, '^[A-Z]{{2}}[0-9]'))"


def _correct(n: str) -> str:
    return f"""CASE WHEN length({n}) < 4 THEN {n}
      WHEN {_moto(n)} THEN {_letters(f"substr({n}, 1, 2)")} || {_digits(f"substr({n}, 3, 3)")} || {_letters(f"substr({n}, 6, 1)")}
      WHEN length({n}) IN (6, 7) THEN {_letters(f"substr({n}, 1, 3)")} || {_digits(f"substr({n}, 4, 4)")} ELSE {n} END"""


def _standard(c: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{x}')" for x in (p.CAR, p.MOTORCYCLE, p.OTHER)) + ")"


def _n_digits(c: str) -> str:
    return f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"


def _no_plate(c: str) -> str:
    return f"(length({c}) NOT BETWEEN 5 AND 8 OR NOT regexp_matches({c}, '[A-Z]') OR {_n_digits(c)} < 2 OR regexp_matches({c}, '^[A-Z]{{4,}}'))"


def _plausible(c: str) -> str:
    return f"coalesce(length({c}) BETWEEN 5 AND 8 AND regexp_matches({c}, '[A-Za-z]') AND {_n_digits(c)} >= 2 AND NOT regexp_matches({c}, '^[A-Z]{{4,}}'), false)"


def _status(raw: str, norm: str, fixed: str, conf: str, review: str) -> str:
    return f"""CASE WHEN {raw} IS NULL OR trim({raw}) = '' THEN '{p.MISSING}' WHEN {norm} IS NULL OR length({norm}) < 4 THEN '{p.LOW}'
      WHEN {_no_plate(fixed)} OR {review} THEN '{p.REVIEW}' WHEN {_standard(fixed)} AND {conf} >= 0.80::DOUBLE THEN '{p.OK}'
      WHEN {_standard(fixed)} AND {conf} >= 0.70::DOUBLE THEN '{p.REVIEW}' WHEN {conf} < 0.70::DOUBLE THEN '{p.LOW}' ELSE '{p.REVIEW}' END"""


PROVINCE_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in p.PROVINCES.items()) + "}"


def _reasons(norm: str, fixed: str, conf: str, review: str) -> str:
    changed = f"""list_transform(list_filter(range(0, 7), lambda i: i < length({norm}) AND substr({norm}, i + 1, 1) <> substr({fixed}, i + 1, 1)),
      lambda i: (CASE WHEN {_moto(norm)} THEN 'moto_pos_' ELSE 'pos_' END) || i::VARCHAR || ': ' || substr({norm}, i + 1, 1) || '->' || substr({fixed}, i + 1, 1))"""
    shown = f"printf('%.2f', {conf})"
    last = f"""CASE WHEN {_no_plate(fixed)} THEN '{p.NOT_A_PLATE}' WHEN {review} THEN '{p.AMBIGUOUS}'
      WHEN {_standard(fixed)} AND {conf} >= 0.80::DOUBLE THEN NULL
      WHEN {_standard(fixed)} AND {conf} >= 0.70::DOUBLE THEN 'Lectura con confianza moderada (' || {shown} || '): requiere verificación manual'
      WHEN {conf} < 0.70::DOUBLE THEN 'Baja confianza de OCR (' || {shown} || ' < 0.70)' ELSE '{p.ODD_FORMAT}' END"""
    parts = f"list_concat({changed}, list_filter(['Provincia: ' || {PROVINCE_MAP}[substr({fixed}, 1, 1)], {last}], lambda z: z IS NOT NULL))"
    return f"""CASE WHEN {norm} IS NULL THEN NULL WHEN length({norm}) < 4 THEN '{p.TOO_SHORT}'
      WHEN len({parts}) > 0 THEN array_to_string({parts}, '; ') ELSE '{p.UNCHANGED}' END"""


FIXED = f"{RAW}, norm AS (SELECT *, {_norm('raw')} AS norm FROM raw), fixed AS (SELECT *, {_correct('norm')} AS fixed FROM norm)"
_SAME = """coalesce(a <> '' AND b <> '' AND (a = b OR (length(a) >= 6 AND length(b) >= 6 AND (levenshtein(a, b) <= 1 OR contains(b, a) OR contains(a, b)
   OR (right(a, 4) = right(b, 4) AND abs(length(a) - length(b)) <= 1)))), false)"""
AUDIT_EVENTS = "ae AS (SELECT event_id AS evt_idx, plate AS event_plate, t_s AS event_s FROM plate_events)"
PAIRS = f"""{AUDIT_EVENTS}, pairs AS (
   SELECT audit_idx, evt_idx, CASE WHEN event_plate IS NULL THEN 2 WHEN levenshtein(audit_plate, event_plate) = 0 THEN 0 WHEN levenshtein(audit_plate, event_plate) <= 2 THEN 1 END AS tier,
          levenshtein(audit_plate, event_plate) AS d, abs(audit_s - event_s) AS dt
   FROM audit JOIN ae ON abs(audit_s - event_s) <= 75)"""
KPI_SUMS = ("duration_sec", "total_frames", "wall_clock_seconds", "decode_seconds", "vehicle_detection_seconds")

_REPORT = f"""rep AS (SELECT *, {_norm('plate_raw')} AS norm FROM store_events), rep2 AS (SELECT *, {_correct('norm')} AS plate_corrected FROM rep),
  rep3 AS (SELECT *, {_status('plate_raw', 'norm', 'plate_corrected', 'ocr_conf', 'false')} AS plate_status, {_reasons('norm', 'plate_corrected', 'ocr_conf', 'false')} AS reason,
    CASE WHEN plate_raw IS NULL THEN [] WHEN n_votes = 2 THEN [plate_raw, lower(plate_raw), 'ZZZ0000'] ELSE [] END AS texts FROM rep2),
  rep4 AS (SELECT *, upper(trim(coalesce(plate_corrected, ''))) AS final, len(list_filter(texts, lambda t: upper(trim(t)) = upper(trim(coalesce(plate_corrected, ''))))) AS agree FROM rep3),
  labelled AS (SELECT *, CASE WHEN final = '' OR plate_status = 'PLACA_NO_DETECTADA' THEN 'SIN PLACA'
      WHEN regexp_matches(lower(coalesce(reason, '')), 'carrocería|marca') OR plate_status IN ('REVISION_MANUAL', 'FORMATO_INVALIDO') THEN 'REVISIÓN MANUAL'
      WHEN (agree >= 2 AND ocr_conf >= 0.88::DOUBLE) OR (ocr_conf >= 0.96::DOUBLE AND plate_status = 'OK') THEN 'ALTA (SEGURA)'
      WHEN ocr_conf >= 0.75::DOUBLE AND plate_status = 'OK' THEN 'MEDIA' ELSE 'DUDOSA' END AS certainty,
    CASE WHEN len(texts) > 0 THEN agree::VARCHAR || '/' || len(texts)::VARCHAR || ' lecturas' WHEN final <> '' THEN '1 sola lectura' ELSE '-' END AS consensus FROM rep4)"""


def _nearest(width: float) -> str:
    return rel(
        f"""SELECT det_idx, gt_idx, round(dt, 6) AS dt FROM (
          SELECT d.det_idx, t.gt_idx, abs(d.det_s - t.gt_s) AS dt, row_number() OVER (PARTITION BY d.det_idx ORDER BY abs(d.det_s - t.gt_s) NULLS LAST, t.gt_idx) AS r
          FROM named_detections d LEFT JOIN named_truth t ON t.gt_s BETWEEN d.det_s - {width + 1} AND d.det_s + {width + 1} AND abs(d.det_s - t.gt_s) <= {width} AND coalesce(d.clip = t.clip, true)) WHERE r = 1""",
        "named_detections", "named_truth",
    )


def _consensus(by: list[str], source: str, beta: str) -> str:
    """CTEs up to scored over readings grouped by some columns."""
    same, mine, by = " AND ".join(f"o.{c} = u.{c}" for c in by), ", ".join(f"o.{c}" for c in by), ", ".join(by)
    return f"""cleaned AS (SELECT {by}, ord, text, ocr_conf, plate_score + CASE WHEN regexp_matches(text, '^[A-Z]{{3}}[0-9]{{3,4}}$') OR regexp_matches(text, '^[A-Z]{{2}}[0-9]{{3}}[A-Z]$')
              THEN 0.15::DOUBLE + CASE WHEN {PROVINCE_MAP}[substr(text, 1, 1)] IS NOT NULL THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS plate_score, {_plausible('text')} AS ok FROM {source}),
          judged AS (SELECT *, bool_or(ok) OVER (PARTITION BY {by}) AS any_ok FROM cleaned),
          used AS (SELECT *, ocr_conf * greatest(0.1::DOUBLE, plate_score) AS w FROM judged WHERE ok OR NOT any_ok),
          own AS (SELECT {by}, text, sum(w) AS direct, count(*) AS reads, avg(ocr_conf) AS confidence, min((NOT any_ok)::INT) AS doubt FROM used GROUP BY ALL),
          cross_ AS (SELECT {mine}, o.text, sum(u.w * (1 - levenshtein(o.text, u.text)::DOUBLE / greatest(length(o.text), length(u.text))) * (1 - levenshtein(o.text, u.text)::DOUBLE / greatest(length(o.text), length(u.text))) * 0.5::DOUBLE) AS c
             FROM own o JOIN used u ON {same} AND o.text <> u.text AND levenshtein(o.text, u.text) <= 2 GROUP BY ALL),
          scored AS (SELECT own.*, direct + CASE WHEN starts_with(own.text, 'P') THEN {beta} * reads ELSE 0.0::DOUBLE END + coalesce(c, 0.0::DOUBLE) AS score FROM own LEFT JOIN cross_ USING ({by}, text))"""


_CROSS = AUDIT_EVENTS + ", alike AS (SELECT audit_plate, max(last_) AS plate_ FROM (SELECT audit_plate, last_, " + _SAME + """ AS same
             FROM (SELECT audit_plate, last_, upper(trim(audit_plate)) AS a, upper(trim(event_plate)) AS b
               FROM (SELECT DISTINCT audit_plate FROM audit), (SELECT event_plate, max(evt_idx) AS last_ FROM ae GROUP BY event_plate))) WHERE same GROUP BY audit_plate),
           near AS (SELECT audit_idx, min(evt_idx) AS time_, min(CASE WHEN same THEN evt_idx END) AS both_ FROM (SELECT audit_idx, evt_idx, """ + _SAME + """ AS same
             FROM (SELECT audit_idx, evt_idx, upper(trim(audit_plate)) AS a, upper(trim(event_plate)) AS b FROM audit JOIN ae ON event_s BETWEEN audit_s - 21 AND audit_s + 21 AND abs(audit_s - event_s) <= 20)) GROUP BY audit_idx)"""
_ASSIGNED = PAIRS + """, r AS (
  SELECT audit_idx, evt_idx, tier, row_number() OVER (ORDER BY tier, CASE WHEN tier = 1 THEN d * 1000 + dt ELSE dt END, audit_idx, evt_idx) AS o, 'rest' AS state FROM pairs WHERE tier IS NOT NULL
  UNION ALL
  SELECT audit_idx, evt_idx, tier, o, CASE WHEN mine THEN 'taken' WHEN bool_or(mine) OVER (PARTITION BY audit_idx) OR bool_or(mine) OVER (PARTITION BY evt_idx) THEN 'gone' ELSE 'rest' END
  FROM (SELECT *, o = min(o) OVER (PARTITION BY audit_idx) AND o = min(o) OVER (PARTITION BY evt_idx) AS mine FROM r WHERE state = 'rest')),
  taken AS (SELECT audit_idx, evt_idx, tier FROM r WHERE state = 'taken')"""
_WINDOWS = """windows AS (SELECT i AS win_idx, i * 325.0::DOUBLE AS s, i * 325.0::DOUBLE + 330.0::DOUBLE AS e
    FROM range(0, (SELECT (max(t_s) // 325)::BIGINT + 1 FROM plate_events)) t(i) WHERE i % 3 <> 1),
  placed AS (SELECT audit_idx, min(win_idx) AS win_idx FROM audit LEFT JOIN windows ON audit_idx % 29 <> 0 AND audit_s BETWEEN s - 20.0::DOUBLE AND e + 20.0::DOUBLE GROUP BY audit_idx),
  report AS (SELECT audit_idx, win_idx, CASE WHEN win_idx IS NOT NULL THEN coalesce(both_, plate_, time_) END AS evt_idx,
    CASE WHEN win_idx IS NULL THEN NULL WHEN both_ IS NOT NULL THEN 'PLACA_Y_HORA (EXACTO)' WHEN plate_ IS NOT NULL THEN 'SOLO_PLACA' WHEN time_ IS NOT NULL THEN 'SOLO_HORA' END AS "match",
    CASE WHEN audit_idx % 29 = 0 THEN 'Sin hora en Cam 2' WHEN win_idx IS NULL THEN 'no cubierta por clips actuales' END AS reason
    FROM audit JOIN placed USING (audit_idx) LEFT JOIN near USING (audit_idx) LEFT JOIN alike USING (audit_plate))"""
_MODELS = f"""modelled AS (SELECT event_id, ord, plate_score, unnest(['a', 'b', 'c']) AS model, unnest([text, text, translate(text, '7', '1')]) AS text,
    unnest([ocr_conf, ocr_conf * 0.9::DOUBLE, ocr_conf]) AS ocr_conf FROM readings),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY model, event_id ORDER BY ord, text, ocr_conf, plate_score) AS n FROM modelled),
  cells AS (SELECT * FROM ranked JOIN (SELECT unnest([3, 5, 7]) AS top_k) k ON n <= top_k CROSS JOIN (SELECT unnest([0.0, 0.05, 0.10, 0.20]::DOUBLE[]) AS beta_p) b),
  {_consensus(["model", "top_k", "beta_p", "event_id"], "cells", "own.beta_p")},
  voted AS (SELECT model, top_k, beta_p, event_id, arg_max(text, (score, text)) AS text FROM scored GROUP BY ALL),
  odds AS (SELECT model, top_k, beta_p, event_id, text, min(ord) AS seen, round(sum(greatest(0.1::DOUBLE, plate_score) * ln(c / (1 - c)) + CASE WHEN starts_with(text, 'P') THEN 2 * beta_p ELSE 0.0::DOUBLE END), 9) AS score
    FROM (SELECT *, greatest(0.01::DOUBLE, least(0.99::DOUBLE, ocr_conf)) AS c FROM cells) WHERE length(text) >= 5 GROUP BY ALL),
  summed AS (SELECT model, top_k, beta_p, event_id, arg_max(text, (score, -seen, text)) AS text FROM odds GROUP BY ALL),
  fused AS (SELECT model, top_k, beta_p, event_id, 'char_voting' AS fusion, text FROM voted UNION ALL
    SELECT v.model, v.top_k, v.beta_p, v.event_id, 'logprob_sum', coalesce(s.text, '') FROM voted v LEFT JOIN summed s USING (model, top_k, beta_p, event_id))"""


ORACLES = {
    "crossing_events": rel("SELECT clip_id, track_id, n_points, state, direction, round(crossing_s, 6) AS crossing_s, round(crossing_y, 6) AS crossing_y FROM fsm", "points", then=TRACK_FSM),
    "crossing_by_direction": rel("SELECT clip_id, state, direction, count(*) AS n FROM fsm GROUP BY ALL", "points", then=TRACK_FSM),
    "track_emission": rel(
        """SELECT f.clip_id, f.track_id, f.direction, round(f.committed_s, 6) AS committed_s,
             round((SELECT min(p.t_s) FROM points p WHERE p.clip_id = f.clip_id AND p.t_s >= greatest(f.committed_s, f.crossing_s + 3600.0)), 6) AS emit_s
           FROM fsm f WHERE state = 'COMMITTED'""", "points", then=TRACK_FSM),
    "late_emission": rel(
        """SELECT clip_id, track_id, segment, n_points, state, emitted,
             CASE WHEN emitted THEN coalesce(direction, CASE WHEN yb > ya THEN 'ENTRADA' ELSE 'SALIDA' END) END AS direction,
             round(last_s, 6) AS last_s, CASE WHEN NOT emitted THEN 'track_never_crossed' END AS reason
           FROM (SELECT f.*, s.*, f.n_points >= 2 AND ((low < 1200 AND high > 1200) OR state IN ('CROSSED', 'COMMITTED')) AS emitted
                 FROM fsm f JOIN spans s USING (clip_id, track_id, segment))""",
        "points",
        then="gaps AS (SELECT *, lag(t_s) OVER (PARTITION BY clip_id, track_id ORDER BY t_s, event_id) AS last FROM points),"
        " frames AS (SELECT DISTINCT clip_id AS fclip, t_s AS f FROM points),"
        " dated AS (SELECT g.*, x.f FROM gaps g ASOF LEFT JOIN frames x ON g.clip_id = x.fclip AND g.last + 43200.0 < x.f),"
        " segmented AS (SELECT clip_id, track_id, event_id, t_s, x, y, sum(coalesce((f < t_s)::INT, 0)) OVER (PARTITION BY clip_id, track_id ORDER BY t_s, event_id)::INT AS segment FROM dated),"
        " spans AS (SELECT clip_id, track_id, segment, min(y) AS low, max(y) AS high, arg_min(y, (t_s, event_id)) AS ya, arg_max(y, (t_s, event_id)) AS yb, max(t_s) AS last_s FROM segmented GROUP BY ALL),"
        + _fsm("segmented", "clip_id, track_id, segment"),
    ),
    "geom_side_distance": rel(f"SELECT event_id, {CROSS} >= 0 AS side, round(abs({CROSS}) / 1850.0::DOUBLE, 6) AS distance FROM points", "points"),
    "segment_intersect": rel(f"SELECT event_id, {_meets('400.0::DOUBLE', '1000.0::DOUBLE', 'x', 'y', '300.0::DOUBLE', '1250.0::DOUBLE', '1600.0::DOUBLE', '1100.0::DOUBLE')} AS hit FROM points", "points"),
    "polygon_filter": rel(f"SELECT frame_id, det_idx, fx1, fy1, fx2, fy2 FROM framed WHERE NOT {PARKED} AND {INSIDE}", "boxes", then=FRAMED),
    "detection_rejections": rel(
        f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN {PARKED} THEN 'parked_curb_filter' WHEN NOT {INSIDE} THEN 'outside_gravel_polygon' END AS reason FROM framed) WHERE reason IS NOT NULL GROUP BY reason",
        "boxes", then=FRAMED),
    "box_translate": rel(
        f"SELECT frame_id, det_idx, {', '.join(f'{e} AS f{c}' for e, c in zip(F1, ('x1', 'y1', 'x2', 'y2'), strict=True))}, round((x1 + x2) / 2, 6) AS contact_x, round(y2 - 15.0::DOUBLE, 6) AS contact_y FROM boxes", "boxes"),
    "class_remap": rel(
        "SELECT class_id, CASE WHEN class_id IN (0, 1, 3) THEN 'motorcycle' WHEN class_id = 2 THEN 'car' WHEN class_id = 5 THEN 'bus' WHEN class_id = 7 THEN 'truck' ELSE 'vehicle' END AS vehicle_class, count(*) AS n FROM boxes GROUP BY ALL", "boxes"),
    "detector_mask": rel(
        """SELECT frame_id, det_idx, round(greatest(0.0::DOUBLE, least((cx - w / 2) / s, 2300.0::DOUBLE)), 4) AS x1, round(greatest(0.0::DOUBLE, least((cy - h / 2) / s, 1064.0::DOUBLE)), 4) AS y1,
             round(greatest(0.0::DOUBLE, least((cx + w / 2) / s, 2300.0::DOUBLE)), 4) AS x2, round(greatest(0.0::DOUBLE, least((cy + h / 2) / s, 1064.0::DOUBLE)), 4) AS y2
           FROM (SELECT *, (x1 + x2) / 2 * s AS cx, (y1 + y2) / 2 * s AS cy, (x2 - x1) * s AS w, (y2 - y1) * s AS h
                 FROM (SELECT *, least(416.0::DOUBLE / 2300.0::DOUBLE, 416.0::DOUBLE / 1064.0::DOUBLE) AS s FROM boxes WHERE conf >= 0.35::DOUBLE AND class_id IN (0, 1, 2, 3, 5, 7)))""", "boxes"),
    "plate_box_pad": rel(
        """SELECT frame_id, det_idx, greatest(0, a - trunc((c - a)::DOUBLE * 0.15::DOUBLE)::INT) AS px1, greatest(0, b - trunc((d - b)::DOUBLE * 0.15::DOUBLE)::INT) AS py1,
             least(2300, c + trunc((c - a)::DOUBLE * 0.15::DOUBLE)::INT) AS px2, least(1064, d + trunc((d - b)::DOUBLE * 0.15::DOUBLE)::INT) AS py2
           FROM (SELECT frame_id, det_idx, trunc(x1)::INT AS a, trunc(y1)::INT AS b, trunc(x2)::INT AS c, trunc(y2)::INT AS d FROM boxes)
           WHERE NOT (c - a < 20 OR d - b < 10 OR (c - a)::DOUBLE / (d - b)::DOUBLE < 0.75::DOUBLE)""", "boxes"),
    "letterbox_scale": rel(
        """SELECT frame_id, det_idx, round(s, 6) AS scale, greatest(2, (round_even((x2 - x1) * s / 2, 0) * 2)::INT) AS width, greatest(2, (round_even((y2 - y1) * s / 2, 0) * 2)::INT) AS height
           FROM (SELECT *, least(416.0::DOUBLE / (x2 - x1), 416.0::DOUBLE / (y2 - y1)) AS s FROM boxes)""", "boxes"),
    "nms": rel(
        """SELECT frame_id, unnest(list_transform(kept, lambda z: z.det_idx)) AS det_idx FROM
           (SELECT frame_id, arg_max(kept, k) AS kept FROM r GROUP BY frame_id)""",
        "boxes", recursive=True,
        then="""ranked AS (SELECT frame_id, {'det_idx': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} AS b, row_number() OVER (PARTITION BY frame_id ORDER BY conf DESC, det_idx DESC) AS k FROM boxes),
          r AS (SELECT frame_id, k, [b] AS kept FROM ranked WHERE k = 1 UNION ALL
            SELECT r.frame_id, n.k, CASE WHEN len(list_filter(r.kept, lambda z:
               (CASE WHEN (z.x2 - z.x1) * (z.y2 - z.y1) + (n.b.x2 - n.b.x1) * (n.b.y2 - n.b.y1) - greatest(0.0::DOUBLE, least(z.x2, n.b.x2) - greatest(z.x1, n.b.x1)) * greatest(0.0::DOUBLE, least(z.y2, n.b.y2) - greatest(z.y1, n.b.y1)) > 0 THEN
               greatest(0.0::DOUBLE, least(z.x2, n.b.x2) - greatest(z.x1, n.b.x1)) * greatest(0.0::DOUBLE, least(z.y2, n.b.y2) - greatest(z.y1, n.b.y1))
               / ((z.x2 - z.x1) * (z.y2 - z.y1) + (n.b.x2 - n.b.x1) * (n.b.y2 - n.b.y1) - greatest(0.0::DOUBLE, least(z.x2, n.b.x2) - greatest(z.x1, n.b.x1)) * greatest(0.0::DOUBLE, least(z.y2, n.b.y2) - greatest(z.y1, n.b.y1))) ELSE 0 END) > 0.45::DOUBLE)) > 0
               THEN r.kept ELSE list_append(r.kept, n.b) END AS kept
            FROM r JOIN ranked n ON n.frame_id = r.frame_id AND n.k = r.k + 1)"""),
    "vehicle_score": rel(f"SELECT frame_id, det_idx, round({VEHICLE_SCORE}, 10) AS score FROM boxes", "boxes"),
    "plate_score": rel(f"SELECT frame_id, det_idx, round({PLATE_SCORE}, 10) AS score FROM boxes", "boxes"),
    "top_m_frames": rel(
        f"""SELECT track_id, rank::INT AS rank, frame_id, det_idx FROM (SELECT frame_id % 500 AS track_id, frame_id, det_idx,
             row_number() OVER (PARTITION BY frame_id % 500 ORDER BY {VEHICLE_SCORE} DESC, frame_id, det_idx) AS rank FROM boxes) WHERE rank <= 8""", "boxes"),
    "top_k_plates": rel(
        """SELECT "group", rank::INT AS rank, event_id, ord FROM (SELECT event_id % 1000 AS "group", event_id, ord,
             row_number() OVER (PARTITION BY event_id % 1000 ORDER BY plate_score DESC, event_id, ord) AS rank FROM readings) WHERE rank <= 7""", "readings"),
    "vote_order": rel("""SELECT event_id, arg_min(text, (-ocr_conf, -plate_score, ord)) AS "first", count(*) AS n FROM readings GROUP BY event_id""", "readings"),
    "plate_normalize": rel(f"SELECT event_id, ord, {_norm('raw')} AS normalized, nullif(upper(regexp_replace(raw, '[^\\p{{L}}\\p{{N}}]', '', 'g')), '') AS cleaned FROM raw", "readings", then=RAW),
    "plate_correct": rel("SELECT event_id, ord, fixed AS corrected FROM fixed", "readings", then=FIXED),
    "plate_status": rel(f"SELECT event_id, ord, {_status('raw', 'norm', 'fixed', 'ocr_conf', 'event_id % 10 = 0')} AS status FROM fixed", "readings", then=FIXED),
    "plate_reasons": rel(f"SELECT event_id, ord, {_reasons('norm', 'fixed', 'ocr_conf', 'event_id % 10 = 0')} AS reason FROM fixed", "readings", then=FIXED),
    "plausible_plate": rel(f"SELECT event_id, ord, {_plausible('norm')} AS plausible FROM fixed", "readings", then=FIXED),
    "ocr_gate": rel(
        f"""SELECT event_id, ord, CASE WHEN ok THEN raw END AS plate, round(CASE WHEN ok THEN ocr_conf ELSE 0.0::DOUBLE END, 6) AS ocr_conf, det_conf
            FROM (SELECT *, coalesce(length(norm) >= 5 AND ocr_conf >= 0.70::DOUBLE AND {_plausible('norm')}, false) AS ok FROM fixed)""", "readings", then=FIXED),
    "province_lookup": rel(f"SELECT {PROVINCE_MAP}[substr(text, 1, 1)] AS province, count(*) AS n FROM readings GROUP BY 1", "readings"),
    "consensus_vote": rel(
        """SELECT event_id, text, round(confidence, 6) AS consensus_conf, round(score, 6) AS score, reads,
             doubt = 1 OR coalesce(score - next_score < CASE WHEN substr(text, 1, 1) <> substr(next_text, 1, 1) THEN 0.15::DOUBLE ELSE 0.075::DOUBLE END, false) AS needs_review
           FROM (SELECT *, row_number() OVER w AS place, lead(text) OVER w AS next_text, lead(score) OVER w AS next_score FROM scored WINDOW w AS (PARTITION BY event_id ORDER BY score DESC, text DESC)) WHERE place = 1""",
        "readings",
        then=_consensus(["event_id"], "readings", "0.10::DOUBLE")),
    "logodds_fusion": rel(
        """SELECT event_id, text, round(score, 6) AS score, 0.85::DOUBLE AS consensus_conf FROM (
             SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, seen, text DESC) AS r FROM (
               SELECT event_id, text, min(ord) AS seen, round(sum(greatest(0.1::DOUBLE, plate_score) * ln(c / (1 - c)) + CASE WHEN starts_with(text, 'P') THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END), 9) AS score
               FROM (SELECT *, greatest(0.01::DOUBLE, least(0.99::DOUBLE, ocr_conf)) AS c FROM readings) WHERE length(text) >= 5 GROUP BY ALL)) WHERE r = 1""", "readings"),
    "two_tier_combine": rel(
        """SELECT event_id, ord, CASE WHEN ok THEN substr(text, 1, 2) || substr(text, 3, 2 + ord) END AS text,
             round(CASE WHEN ok THEN (ocr_conf + det_conf + plate_score) / 3 END, 6) AS ocr_conf, round(CASE WHEN ok THEN plate_score * 1.1::DOUBLE ELSE plate_score END, 6) AS plate_score
           FROM (SELECT *, w >= 24 AND h >= 24 AND w / h <= 1.35::DOUBLE AND length(substr(text, 1, 2)) >= 2 AND length(substr(text, 3, 2 + ord)) >= 3 AS ok
             FROM (SELECT *, (20 + event_id % 40)::DOUBLE AS w, (20 + (event_id * 7) % 40)::DOUBLE AS h FROM readings))""", "readings"),
    "intra_dedup": rel("""SELECT event_id, row_number() OVER (PARTITION BY clip_id, track_id, k % 3 ORDER BY t_s, event_id) = 1 AS "first" FROM points""", "points"),
    "emission_order": rel("SELECT event_id, row_number() OVER (ORDER BY t_s, event_id) AS rn FROM plate_events", "plate_events"),
    "inter_dedup": rel(
        """SELECT e.event_id, d.duplicate_of FROM numbered e LEFT JOIN (
             SELECT a.event_id, arg_max(b.event_id, b.rn) AS duplicate_of FROM numbered a JOIN numbered b
               ON b.rn BETWEEN a.rn - 50 AND a.rn - 1 AND a.direction = b.direction AND abs(a.t_s - b.t_s) <= 60
             WHERE a.plate IS NOT NULL AND b.plate IS NOT NULL AND (a.plate = b.plate OR (levenshtein(a.plate, b.plate) <= 1 AND (a.ocr_conf < 0.75::DOUBLE OR b.ocr_conf < 0.75::DOUBLE)))
             GROUP BY a.event_id) d USING (event_id)""",
        "plate_events", then="numbered AS (SELECT *, row_number() OVER (ORDER BY t_s, event_id) AS rn FROM plate_events)"),
    "visual_similarity": """SELECT vec_id, round(coalesce(list_cosine_similarity(list_transform(a, lambda z: z - list_avg(a)), list_transform(b, lambda z: z - list_avg(b))), 0), 5) AS similarity
      FROM (SELECT vec_id, embedding::DOUBLE[] AS a, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings) WHERE b IS NOT NULL""",
    "asof_gt": _nearest(6.0),
    "asof_event_id": rel(
        """SELECT det_idx, gt_idx, round(dt, 6) AS dt FROM (
          SELECT d.det_idx, t.gt_idx, abs(floor(d.det_s) - t.gt_s) AS dt, row_number() OVER (PARTITION BY d.det_idx ORDER BY abs(floor(d.det_s) - t.gt_s) NULLS LAST, t.gt_idx) AS r
          FROM named_detections d LEFT JOIN named_truth t ON d.clip = t.clip AND abs(floor(d.det_s) - t.gt_s) < 15) WHERE r = 1""", "named_detections", "named_truth"),
    "plate_dataset": rel(
        """SELECT event_id, 'GT_' || gt_idx::VARCHAR AS ground_truth_id, plate AS ground_truth_plate, coalesce(legible, false) AS plate_legible, NULL::VARCHAR AS province, CASE WHEN gt_idx IS NOT NULL THEN 'car' END AS vehicle_type
           FROM (SELECT d.event_id, t.gt_idx, t.plate, t.legible, row_number() OVER (PARTITION BY d.event_id ORDER BY abs(d.at - t.gt_s) NULLS LAST, t.gt_idx) AS r
             FROM (SELECT *, CASE WHEN det_idx % 53 <> 0 THEN det_s ELSE 0.0::DOUBLE END AS at FROM named_detections) d
             LEFT JOIN named_truth t ON t.gt_s BETWEEN d.at - 7 AND d.at + 7 AND abs(d.at - t.gt_s) <= 6 AND coalesce(d.clip = t.clip, true)) WHERE r = 1""", "named_detections", "named_truth"),
    "greedy_assign": rel("SELECT audit_idx, evt_idx, tier FROM taken", "audit", recursive=True, then=_ASSIGNED),
    "match_outcomes": rel(
        """SELECT count(*) AS total, count_if(tier = 0)::BIGINT AS exact, count_if(tier = 1)::BIGINT AS near, count_if(tier = 2)::BIGINT AS vehicle_only, count_if(tier IS NULL)::BIGINT AS missed,
             greatest(0, (SELECT count(*) FROM ae) - count(evt_idx)) AS extra FROM audit LEFT JOIN marked USING (audit_idx)""", "audit", recursive=True,
        then=_ASSIGNED + """, late AS (SELECT x.audit_idx, y.evt_idx FROM
             (SELECT audit_idx, audit_plate AS plate, row_number() OVER (PARTITION BY audit_plate ORDER BY audit_s, audit_idx) AS n FROM audit WHERE audit_idx NOT IN (SELECT audit_idx FROM taken)) x
             JOIN (SELECT evt_idx, event_plate AS plate, row_number() OVER (PARTITION BY event_plate ORDER BY event_s, evt_idx) AS n FROM ae WHERE event_plate IS NOT NULL AND evt_idx NOT IN (SELECT evt_idx FROM taken)) y USING (plate, n)),
           marked AS (SELECT * FROM taken UNION ALL SELECT audit_idx, evt_idx, 0 FROM late)"""),
    "audit_report": rel("SELECT * FROM report", "audit", then=_CROSS + ", " + _WINDOWS),
    "audit_recall": rel(
        """SELECT count(win_idx) AS inside, count_if("match" LIKE '%PLACA%')::BIGINT AS detected, round(coalesce(count_if("match" LIKE '%PLACA%') / nullif(count(win_idx), 0) * 100, 0), 4) AS recall,
             count_if(win_idx IS NULL)::BIGINT AS outside FROM report""", "audit", then=_CROSS + ", " + _WINDOWS),
    "audit_log": rel(
        """SELECT event_id AS row_idx, CASE WHEN event_id % 6 <> 0 THEN true_plate END AS plate, 'car' AS vehicle_type, (event_id % 4)::VARCHAR AS axles, NULL::VARCHAR AS time_cam1, t AS time_cam2,
             CASE WHEN event_id % 5 >= 2 AND user_id % 30 < 24 THEN ((user_id % 30) * 3600 + (k % 60) * 60 + CASE WHEN event_id % 5 > 2 THEN k % 60 ELSE 0 END)::INT END AS cam2_s, '' AS note
           FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'noon' WHEN 2 THEN (user_id % 30)::VARCHAR || ':' || lpad((k % 60)::VARCHAR, 2, '0')
             ELSE (user_id % 30)::VARCHAR || ': ' || lpad((k % 60)::VARCHAR, 2, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') END AS t FROM plate_events) WHERE event_id % 6 <> 0 OR event_id % 5 <> 0""", "plate_events"),
    "audit_clip_start": rel("SELECT clip_id, strftime(TIMESTAMP '2024-01-01 16:17:20' + to_seconds(((clip_no - 60) * 325)::BIGINT), '%Y-%m-%d %H:%M:%S') AS start FROM clips", "clips"),
    "ocr_matrix": rel(
        """SELECT model, top_k, fusion, beta_p, floor((count_if(d = 0) * 2000 + count(*)) / (count(*) * 2)) / 10 AS exact_match_pct,
             floor((sum(greatest(0, length(plate) - d)) * 2000 + sum(length(plate))) / (sum(length(plate)) * 2)) / 10 AS char_acc_pct, floor((count_if(text <> '' AND text[1] = plate[1]) * 2000 + count(*)) / (count(*) * 2)) / 10 AS pos0_acc_pct, count_if(starts_with(text, 'P') AND NOT starts_with(plate, 'P'))::BIGINT AS non_p_corrupted, count(*) AS evaluated_events
           FROM (SELECT *, levenshtein(plate, text) AS d FROM fused JOIN order_plates USING (event_id) WHERE event_id % 3 <> 0) GROUP BY ALL""", "readings", "order_plates", then=_MODELS),
    "largest_crops": rel(
        """SELECT target, frame_id, det_idx, w::VARCHAR || 'x' || h::VARCHAR AS crop_size, place::INT AS place FROM (
             SELECT *, row_number() OVER (PARTITION BY target ORDER BY w * h DESC, frame_id, det_idx) AS place FROM (
               SELECT frame_id % 500 AS target, frame_id, det_idx, trunc(x2 - x1)::BIGINT AS w, trunc(y2 - y1)::BIGINT AS h FROM boxes)) WHERE place <= 5""", "boxes"),
    "band_fuzzy_pairs": rel("SELECT audit_idx, evt_idx, tier, round(CASE WHEN tier = 1 THEN d * 1000 + dt ELSE dt END, 4) AS score, CASE WHEN tier < 2 THEN d::INT END AS distance FROM pairs WHERE tier IS NOT NULL", "audit", then=PAIRS),
    "match_histogram": rel("SELECT tier, count(*) AS pairs, count(DISTINCT evt_idx) AS events FROM pairs WHERE tier IS NOT NULL GROUP BY tier", "audit", then=PAIRS),
    "exact_plate_fallback": rel(
        """SELECT audit_idx, evt_idx, x.plate FROM (SELECT audit_idx, audit_plate AS plate, row_number() OVER (PARTITION BY audit_plate ORDER BY audit_s, audit_idx) AS n FROM audit) x
           JOIN (SELECT evt_idx, event_plate AS plate, row_number() OVER (PARTITION BY event_plate ORDER BY event_s, evt_idx) AS n FROM ae WHERE event_plate IS NOT NULL) y ON x.plate = y.plate AND x.n = y.n""",
        "audit", then=AUDIT_EVENTS),
    "audit_crossvalidate": rel(
        """SELECT audit_idx, coalesce(both_, plate_, time_) AS evt_idx, CASE WHEN both_ IS NOT NULL THEN 'PLACA_Y_HORA (EXACTO)' WHEN plate_ IS NOT NULL THEN 'SOLO_PLACA' WHEN time_ IS NOT NULL THEN 'SOLO_HORA' END AS "match"
           FROM audit LEFT JOIN near USING (audit_idx) LEFT JOIN alike USING (audit_plate)""",
        "audit", then=_CROSS),
    "fuzzy_plate_equality": rel(f"SELECT audit_idx, evt_idx, {_SAME} AS same FROM (SELECT *, upper(trim(audit_plate)) AS a, upper(trim(event_plate)) AS b FROM audit JOIN ae ON abs(audit_s - event_s) <= 60)", "audit", then=AUDIT_EVENTS),
    "clip_windows": rel(
        """SELECT audit_idx, min(win_idx) AS win_idx FROM audit LEFT JOIN (SELECT i AS win_idx, i * 325.0::DOUBLE AS s, i * 325.0::DOUBLE + 330.0::DOUBLE AS e
             FROM range(0, (SELECT (max(t_s) // 325)::BIGINT + 1 FROM plate_events)) t(i) WHERE i % 3 <> 1) ON audit_s BETWEEN s - 15.0::DOUBLE AND e + 15.0::DOUBLE GROUP BY audit_idx""", "audit"),
    "eval_metrics": rel(
        """SELECT round(matched / gt, 6) AS event_recall, round(coalesce(right_way / nullif(matched, 0), 0), 6) AS direction_accuracy, round(exact / legible, 6) AS plate_exact_match,
             round(right_chars / chars, 6) AS character_accuracy, unread AS unread_legible_plates, round(first_ / legible, 6) AS pos0_accuracy,
             (SELECT count(*) FROM detections WHERE video IN (SELECT video FROM truth)) - matched AS false_positives, matched AS matched_gt_count, gt AS total_gt_count,
             chars AS total_real_gt_chars, right_chars AS total_correct_chars
           FROM (SELECT count(*) AS gt, count(det_idx) AS matched, count_if(det_direction = direction)::BIGINT AS right_way, count_if(l)::BIGINT AS legible, count_if(l AND d = 0)::BIGINT AS exact,
               count_if(l AND det_plate IS NULL)::BIGINT AS unread, count_if(l AND substr(g, 1, 1) = substr(det_plate, 1, 1))::BIGINT AS first_,
               coalesce(sum(CASE WHEN l THEN length(g) END), 0)::BIGINT AS chars, coalesce(sum(CASE WHEN l AND det_plate IS NOT NULL THEN greatest(0, length(g) - d) END), 0)::BIGINT AS right_chars
             FROM (SELECT *, coalesce(legible AND g <> '', false) AS l, levenshtein(g, det_plate) AS d FROM (
               SELECT t.*, t.plate AS g, n.det_idx, n.direction AS det_direction, n.plate AS det_plate FROM truth t LEFT JOIN (
                 SELECT gt_idx, det_idx, direction, plate FROM (SELECT t.gt_idx, d.*, row_number() OVER (PARTITION BY t.gt_idx ORDER BY abs(t.gt_s - d.det_s), d.det_idx) AS r
                   FROM truth t JOIN detections d ON t.video = d.video AND abs(t.gt_s - d.det_s) <= 9) WHERE r = 1) n USING (gt_idx))))""", "truth", "detections"),
    "run_diff": rel(
        """SELECT video, position, array_to_string(list_filter([CASE WHEN k % 50 = 0 AND plate_raw IS DISTINCT FROM 'XXX0000' THEN 'plate_raw' END, CASE WHEN k % 70 = 0 THEN 'ocr_conf' END], lambda z: z IS NOT NULL), ',') AS fields
           FROM (SELECT video_source AS video, row_number() OVER (PARTITION BY video_source ORDER BY event_timestamp, event_id) AS position, plate_raw, regexp_extract(event_id, '(\\d+)', 1)::BIGINT AS k FROM store_events)
           WHERE (k % 50 = 0 AND plate_raw IS DISTINCT FROM 'XXX0000') OR k % 70 = 0""", "store_events"),
    "run_timing_totals": rel("SELECT run_id, round(sum(staging_seconds), 3) AS staging_seconds, round(sum(file_hash_seconds), 3) AS file_hash_seconds, round(sum(clock_read_seconds), 3) AS clock_read_seconds, round(sum(wall_clock_seconds), 3) AS wall_clock_seconds FROM clips GROUP BY run_id", "clips"),
    "latest_run": rel("SELECT run_id FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1", "runs"),
    "executive_summary": rel(
        """SELECT clips, round(duration_sec / 60, 4) AS video_minutes, round(wall / 60, 4) AS wall_minutes, round(coalesce(duration_sec / nullif(wall, 0), 0), 4) AS speed_ratio, round(coalesce(frames / nullif(wall, 0), 0), 4) AS fps,
             round(wall / 3600 * 0.35::DOUBLE, 4) AS cost, round(coalesce(wall / 3600 * 0.35::DOUBLE / nullif(duration_sec / 3600, 0), 0), 4) AS cost_per_video_hour, round(det / 0.0215::DOUBLE)::BIGINT AS detector_calls,
             round(CASE WHEN frames > 0 THEN (1 - round(det / 0.0215::DOUBLE) / frames) * 100 ELSE 88.3::DOUBLE END, 4) AS filter_ratio
           FROM (SELECT count(*) AS clips, sum(duration_sec)::DOUBLE AS duration_sec, sum(total_frames)::DOUBLE AS frames, sum(wall_clock_seconds)::DOUBLE AS wall, sum(vehicle_detection_seconds)::DOUBLE AS det
             FROM done WHERE run_id = (SELECT run_id FROM last) OR NOT EXISTS (SELECT 1 FROM done WHERE run_id = (SELECT run_id FROM last)))""",
        "runs", "clips", then="last AS (SELECT run_id FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 1), done AS (SELECT * FROM clips WHERE status = 'COMPLETED')"),
    "event_counts": rel(
        """SELECT processing_run_id, count(*) AS events, count_if(ocr_conf >= 0.8::DOUBLE)::BIGINT AS plates_ok, count_if(vehicle_type = 'car')::BIGINT AS cars, count_if(vehicle_type = 'truck')::BIGINT AS trucks, count_if(vehicle_type = 'motorcycle')::BIGINT AS motorcycles,
             count_if(vehicle_type = 'bus')::BIGINT AS buses, count_if(direction = 'ENTRADA')::BIGINT AS entries, count_if(direction = 'SALIDA')::BIGINT AS exits FROM store_events WHERE duplicate_of IS NULL GROUP BY 1""", "store_events"),
    "distinct_tracks": rel("SELECT clip_id, count(DISTINCT track_id) AS tracks FROM points GROUP BY 1", "points"),
    "latency_blocks": """SELECT stage, block, count(*) AS n, round(avg(ms), 1) AS mean_ms, round(min(ms), 1) AS min_ms, round(max(ms), 1) AS max_ms, printf('%4d - %4d', block * 200 + 1, block * 200 + count(*)) AS range
      FROM (SELECT l_suppkey % 10 AS stage, l_quantity AS ms, (row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_orderkey, l_linenumber, l_quantity) - 1) // 200 AS block FROM lineitem) GROUP BY stage, block""",
    "latency_percentiles": """SELECT l_suppkey % 10 AS stage, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_quantity, 0.95), 6) AS p95, round(avg(l_quantity), 6) AS mean, round(min(l_quantity), 6) AS min, round(max(l_quantity), 6) AS max FROM lineitem GROUP BY 1""",
    "stage_summary": rel(
        """SELECT run_id, stage, round(s, 3) AS seconds, calls, round(coalesce(s / nullif(wall, 0), 0) * 100, 1) AS pct FROM (
             SELECT run_id, stage, sum(seconds) AS s, count(*) AS calls FROM (UNPIVOT clips ON decode_seconds, vehicle_detection_seconds, staging_seconds, file_hash_seconds, clock_read_seconds INTO NAME stage VALUE seconds) GROUP BY ALL)
           JOIN (SELECT run_id, sum(wall_clock_seconds) AS wall FROM clips GROUP BY 1) USING (run_id)""", "clips"),
    "clip_deltas": rel("SELECT clip_no, total_frames::DOUBLE AS delta FROM clips", "clips"),
    "gap_breakdown": rel(
        """SELECT run_id, segment, round(seconds, 3) AS seconds, round(seconds / total_wall * 100, 1) AS pct FROM (
             SELECT run_id, total_wall, unnest(['Startup', 'Staging/Copy', 'File Hash', 'OSD Clock Read', 'Clip Processing', 'Excel Export']) AS segment, unnest([14.5::DOUBLE, a, b, c, d, 2.25::DOUBLE]) AS seconds FROM (
               SELECT run_id, sum(staging_seconds) AS a, sum(file_hash_seconds) AS b, sum(clock_read_seconds) AS c, sum(wall_clock_seconds) AS d, sum(wall_clock_seconds) + sum(staging_seconds) + 20.0::DOUBLE AS total_wall FROM clips GROUP BY 1))""", "clips"),
    "run_totals": rel(
        """SELECT run_id, sum(processed_events)::BIGINT AS events, sum(total_frames)::BIGINT AS frames, round(sum(duration_sec), 3) AS video_s, round(sum(wall_clock_seconds), 3) AS process_s,
             round(sum(duration_sec) / CASE WHEN sum(wall_clock_seconds) > 0 THEN sum(wall_clock_seconds) ELSE 1000 END, 3) AS speed_ratio FROM clips GROUP BY 1""", "clips"),
    "param_sweep": rel(
        """SELECT "limit", beta, count_if(ocr_conf + CASE WHEN starts_with(text, 'P') THEN beta ELSE 0.0::DOUBLE END >= "limit")::BIGINT AS accepted, count(*) AS n
           FROM readings, (SELECT unnest([0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS "limit") a, (SELECT unnest([0.0, 0.05, 0.1]::DOUBLE[]) AS beta) b GROUP BY ALL""", "readings"),
    "detector_bench": rel(
        """SELECT frame_id % 3 AS model, round(avg((n > 0)::INT::DOUBLE) * 100, 6) AS hit_pct, round(avg(CASE WHEN n > 0 THEN best END), 6) AS mean_conf, round(avg(ms), 6) AS mean_ms
           FROM (SELECT frame_id, count_if(conf >= 0.6::DOUBLE)::BIGINT AS n, max(conf) AS best, max(sharpness) AS ms FROM boxes GROUP BY 1) GROUP BY 1""", "boxes"),
    "certainty_labels": rel("SELECT event_id, certainty, consensus FROM labelled", "store_events", then=_REPORT),
    "report_rows": rel(
        """SELECT row_number() OVER (PARTITION BY processing_run_id ORDER BY event_timestamp, event_id) AS no, processing_run_id, event_id, datetime_str, direction, coalesce(plate_corrected, 'SIN PLACA') AS plate, certainty
           FROM labelled WHERE duplicate_of IS NULL""", "store_events", then=_REPORT),
    "report_duplicates": rel("SELECT row_number() OVER (PARTITION BY processing_run_id ORDER BY event_timestamp, event_id) AS no, event_id, duplicate_of, vehicle_type FROM store_events WHERE duplicate_of IS NOT NULL", "store_events"),
    "natural_sort": rel("SELECT run_id, clip_id, row_number() OVER (PARTITION BY run_id ORDER BY clip_no) AS place FROM clips", "clips"),
    "clip_filter": rel("SELECT clip_id FROM clips WHERE clip_no IN (5, 60, 61, 1000)", "clips"),
    "clip_start_time": rel(
        """SELECT clip_no, CASE clip_no % 4 WHEN 0 THEN strftime(TIMESTAMP '2024-01-01 16:17:16' + to_seconds((clip_no - 60) * 330), '%Y-%m-%d %H:%M:%S') WHEN 1 THEN '2024-03-15 09:15:00' WHEN 2 THEN '2024-03-16 10:56:51' ELSE '2026-09-09 16:00:00' END AS start FROM clips""", "clips"),
    "event_names": rel(
        """SELECT event_id, 'EVT_' || right('cam(' || (user_id % 90)::VARCHAR || ')', 4) || printf('_%04d_%d', user_id * 101, trunc(t_s)::BIGINT) AS name, coalesce(plate, 'None') || '_' || direction AS dedup_key FROM plate_events""", "plate_events"),
    "event_datetime": rel("SELECT event_id, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(floor(t_s)::BIGINT), '%Y-%m-%d %H:%M:%S') AS at FROM plate_events", "plate_events"),
    "time_cell_parse": rel(
        """SELECT event_id, CASE WHEN event_id % 4 < 2 AND user_id % 30 < 24 THEN ((user_id % 30) * 3600 + (k % 60) * 60 + CASE WHEN event_id % 4 = 1 THEN k % 60 ELSE 0 END)::INT END AS seconds FROM plate_events""", "plate_events"),
    "time_of_day_filter": rel("SELECT event_id, datetime_str FROM store_events WHERE substr(datetime_str, 12, 8) BETWEEN '06:00:00' AND '18:30:00' AND regexp_matches(video_source, '\\((3|4|5)\\)\\.mp4$')", "store_events"),
    "crop_listing": rel(
        """SELECT 'EVT_(' || (event_id % 97)::VARCHAR || ')_' || lpad((event_id % 1000)::VARCHAR, 4, '0') || '_7' AS event,
             array_to_string(list_sort(list('EVT_(' || (event_id % 97)::VARCHAR || ')_' || lpad((event_id % 1000)::VARCHAR, 4, '0') || '_7_' || ord::VARCHAR || '.jpg')), ',') AS files FROM readings GROUP BY 1""", "readings"),
    "upsert_latest": rel("SELECT event_id, seq, direction, plate FROM (SELECT 'EVT_' || (event_id % 500)::VARCHAR AS event_id, event_id AS seq, direction, plate, row_number() OVER (PARTITION BY event_id % 500 ORDER BY event_id DESC) AS r FROM plate_events) WHERE r = 1", "plate_events"),
    "update_run": rel("SELECT run_id, CASE WHEN run_id IN ('RUN_1', 'RUN_2') THEN 'DONE' ELSE status END AS status, CASE WHEN run_id IN ('RUN_1', 'RUN_2') THEN '2024-02-01' END AS finished_at FROM runs", "runs"),
    "schema_evolution": rel("SELECT run_id, count(*) AS n, round(sum(CASE WHEN clip_no % 2 = 1 THEN staging_seconds ELSE 0 END), 3) AS staging, count(*) AS filled FROM clips GROUP BY 1", "clips"),
    "constraint_checks": rel(
        """SELECT 'primary' AS "check", count(*) AS n FROM (SELECT regexp_replace(event_id, '99$', '0') AS k FROM store_events GROUP BY 1 HAVING count(*) > 1)
           UNION ALL SELECT 'foreign', count(*) FROM store_events WHERE processing_run_id || '0' NOT IN (SELECT run_id FROM runs)""", "store_events", "runs"),
    "checkpoint_antijoin": rel("SELECT clip_id, run_id FROM clips WHERE NOT (status = 'COMPLETED' AND clip_no % 5 <> 0)", "clips"),
    "event_filter": rel("SELECT event_id, event_timestamp FROM store_events WHERE processing_run_id = 'RUN_3' AND duplicate_of IS NULL", "store_events"),
}


# Sequential operators: one recursion step for each row of a clip or track, all clips or tracks at once ------------------

_LIVE = "STRUCT(id BIGINT, x DOUBLE, y DOUBLE, t DOUBLE, kind VARCHAR, root BIGINT, began DOUBLE)[]"
_FITS = """l.kind = p.kind OR (l.kind IN ('truck', 'bus', 'car') AND p.kind IN ('truck', 'bus', 'car'))
           OR (l.kind IN ('motorcycle', 'person') AND p.kind IN ('motorcycle', 'person'))"""
ORACLES["stitch_tracks"] = rel(
    "SELECT clip_id, root_id, round(root_s, 6) AS root_s, count(*) AS n, count(DISTINCT track_id) AS ids FROM roots GROUP BY clip_id, root_id, root_s",
    "points",
    recursive=True,
    then=f"""
    ordered AS MATERIALIZED (
      SELECT clip_id, id, t_s, x, y, kind, row_number() OVER w AS k, coalesce(lead(t_s) OVER w <> t_s, true) AS ends
      FROM (SELECT *, track_id * 2 + event_id % 2 AS id, vehicle_class AS kind FROM points)
      WINDOW w AS (PARTITION BY clip_id ORDER BY t_s, id, x, y)),
    walk AS (
      SELECT clip_id, 0::BIGINT AS k, []::{_LIVE} AS live, NULL::BIGINT AS id, NULL::BIGINT AS root, NULL::DOUBLE AS began
      FROM (SELECT DISTINCT clip_id FROM ordered)
      UNION ALL
      SELECT clip_id, k, list_filter(after, lambda l: NOT ends OR t_s - l.t <= 3600.0::DOUBLE), id,
             list_filter(after, lambda l: l.id = p_id)[1].root, list_filter(after, lambda l: l.id = p_id)[1].began
      FROM (
        SELECT *, id AS p_id, CASE
          WHEN known THEN list_transform(live, lambda l: CASE WHEN l.id = id THEN {{'id': l.id, 'x': x, 'y': y, 't': t_s, 'kind': l.kind, 'root': l.root, 'began': l.began}} ELSE l END)
          WHEN best IS NULL THEN list_append(live, {{'id': id, 'x': x, 'y': y, 't': t_s, 'kind': kind, 'root': id, 'began': t_s}})
          ELSE list_append(list_filter(live, lambda l: l.id <> best.id),
                 {{'id': id, 'x': x, 'y': y, 't': t_s, 'kind': CASE WHEN kind <> 'vehicle' THEN kind ELSE best.kind END, 'root': best.root, 'began': best.began}}) END AS after
        FROM (
          SELECT w.clip_id, p.k, w.live, p.id, p.t_s, p.x, p.y, p.kind, p.ends, len(list_filter(w.live, lambda l: l.id = p.id)) > 0 AS known,
                 list_sort(list_transform(list_filter(list_zip(w.live, range(1, len(w.live) + 1)),
                     lambda z: (z[1].kind = p.kind OR (z[1].kind IN ('truck', 'bus', 'car') AND p.kind IN ('truck', 'bus', 'car')))
                               AND p.t_s - z[1].t BETWEEN 0.05::DOUBLE AND 3600.0::DOUBLE AND sqrt((p.x - z[1].x) ** 2 + (p.y - z[1].y) ** 2) < 450),
                   lambda z: {{'d': sqrt((p.x - z[1].x) ** 2 + (p.y - z[1].y) ** 2), 'at': z[2], 'l': z[1]}}))[1].l AS best
          FROM walk w JOIN ordered p ON p.clip_id = w.clip_id AND p.k = w.k + 1))),
    roots AS (SELECT clip_id, id AS track_id, root AS root_id, began AS root_s FROM walk WHERE k > 0)""",
)

ORACLES["adaptive_sampling"] = rel(
    "SELECT clip_id, state, run, count(*) AS n FROM walk WHERE k > 0 GROUP BY clip_id, state, run",
    "points",
    recursive=True,
    then=f"""
    ordered AS MATERIALIZED (
      SELECT clip_id, t, motion, vehicle, row_number() OVER (PARTITION BY clip_id ORDER BY t, event_id) AS k
      FROM (SELECT clip_id, event_id, t_s / 600 AS t, k < 20 AS motion, value > 100 AS vehicle FROM points)),
    walk AS (
      SELECT clip_id, 0::BIGINT AS k, -1e9::DOUBLE AS vehicle_at, -1e9::DOUBLE AS motion_at, -1e9::DOUBLE AS run_at, NULL::VARCHAR AS state, NULL::BOOLEAN AS run
      FROM (SELECT DISTINCT clip_id FROM ordered)
      UNION ALL
      SELECT clip_id, k, CASE WHEN run AND vehicle THEN t ELSE vehicle_at END, motion_at, CASE WHEN run THEN t ELSE run_at END, state, run
      FROM (
        SELECT *, t - run_at >= CASE state WHEN 'ACTIVE' THEN 1.0::DOUBLE / {DEFAULT.active_fps}::DOUBLE WHEN 'PRE-ACTIVE' THEN 1.0::DOUBLE / {DEFAULT.preactive_fps}::DOUBLE
                                     ELSE 1.0::DOUBLE / {DEFAULT.sleep_fps}::DOUBLE END AS run
        FROM (
          SELECT *, CASE WHEN t - vehicle_at <= {DEFAULT.active_hold} THEN 'ACTIVE' WHEN t - motion_at <= {DEFAULT.preactive_hold} THEN 'PRE-ACTIVE' ELSE 'SLEEP' END AS state
          FROM (
            SELECT w.clip_id, p.k, w.vehicle_at, CASE WHEN p.motion THEN p.t ELSE w.motion_at END AS motion_at, w.run_at, p.t, p.vehicle
            FROM walk w JOIN ordered p ON p.clip_id = w.clip_id AND p.k = w.k + 1))))""",
)

ORACLES["top_m_diverse"] = rel(
    "SELECT track_id, r::INT AS rank, kept[r].frame_id AS frame_id, kept[r].det_idx AS det_idx FROM (SELECT track_id, kept, unnest(range(1, len(kept) + 1)) AS r FROM walk JOIN ends USING (track_id, k))",
    "boxes",
    recursive=True,
    then=f"""
    ordered AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_id, det_idx) AS k
      FROM (SELECT frame_id % 500 AS track_id, frame_id, det_idx, frame_id::DOUBLE AS t, {VEHICLE_SCORE} AS score FROM boxes)),
    ends AS (SELECT track_id, max(k) AS k FROM ordered GROUP BY track_id),
    walk AS (
      SELECT track_id, 0::BIGINT AS k, []::STRUCT(low DOUBLE, spot BIGINT, t DOUBLE, frame_id BIGINT, det_idx INT)[] AS kept FROM ends
      UNION ALL
      SELECT track_id, k, list_sort(list_transform(list_zip(changed, range(1, len(changed) + 1)),
               lambda z: {{'low': z[1].low, 'spot': z[2], 't': z[1].t, 'frame_id': z[1].frame_id, 'det_idx': z[1].det_idx}}))[1:8]
      FROM (
        SELECT track_id, k, CASE WHEN near IS NULL THEN list_append(kept, own) WHEN own.low < kept[near].low
                 THEN list_concat(list_append(kept[1:near - 1], own), kept[near + 1:]) ELSE kept END AS changed
        FROM (
          SELECT w.track_id, p.k, w.kept, {{'low': -p.score, 'spot': 0::BIGINT, 't': p.t, 'frame_id': p.frame_id, 'det_idx': p.det_idx}} AS own,
                 list_filter(range(1, len(w.kept) + 1), lambda i: abs(p.t - w.kept[i].t) < 400)[1] AS near
          FROM walk w JOIN ordered p ON p.track_id = w.track_id AND p.k = w.k + 1)))""",
)

ORACLES["greedy_eval"] = rel(
    "SELECT video, det_idx, best.gt_idx AS gt_idx, round(best.dt, 6) AS dt FROM walk WHERE k > 0 AND best IS NOT NULL",
    "truth",
    "detections",
    recursive=True,
    then="""
    choices AS MATERIALIZED (
      SELECT d.video, d.det_idx, row_number() OVER (PARTITION BY d.video ORDER BY d.det_s, d.det_idx) AS k, c.choice
      FROM detections d LEFT JOIN (
        SELECT d.det_idx, list_sort(list({'dt': abs(t.gt_s - d.det_s), 'gt_idx': t.gt_idx})) AS choice
        FROM detections d JOIN truth t ON t.video = d.video AND abs(t.gt_s - d.det_s) < 25 GROUP BY d.det_idx) c USING (det_idx)),
    walk AS (
      SELECT DISTINCT video, 0::BIGINT AS k, NULL::BIGINT AS det_idx, NULL::STRUCT(dt DOUBLE, gt_idx BIGINT) AS best, []::BIGINT[] AS used FROM detections
      UNION ALL
      SELECT video, k, det_idx, best, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.gt_idx) END
      FROM (SELECT c.video, c.k, c.det_idx, w.used, list_filter(c.choice, lambda x: NOT list_contains(w.used, x.gt_idx))[1] AS best
            FROM walk w JOIN choices c ON c.video = w.video AND c.k = w.k + 1))""",
)

"""One query for each operator, over the whole bridge relations."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import boxes as bx
from ..functions import clocks, geometry, plates, scores
from ..operators import dedup, fusion, matching, ordering, ranking, reports, sampling, telemetry, tracks, voting
from ..sources import bridge, files, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: A pause of twelve hours plays the part of three seconds on the bridge tracks.
SPARSE = replace(DEFAULT, idle_seconds=43_200.0, post_window_seconds=3_600.0)
TRACK = ["clip_id", "track_id"]
WHEN = ["t_s", "event_id"]


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def keeper(spark: SparkSession, label: str):
    """keep(frame, name): written to the shared folder and read back."""
    return store.Shared(spark, f"{label}-{uuid.uuid4().hex}").keep


def _r(c, n: int = 6):
    return F.round(c, n)


# Tracks ------------------------------------------------------------------------------------------------------------


@query
def crossing_events(spark, sf_dir):
    found = tracks.crossings(bridge.points(spark, sf_dir), TRACK, WHEN)
    return found.select(*TRACK, F.col("n_points").cast("bigint").alias("n_points"), "state", "direction", _r("crossing_s").alias("crossing_s"), _r("crossing_y").alias("crossing_y"))


@query
def crossing_by_direction(spark, sf_dir):
    found = tracks.crossings(bridge.points(spark, sf_dir), TRACK, WHEN)
    return found.groupBy("clip_id", "state", "direction").agg(F.count("*").alias("n"))


@query
def track_emission(spark, sf_dir):
    points = bridge.points(spark, sf_dir)
    found = tracks.emitted(tracks.crossings(points, TRACK, WHEN, SPARSE), points, s=SPARSE)
    return found.select(*TRACK, "direction", _r("committed_s").alias("committed_s"), _r("emit_s").alias("emit_s"))


@query
def late_emission(spark, sf_dir):
    parts = tracks.segments(bridge.points(spark, sf_dir), "track_id", s=SPARSE, order=("t_s", "event_id"))
    found = tracks.late_emission(parts, [*TRACK, "segment"], WHEN, SPARSE)
    return found.select(*TRACK, "segment", F.col("n_points").cast("bigint").alias("n_points"), "state", "emitted", "direction", _r("last_s").alias("last_s"), "reason")


@query
def stitch_tracks(spark, sf_dir):
    """Ids that change every other event are joined again.  The window after a crossing never ends here, so no track is
    emitted; tests hold emission against a plain fold."""
    points = bridge.points(spark, sf_dir)
    wide = replace(DEFAULT, stitch_gap=(0.05, 3600.0), idle_seconds=3600.0, post_window_seconds=1e12)
    rows = points.select("clip_id", (F.col("track_id") * 2 + F.col("event_id") % 2).alias("track_id"), "t_s", "x", "y", "vehicle_class")
    found = tracks.stitched(rows, s=wide).groupBy("clip_id", "root_id", "root_s").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("ids"))
    return found.withColumn("root_s", _r("root_s"))


@query
def geom_side_distance(spark, sf_dir):
    p = bridge.points(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    return p.select("event_id", geometry.side(x, y, DEFAULT.line).alias("side"), _r(geometry.distance(x, y, DEFAULT.line)).alias("distance"))


@query
def segment_intersect(spark, sf_dir):
    p = bridge.points(spark, sf_dir)
    hit = geometry.intersects(F.lit(400.0), F.lit(1000.0), F.col("x"), F.col("y"), ((300.0, 1250.0), (1600.0, 1100.0)))
    return p.select("event_id", hit.alias("hit"))


@query
def polygon_filter(spark, sf_dir):
    b = bridge.boxes(spark, sf_dir)
    at = {k: bx.to_frame(F.col(k), DEFAULT.crop_x if k[0] == "x" else DEFAULT.crop_y) for k in ("x1", "y1", "x2", "y2")}
    f = b.select("frame_id", "det_idx", *[v.alias(f"f{k}") for k, v in at.items()])
    x, y = F.floor((F.col("fx1") + F.col("fx2")) / 2), F.col("fy2")
    kept = f.where(~bx.parked(F.col("fx2"), F.col("fy2")))
    return kept.where(geometry.in_polygon(x, y, DEFAULT.polygon)).select("frame_id", "det_idx", "fx1", "fy1", "fx2", "fy2")


@query
def detection_rejections(spark, sf_dir):
    """The side output: why a detection was dropped, the curb before the polygon."""
    b = bridge.boxes(spark, sf_dir)
    x2, y2 = bx.to_frame(F.col("x2"), DEFAULT.crop_x), bx.to_frame(F.col("y2"), DEFAULT.crop_y)
    x = F.floor((bx.to_frame(F.col("x1"), DEFAULT.crop_x) + x2) / 2)
    reason = F.when(bx.parked(x2, y2), "parked_curb_filter").when(~geometry.in_polygon(x, y2, DEFAULT.polygon), "outside_gravel_polygon")
    return b.select("frame_id", "det_idx", reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query
def box_translate(spark, sf_dir):
    b = bridge.boxes(spark, sf_dir)
    cx, cy = bx.contact_point(F.col("x1"), F.col("x2"), F.col("y2"))
    return b.select(
        "frame_id", "det_idx", *[bx.to_frame(F.col(k), DEFAULT.crop_x if k[0] == "x" else DEFAULT.crop_y).alias(f"f{k}") for k in ("x1", "y1", "x2", "y2")],
        _r(cx).alias("contact_x"), _r(cy).alias("contact_y"),
    )


@query
def class_remap(spark, sf_dir):
    b = bridge.boxes(spark, sf_dir)
    return b.groupBy("class_id", bx.vehicle_class(F.col("class_id")).alias("vehicle_class")).agg(F.count("*").alias("n"))


@query
def detector_mask(spark, sf_dir):
    """Centred boxes in letterbox pixels back to the image, by confidence and class."""
    b = bridge.boxes(spark, sf_dir).where((F.col("conf") >= 0.35) & F.col("class_id").isin(0, 1, 2, 3, 5, 7))
    scale = bx.letterbox(F.lit(2300.0), F.lit(1064.0), 416)[0]
    c = bx.detector_box((F.col("x1") + F.col("x2")) / 2 * scale, (F.col("y1") + F.col("y2")) / 2 * scale, (F.col("x2") - F.col("x1")) * scale, (F.col("y2") - F.col("y1")) * scale, scale, 2300, 1064)
    return b.select("frame_id", "det_idx", *[_r(v, 4).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), c, strict=True)])


@query
def plate_box_pad(spark, sf_dir):
    b = bridge.boxes(spark, sf_dir)
    i = {k: F.col(k).cast("int") for k in ("x1", "y1", "x2", "y2")}
    ok = b.where(bx.plate_box_ok(i["x2"] - i["x1"], i["y2"] - i["y1"]))
    p = bx.padded(i["x1"], i["y1"], i["x2"], i["y2"], F.lit(2300), F.lit(1064))
    return ok.select("frame_id", "det_idx", *[v.alias(k) for k, v in zip(("px1", "py1", "px2", "py2"), p, strict=True)])


@query
def letterbox_scale(spark, sf_dir):
    b = bridge.boxes(spark, sf_dir)
    s, w, h = bx.letterbox(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 416)
    return b.select("frame_id", "det_idx", _r(s).alias("scale"), w.alias("width"), h.alias("height"))


@query
def adaptive_sampling(spark, sf_dir):
    """Sequential by nature: the detector's finds feed back."""
    p = bridge.points(spark, sf_dir).select(
        "clip_id", F.col("event_id").alias("frame_idx"), (F.col("t_s") / 600).alias("t_s"), (F.col("k") < 20).alias("motion"), (F.col("value") > 100).alias("vehicle")
    )
    return sampling.adaptive_sampling(p).groupBy("clip_id", "state", "run").agg(F.count("*").alias("n"))


@query
def nms(spark, sf_dir):
    return sampling.suppressed(bridge.boxes(spark, sf_dir)).select("frame_id", "det_idx")


@query
def box_association(spark, sf_dir):
    """Sequential within a clip; a test holds its tracks on a known scene."""
    b = bridge.boxes(spark, sf_dir).select(
        F.floor(F.col("frame_id") / 100).alias("clip_id"), F.col("frame_id").alias("frame_idx"), "det_idx", "x1", "y1", "x2", "y2", "conf"
    )
    return sampling.associated(b).groupBy("clip_id").agg(F.count_distinct("track_id").alias("tracks"), F.count("*").alias("boxes"))


# Ranking -----------------------------------------------------------------------------------------------------------


def _vehicle_frames(spark, sf_dir):
    b = bridge.boxes(spark, sf_dir)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    edge = F.least(F.col("x1"), F.col("y1"), 2300 - F.col("x2"), 1064 - F.col("y2"))
    return b.select(
        "frame_id", "det_idx", F.pmod("frame_id", F.lit(500)).alias("track_id"), F.col("frame_id").cast("double").alias("t_s"),
        scores.vehicle_score(F.col("sharpness"), area, F.col("conf"), edge).alias("score"),
    )


@query
def vehicle_score(spark, sf_dir):
    return _vehicle_frames(spark, sf_dir).select("frame_id", "det_idx", _r("score", 10).alias("score"))


@query
def plate_score(spark, sf_dir):
    b = bridge.boxes(spark, sf_dir)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    s = scores.plate_score(F.col("conf"), w, h, F.col("sharpness") * 10, F.pmod("frame_id", F.lit(10)) / 10.0)
    return b.select("frame_id", "det_idx", _r(s, 10).alias("score"))


@query
def top_m_frames(spark, sf_dir):
    found = ranking.top_vehicles(_vehicle_frames(spark, sf_dir), ["track_id"], ["frame_id", "det_idx"])
    return found.select("track_id", "rank", "frame_id", "det_idx")


@query
def top_k_plates(spark, sf_dir):
    reads = bridge.readings(spark, sf_dir).withColumns({"score": F.col("plate_score"), "group": F.pmod("event_id", F.lit(1000))})
    return ranking.top_plates(reads, ["group"], ["event_id", "ord"]).select("group", "rank", "event_id", "ord")


@query
def top_m_diverse(spark, sf_dir):
    """Sequential within a track."""
    found = ranking.top_apart(_vehicle_frames(spark, sf_dir), ["track_id"], ["frame_id", "det_idx"], 8, 400.0)
    return found.select("track_id", "rank", "frame_id", "det_idx")


@query
def vote_order(spark, sf_dir):
    """Readings that their figures don't tell apart stay as they came: by their place in the file."""
    found = ranking.votes_list(bridge.readings(spark, sf_dir, placed=True), ["event_id"], "ord", "file", "row")
    return found.select("event_id", F.get_json_object("votes", "$[0].text").alias("first"), F.json_array_length("votes").cast("bigint").alias("n"))


# Plates ------------------------------------------------------------------------------------------------------------


def _raw(spark, sf_dir):
    """Readings as an engine might print them: with a hyphen, spaces, in small letters, or cut short."""
    r = bridge.readings(spark, sf_dir)
    k = F.pmod(F.col("event_id") + F.col("ord"), F.lit(9))
    text = F.when(k == 0, F.concat(F.substring("text", 1, 3), F.lit("-"), F.substring("text", 4, 9))).when(k == 1, F.concat(F.lit("  "), F.lower("text"), F.lit(" ")))
    text = text.when(k == 2, F.substring("text", 1, 6)).when(k == 3, F.substring("text", 1, 2)).when(k == 4, F.lit("---")).when(k == 5, F.concat(F.substring("text", 1, 2), F.substring("text", 4, 4)))
    return r.withColumn("raw", F.when(k == 6, F.lit(None)).otherwise(text.otherwise(F.col("text"))))


@query
def plate_normalize(spark, sf_dir):
    return _raw(spark, sf_dir).select("event_id", "ord", plates.normalize(F.col("raw")).alias("normalized"), plates.clean(F.col("raw")).alias("cleaned"))


@query
def plate_correct(spark, sf_dir):
    return _raw(spark, sf_dir).select("event_id", "ord", plates.correct(plates.normalize(F.col("raw"))).alias("corrected"))


@query
def plate_status(spark, sf_dir):
    review = F.pmod("event_id", F.lit(10)) == 0
    return _raw(spark, sf_dir).select("event_id", "ord", plates.status(F.col("raw"), F.col("ocr_conf"), review).alias("status"))


@query
def plate_reasons(spark, sf_dir):
    review = F.pmod("event_id", F.lit(10)) == 0
    rows = _raw(spark, sf_dir).withColumn("norm", plates.normalize(F.col("raw")))
    return rows.select("event_id", "ord", plates.reasons(F.col("norm"), F.col("ocr_conf"), review).alias("reason"))


@query
def plausible_plate(spark, sf_dir):
    return _raw(spark, sf_dir).select("event_id", "ord", plates.plausible(plates.normalize(F.col("raw"))).alias("plausible"))


@query
def ocr_gate(spark, sf_dir):
    ok = plates.accepted(F.col("raw"), F.col("ocr_conf"))
    return _raw(spark, sf_dir).select("event_id", "ord", F.when(ok, F.col("raw")).alias("plate"), _r(F.when(ok, F.col("ocr_conf")).otherwise(0.0)).alias("ocr_conf"), "det_conf")


@query
def province_lookup(spark, sf_dir):
    r = bridge.readings(spark, sf_dir)
    return r.groupBy(plates.province(F.col("text")).alias("province")).agg(F.count("*").alias("n"))


@query
def consensus_vote(spark, sf_dir):
    s = replace(DEFAULT, prior_beta=0.10, review_threshold=0.15)
    found = voting.consensus(bridge.readings(spark, sf_dir), "event_id", "ord", s)
    return found.select("event_id", "text", _r("consensus_conf").alias("consensus_conf"), _r("score").alias("score"), "reads", "needs_review")


@query
def logodds_fusion(spark, sf_dir):
    found = voting.log_odds(bridge.readings(spark, sf_dir), "event_id", "ord", 0.10)
    return found.select("event_id", "text", _r("score").alias("score"), "consensus_conf")


@query
def two_tier_combine(spark, sf_dir):
    r = bridge.readings(spark, sf_dir)
    rows = r.select(
        "event_id", "ord", (F.lit(20) + F.pmod("event_id", F.lit(40))).cast("double").alias("width"), (F.lit(20) + F.pmod(F.col("event_id") * 7, F.lit(40))).cast("double").alias("height"),
        F.substring("text", 1, 2).alias("top"), F.expr("substring(text, 3, 2 + ord)").alias("bottom"),
        F.array("ocr_conf", "det_conf").alias("top_confs"), F.array("plate_score").alias("bottom_confs"), "plate_score",
    )
    return voting.two_tier(rows).select("event_id", "ord", "text", _r("ocr_conf").alias("ocr_conf"), _r("plate_score").alias("plate_score"))


# Duplicates --------------------------------------------------------------------------------------------------------


@query
def intra_dedup(spark, sf_dir):
    p = bridge.points(spark, sf_dir).select("clip_id", "track_id", F.concat(F.lit("LINE_"), F.pmod("k", F.lit(3)).cast("string")).alias("line_id"), "event_id", "t_s")
    return dedup.within_clip(p, WHEN).select("event_id", "first")


@query
def emission_order(spark, sf_dir):
    e = bridge.plate_events(spark, sf_dir)
    return ordering.numbered(e, "t_s", F.col("event_id")).select("event_id", F.col("rn").cast("bigint").alias("rn"))


@query
def inter_dedup(spark, sf_dir):
    e = ordering.numbered(bridge.plate_events(spark, sf_dir), "t_s", F.col("event_id"))
    return dedup.across_clips(e.select("event_id", "rn", "t_s", "direction", "plate", "ocr_conf")).select("event_id", "duplicate_of")


@query
def visual_similarity(spark, sf_dir):
    """Correlation of each vector with the next of its label."""
    from pyspark.sql.window import Window

    v = bridge.table(spark, sf_dir, "embeddings")
    pairs = v.withColumn("next", F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).where("next is not null")
    return pairs.select("vec_id", _r(dedup.correlation(F.col("embedding"), F.col("next")), 5).alias("similarity"))


# Matching ----------------------------------------------------------------------------------------------------------


def _audit_events(spark, sf_dir):
    e = bridge.plate_events(spark, sf_dir)
    return e.select(F.col("event_id").alias("evt_idx"), F.col("plate").alias("event_plate"), F.col("t_s").alias("event_s"))


def _named(spark, sf_dir):
    """Detections by event id, and the truth by its source; some of both don't name their clip."""
    d, t = bridge.detections(spark, sf_dir), bridge.truth(spark, sf_dir)
    number = F.concat(F.lit("("), "video", F.lit(")"))
    name = F.concat(F.lit("EVT_"), F.when(F.col("det_idx") % 41 != 0, number).otherwise("cam"), F.lit("_"), F.col("det_idx").cast("string"), F.lit("_"), F.floor("det_s").cast("string"))
    source = F.concat(F.lit("Camara"), F.when(F.col("gt_idx") % 37 != 0, number).otherwise(""), F.lit(".mp4"))
    return d.withColumn("event_id", name), t.withColumn("video_source", source)


@query
def asof_gt(spark, sf_dir):
    """Events and records that don't name their clip may meet any."""
    d, t = _named(spark, sf_dir)
    found = matching.nearest_by_clip(
        d.withColumn("clip", clocks.clip_key(F.col("event_id"))), t.select("gt_idx", "gt_s", clocks.clip_key(F.col("video_source")).alias("clip")), "det_idx", "det_s", "gt_s", 6.0, "gt_idx"
    )
    return found.select("det_idx", "gt_idx", _r("dt").alias("dt"))


@query
def asof_event_id(spark, sf_dir):
    """Clip and second come from the event's id."""
    d, t = _named(spark, sf_dir)
    found = matching.by_event_id(d.select("event_id", "det_idx"), t.select("gt_idx", "gt_s", "video_source"), "event_id")
    return found.select("det_idx", "gt_idx", _r("dt").alias("dt"))


@query
def plate_dataset(spark, sf_dir):
    """Plate candidates with what the ground truth says of them."""
    d, t = _named(spark, sf_dir)
    records = t.select(
        "gt_idx", F.col("gt_s").alias("approx_timestamp"), "video_source", F.concat(F.lit("GT_"), F.col("gt_idx").cast("string")).alias("ground_truth_id"),
        F.col("plate").alias("plate_text"), F.col("legible").alias("plate_legible"), F.lit(None).cast("string").alias("province"), F.lit("car").alias("vehicle_type"),
    )
    found = matching.labelled(d.select("event_id", F.when(F.col("det_idx") % 53 != 0, F.col("det_s")).alias("timestamp")), records, "gt_idx")
    return found.select("event_id", "ground_truth_id", "ground_truth_plate", "plate_legible", "province", "vehicle_type")


@query
def band_fuzzy_pairs(spark, sf_dir):
    found = matching.candidate_pairs(bridge.audit(spark, sf_dir), _audit_events(spark, sf_dir))
    return found.select("audit_idx", "evt_idx", "tier", _r("score", 4).alias("score"), "distance")


@query
def greedy_assign(spark, sf_dir):
    """Tests hold it against the sequential greedy pass."""
    pairs = matching.candidate_pairs(bridge.audit(spark, sf_dir), _audit_events(spark, sf_dir))
    found = matching.one_to_one(pairs, "audit_idx", "evt_idx", ["tier", "score"], keeper(spark, "assign"))
    return found.select("audit_idx", "evt_idx", "tier")


@query
def match_histogram(spark, sf_dir):
    found = matching.candidate_pairs(bridge.audit(spark, sf_dir), _audit_events(spark, sf_dir))
    return found.groupBy("tier").agg(F.count("*").alias("pairs"), F.count_distinct("evt_idx").alias("events"))


@query
def exact_plate_fallback(spark, sf_dir):
    return matching.by_equal_plate(bridge.audit(spark, sf_dir), _audit_events(spark, sf_dir), "audit_idx", "evt_idx", "audit_plate", "event_plate", "audit_s", "event_s")


@query
def audit_crossvalidate(spark, sf_dir):
    return matching.cross_validated(bridge.audit(spark, sf_dir), _audit_events(spark, sf_dir), 20.0)


@query
def fuzzy_plate_equality(spark, sf_dir):
    pairs = matching.banded(bridge.audit(spark, sf_dir), _audit_events(spark, sf_dir), "audit_s", "event_s", 60.0)
    return pairs.select("audit_idx", "evt_idx", plates.same_plate(F.col("audit_plate"), F.col("event_plate")).alias("same"))


def _windows(spark, sf_dir):
    span = bridge.plate_events(spark, sf_dir).agg(F.max("t_s").alias("top")).first().top or 0.0
    n = int(span // 325) + 1
    return spark.range(n).where("id % 3 <> 1").select(F.col("id").alias("win_idx"), (F.col("id") * 325.0).alias("win_start"), (F.col("id") * 325.0 + 330.0).alias("win_end"))


@query
def clip_windows(spark, sf_dir):
    a = bridge.audit(spark, sf_dir).select("audit_idx", "audit_s")
    return matching.in_windows(a, _windows(spark, sf_dir), "audit_s", 15.0, 330.0).select("audit_idx", "win_idx")


def _audit_report(spark, sf_dir):
    a = bridge.audit(spark, sf_dir)
    a = a.withColumn("audit_s", F.when(F.col("audit_idx") % 29 != 0, F.col("audit_s")))
    return matching.audit_report(a, _audit_events(spark, sf_dir), _windows(spark, sf_dir), 20.0, 330.0)


@query
def audit_report(spark, sf_dir):
    """Entries within the clips' windows against events; some entries have no time."""
    return _audit_report(spark, sf_dir)


@query
def audit_recall(spark, sf_dir):
    return matching.audit_recall(_audit_report(spark, sf_dir)).withColumn("recall", _r("recall", 4))


@query
def match_outcomes(spark, sf_dir):
    """Entries by how they were matched, one to one and then by plate alone, and the events left over."""
    a, e = bridge.audit(spark, sf_dir), _audit_events(spark, sf_dir)
    taken = matching.one_to_one(matching.candidate_pairs(a, e), "audit_idx", "evt_idx", ["tier", "score"], keeper(spark, "outcomes"))
    return matching.outcomes(a, e, taken)


@query
def audit_log(spark, sf_dir):
    """Rows of a thirteen-column sheet."""
    e = bridge.plate_events(spark, sf_dir)
    k = F.col("event_id")
    h, m = F.pmod("user_id", F.lit(30)).cast("string"), F.lpad(F.pmod("k", F.lit(60)).cast("string"), 2, "0")
    time = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, F.lit("noon")).when(k % 5 == 2, F.concat(h, F.lit(":"), m)).otherwise(F.concat(h, F.lit(": "), m, F.lit(":"), m))
    none = F.lit(None).cast("string")
    cells = F.array(F.when(k % 6 != 0, F.concat(F.lit(" "), F.lower("true_plate"))), F.lit(" car "), none, F.lit(""), time, *[none] * 3, (k % 4).cast("string"), none, *[none] * 3)
    return files.audit_log(e.select(k.alias("row_idx"), cells.alias("cells")))


@query
def audit_clip_start(spark, sf_dir):
    c = bridge.clips(spark, sf_dir)
    return c.select("clip_id", F.date_format(clocks.audit_clip_start(F.col("clip_id")), "yyyy-MM-dd HH:mm:ss").alias("start"))


@query
def greedy_eval(spark, sf_dir):
    """Each detection in the order of time takes the nearest free record."""
    found = matching.evaluated(bridge.detections(spark, sf_dir), bridge.truth(spark, sf_dir).select("video", "gt_idx", "gt_s"))
    return found.select("video", "det_idx", "gt_idx", _r("dt").alias("dt"))


@query
def eval_metrics(spark, sf_dir):
    """Over as-of matches, which SQL has too."""
    d, t = bridge.detections(spark, sf_dir), bridge.truth(spark, sf_dir)
    near = matching.nearest(t, d.select("video", "det_idx", "det_s"), "gt_idx", "gt_s", "det_s", 9.0, "det_idx", ["video"]).where("det_idx is not null")
    found = matching.metrics(t, d, near.select("video", "gt_idx", "det_idx"))
    return found.select(*[_r(c).alias(c) if k == "double" else F.col(c).cast("bigint").alias(c) for c, k in found.dtypes])


@query
def run_diff(spark, sf_dir):
    e = bridge.store_events(spark, sf_dir).select(F.col("video_source").alias("video"), "event_id", "event_timestamp", "direction", "plate_raw", "ocr_conf", F.col("duplicate_of").isNull().alias("own"))
    k = F.regexp_extract("event_id", r"(\d+)", 1).cast("bigint")
    other = e.withColumns({"plate_raw": F.when(k % 50 == 0, F.lit("XXX0000")).otherwise(F.col("plate_raw")), "ocr_conf": F.when(k % 70 == 0, F.col("ocr_conf") + 0.01).otherwise(F.col("ocr_conf") + 1e-9)})
    return matching.run_diff(e, other, ["event_timestamp", "event_id"], ["event_timestamp", "direction", "plate_raw", "ocr_conf", "own"]).withColumn("position", F.col("position").cast("bigint"))


# Telemetry ---------------------------------------------------------------------------------------------------------


@query
def run_timing_totals(spark, sf_dir):
    found = telemetry.timing_totals(bridge.clips(spark, sf_dir))
    return found.select("run_id", *[_r(c, 3).alias(c) for c in telemetry.TIMES])


@query
def latest_run(spark, sf_dir):
    return telemetry.latest_run(bridge.runs(spark, sf_dir))


@query
def executive_summary(spark, sf_dir):
    found = telemetry.kpis(telemetry.clip_statistics(bridge.clips(spark, sf_dir), bridge.runs(spark, sf_dir)))
    return found.select(*[_r(c, 4).alias(c) if k == "double" else F.col(c) for c, k in found.dtypes])


@query
def event_counts(spark, sf_dir):
    e = bridge.store_events(spark, sf_dir).withColumn("plate_status", F.when(F.col("ocr_conf") >= 0.8, "OK").otherwise("REVISION_MANUAL"))
    return telemetry.event_counts(e, ["processing_run_id"])


@query
def distinct_tracks(spark, sf_dir):
    return bridge.points(spark, sf_dir).groupBy("clip_id").agg(F.count_distinct("track_id").alias("tracks"))


@query
def latency_blocks(spark, sf_dir):
    calls = bridge.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("stage"), "l_orderkey", "l_linenumber", F.col("l_quantity").alias("ms"))
    found = telemetry.latency_blocks(calls, ["stage"], ["l_orderkey", "l_linenumber", "ms"], "ms")
    return found.select("stage", "block", "n", "mean_ms", "min_ms", "max_ms", "range")


@query
def latency_percentiles(spark, sf_dir):
    calls = bridge.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).alias("stage"), F.col("l_quantity").alias("ms"))
    found = telemetry.percentiles(calls, ["stage"], "ms")
    return found.select("stage", *[_r(c).alias(c) for c in ("p50", "p95", "mean", "min", "max")])


def _stages(spark, sf_dir):
    c = bridge.clips(spark, sf_dir)
    names = ("decode_seconds", "vehicle_detection_seconds", "staging_seconds", "file_hash_seconds", "clock_read_seconds")
    stack = ", ".join(f"'{n}', {n}" for n in names)
    return c.select("run_id", "clip_no", F.expr(f"stack({len(names)}, {stack}) as (stage, seconds)"), F.lit(1).alias("calls"))


@query
def stage_summary(spark, sf_dir):
    wall = bridge.clips(spark, sf_dir).groupBy("run_id").agg(F.sum("wall_clock_seconds").alias("wall"))
    return telemetry.stage_summary(_stages(spark, sf_dir), wall, "run_id")


@query
def clip_deltas(spark, sf_dir):
    from pyspark.sql.window import Window

    w = Window.partitionBy("run_id").orderBy("clip_no").rowsBetween(Window.unboundedPreceding, 0)
    c = bridge.clips(spark, sf_dir).select("run_id", "clip_no", F.sum("total_frames").over(w).cast("double").alias("counter"))
    return telemetry.clip_deltas(c, ["run_id"], ["clip_no"], "counter").select("clip_no", "delta")


@query
def gap_breakdown(spark, sf_dir):
    t = telemetry.timing_totals(bridge.clips(spark, sf_dir)).withColumns({"startup_seconds": F.lit(14.5), "export_seconds": F.lit(2.25)})
    found = telemetry.gap_breakdown(t.withColumn("total_wall", F.col("wall_clock_seconds") + F.col("staging_seconds") + 20.0), ["run_id"])
    return found.select("run_id", "segment", _r("seconds", 3).alias("seconds"), "pct")


@query
def run_totals(spark, sf_dir):
    found = telemetry.run_totals(bridge.clips(spark, sf_dir).withColumn("total_wall", F.lit(1000.0)))
    return found.select("run_id", "events", "frames", *[_r(c, 3).alias(c) for c in ("video_s", "process_s", "speed_ratio")])


@query
def param_sweep(spark, sf_dir):
    """Accuracy by confidence limit and prior over all readings: 4 x 3 combinations in one scan."""
    r = bridge.readings(spark, sf_dir)
    ok = (F.col("ocr_conf") + F.when(F.col("text").startswith("P"), F.col("beta")).otherwise(0.0)) >= F.col("limit")
    return telemetry.sweep(r, {"limit": [0.6, 0.7, 0.8, 0.9], "beta": [0.0, 0.05, 0.1]}, [F.count(F.when(ok, 1)).alias("accepted"), F.count("*").alias("n")], [])


@query
def ocr_matrix(spark, sf_dir):
    """Three models, three numbers of readings, two fusions and four priors over all readings."""
    r = bridge.readings(spark, sf_dir)
    made = [("a", F.col("text"), F.col("ocr_conf")), ("b", F.col("text"), F.col("ocr_conf") * 0.9), ("c", F.translate("text", "7", "1"), F.col("ocr_conf"))]
    models = F.array(*[F.struct(F.lit(m).alias("model"), t.alias("text"), c.alias("ocr_conf")) for m, t, c in made])
    truth = bridge.order_plates(spark, sf_dir).select("event_id", "plate", (F.col("event_id") % 3 != 0).alias("legible"))
    return fusion.matrix(r, truth, "event_id", "ord", models)


@query
def largest_crops(spark, sf_dir):
    b = bridge.boxes(spark, sf_dir)
    size = F.concat((F.col("x2") - F.col("x1")).cast("int").cast("string"), F.lit("x"), (F.col("y2") - F.col("y1")).cast("int").cast("string"))
    crops = b.select((F.col("frame_id") % 500).alias("target"), "frame_id", "det_idx", size.alias("crop_size"))
    return fusion.largest_crops(crops, ["target"], "crop_size", ["frame_id", "det_idx"])


@query
def detector_bench(spark, sf_dir):
    b = bridge.boxes(spark, sf_dir).groupBy("frame_id").agg(F.count(F.when(F.col("conf") >= 0.6, 1)).alias("n_found"), F.max("conf").alias("best_conf"), F.max("sharpness").alias("ms"))
    found = telemetry.hit_rate(b.withColumn("model", F.pmod("frame_id", F.lit(3))), ["model"])
    return found.select("model", *[_r(c).alias(c) for c in ("hit_pct", "mean_conf", "mean_ms")])


# Reports and names -------------------------------------------------------------------------------------------------


def _report_events(spark, sf_dir):
    e = bridge.store_events(spark, sf_dir)
    norm = plates.normalize(F.col("plate_raw"))
    votes = F.when(F.col("plate_raw").isNull(), F.lit(None).cast("string")).when(F.col("n_votes") == 0, F.lit("[]")).when(F.col("n_votes") == 1, F.lit("not json")).otherwise(
        F.concat(F.lit('[["'), F.col("plate_raw"), F.lit('", 0.9], ["'), F.lower("plate_raw"), F.lit('", 0.8], ["ZZZ0000", 0.5]]'))
    )
    return e.withColumns({
        "confidence_ocr": F.col("ocr_conf"), "ocr_votes": votes, "plate_corrected": plates.correct(norm),
        "plate_status": plates.status(F.col("plate_raw"), F.col("ocr_conf"), F.lit(False)), "plate_correction_reason": plates.reasons(norm, F.col("ocr_conf"), F.lit(False)),
    })


@query
def certainty_labels(spark, sf_dir):
    e = _report_events(spark, sf_dir)
    label, consensus = reports.certainty(*[F.col(c) for c in ("plate_corrected", "plate_status", "confidence_ocr", "ocr_votes", "plate_correction_reason")])
    return e.select("event_id", label.alias("certainty"), consensus.alias("consensus"))


@query
def report_rows(spark, sf_dir):
    found = reports.report_rows(_report_events(spark, sf_dir))
    return found.select(F.col("no").cast("bigint").alias("no"), "processing_run_id", "event_id", "datetime_str", "direction", "plate", "certainty")


@query
def report_duplicates(spark, sf_dir):
    found = reports.report_rows(_report_events(spark, sf_dir), duplicates=True)
    return found.select(F.col("no").cast("bigint").alias("no"), "event_id", "duplicate_of", "vehicle_type")


@query
def natural_sort(spark, sf_dir):
    """Each clip's place in the natural order of its run."""
    from pyspark.sql.window import Window

    c = bridge.clips(spark, sf_dir)
    w = Window.partitionBy("run_id").orderBy(*clocks.natural_key(F.col("clip_id")))
    return c.select("run_id", "clip_id", F.row_number().over(w).cast("bigint").alias("place"))


@query
def clip_filter(spark, sf_dir):
    c = bridge.clips(spark, sf_dir)
    return c.where(clocks.clip_number(F.col("clip_id")).isin(5, 60, 61, 1000)).select("clip_id")


@query
def clip_start_time(spark, sf_dir):
    c = bridge.clips(spark, sf_dir)
    k = F.col("clip_no") % 4
    name = F.when(k == 0, F.col("clip_id")).when(k == 1, F.concat(F.lit("cam_20240315091500_"), F.col("clip_no").cast("string"), F.lit(".avi"))).when(k == 2, F.lit("cam_20240316.mkv")).otherwise(F.lit("x.mp4"))
    return c.select("clip_no", F.date_format(clocks.clip_start(name), "yyyy-MM-dd HH:mm:ss").alias("start"))


@query
def event_names(spark, sf_dir):
    e = bridge.plate_events(spark, sf_dir)
    clip = F.concat(F.lit("cam("), F.pmod("user_id", F.lit(90)).cast("string"), F.lit(").mp4"))
    return e.select("event_id", clocks.event_id(clip, F.col("user_id") * 101, F.col("t_s")).alias("name"), clocks.dedup_key(F.col("plate"), F.col("direction")).alias("dedup_key"))


@query
def event_datetime(spark, sf_dir):
    e = bridge.plate_events(spark, sf_dir)
    t = clocks.event_time(F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.floor("t_s").cast("double"))
    return e.select("event_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query
def time_cell_parse(spark, sf_dir):
    e = bridge.plate_events(spark, sf_dir)
    k = F.col("event_id") % 4
    h, m = F.pmod("user_id", F.lit(30)).cast("string"), F.lpad(F.pmod("k", F.lit(60)).cast("string"), 2, "0")
    cell = F.when(k == 0, F.concat(h, F.lit(":"), m)).when(k == 1, F.concat(h, F.lit(":"), m, F.lit(":"), m)).when(k == 2, F.lit("noon"))
    return e.select("event_id", clocks.time_of_day(cell).alias("seconds"))


@query
def time_of_day_filter(spark, sf_dir):
    e = bridge.store_events(spark, sf_dir)
    return e.where(F.substring("datetime_str", 12, 8).between("06:00:00", "18:30:00") & F.col("video_source").rlike(r"\((3|4|5)\)\.mp4$")).select("event_id", "datetime_str")


@query
def crop_listing(spark, sf_dir):
    """Crop files by the event that their names begin with."""
    r = bridge.readings(spark, sf_dir)
    name = F.concat(F.lit("EVT_("), F.pmod("event_id", F.lit(97)).cast("string"), F.lit(")_"), F.lpad(F.pmod("event_id", F.lit(1000)).cast("string"), 4, "0"), F.lit("_7_"), F.col("ord").cast("string"), F.lit(".jpg"))
    key = F.regexp_extract("name", r"(EVT_\(\d+\)_\d+_\d+)", 1)
    return r.select(name.alias("name")).groupBy(key.alias("event")).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("files"))


# Store -------------------------------------------------------------------------------------------------------------


@query
def upsert_latest(spark, sf_dir):
    e = bridge.plate_events(spark, sf_dir).select(F.concat(F.lit("EVT_"), F.pmod("event_id", F.lit(500)).cast("string")).alias("event_id"), F.col("event_id").alias("seq"), "direction", "plate")
    return store.latest(e, ["event_id"], "seq").select("event_id", "seq", "direction", "plate")


@query
def update_run(spark, sf_dir):
    r = bridge.runs(spark, sf_dir).select("run_id", "status", F.lit(None).cast("string").alias("finished_at"))
    change = r.where("run_id in ('RUN_1', 'RUN_2')").select("run_id", F.lit("DONE").alias("status"), F.lit("2024-02-01").alias("finished_at"))
    return store.updated(r, change, ["run_id"])


@query
def schema_evolution(spark, sf_dir):
    c = bridge.clips(spark, sf_dir)
    old = c.where("clip_no % 2 = 0").select("clip_id", "run_id", "duration_sec")
    found = store.evolved(old.unionByName(c.where("clip_no % 2 = 1").select("clip_id", "run_id", "duration_sec", "staging_seconds"), allowMissingColumns=True))
    return found.groupBy("run_id").agg(F.count("*").alias("n"), _r(F.sum("staging_seconds"), 3).alias("staging"), F.count("staging_seconds").alias("filled"))


@query
def constraint_checks(spark, sf_dir):
    e, r = bridge.store_events(spark, sf_dir), bridge.runs(spark, sf_dir)
    twice = store.repeated_keys(e.select(F.regexp_replace("event_id", "99$", "0").alias("event_id")), ["event_id"]).agg(F.count("*").alias("n")).select(F.lit("primary").alias("check"), "n")
    lost = store.missing_parents(e.select(F.concat("processing_run_id", F.lit("0")).alias("run_id")), r, "run_id").agg(F.count("*").alias("n")).select(F.lit("foreign").alias("check"), "n")
    return twice.unionByName(lost)


@query
def checkpoint_antijoin(spark, sf_dir):
    c = bridge.clips(spark, sf_dir).withColumn("file_hash", F.md5(F.col("clip_id")))
    return store.unprocessed(c.select("clip_id", "file_hash", "run_id"), c.where("clip_no % 5 <> 0")).select("clip_id", "run_id")


@query
def event_filter(spark, sf_dir):
    e = bridge.store_events(spark, sf_dir)
    return e.where((F.col("processing_run_id") == "RUN_3") & F.col("duplicate_of").isNull()).select("event_id", "event_timestamp")

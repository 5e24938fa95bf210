"""From points and readings to a table of events: the whole batch as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import clocks, plates
from ..operators import dedup, ordering, ranking, tracks, voting
from ..sources import store


_CHAIN = ["clip_id", "root_id", "root_s"]


def stages(points: DataFrame, readings: DataFrame, clips: DataFrame, run_id: str, s: Settings = DEFAULT) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Events of points(clip_id, track_id, event_order, t_s, x, y, vehicle_class), with plates from readings(clip_id,
    track_id, ord, text, ocr_conf, det_conf, plate_score, perhaps t_s), in the clips of clips(clip_id, path, clip_order);
    and what was rejected on the way, by its reason.

    Tracks are stitched, crossed or emitted late, and named; their best readings vote, pass the gate, and are corrected;
    duplicates within a clip go, those across clips are marked.  A reading with a time belongs to the chain that its track
    was part of then, one without to the track's first chain.
    """
    joined = tracks.stitched(points.drop("event_order"), s=s) if "root_id" not in points.columns else points
    joined = joined if "root_s" in joined.columns else joined.withColumn("root_s", F.lit(0.0))
    ended = tracks.late_emission(joined.withColumn("line_id", F.lit(s.line_id)), [*_CHAIN, "line_id"], ["t_s", "track_id"], s)
    kinds = joined.groupBy(*_CHAIN).agg(F.min_by("vehicle_class", "t_s").alias("vehicle_type"), F.max("track_id").alias("last_id"))
    found = ended.where("emitted").join(kinds, _CHAIN).join(clips, "clip_id")
    start, at = clocks.clip_start(F.col("path")), F.coalesce("crossing_s", "last_s")
    found = found.withColumns({
        "track_id": F.col("last_id"), "event_s": at, "event_id": clocks.event_id(F.col("path"), F.col("last_id"), at), "event_at": clocks.event_time(start, at),
    })
    counted = dedup.within_clip(found, ["event_s", "root_id", "root_s"])
    first = counted.where("first").drop("first")
    spans = joined.groupBy(*_CHAIN, "track_id").agg(F.min("t_s").alias("_from"), F.max("t_s").alias("_to"))
    if "t_s" in readings.columns:
        owned = readings.join(spans, ["clip_id", "track_id"]).where(F.col("t_s").between(F.col("_from"), F.col("_to"))).drop("t_s")
    else:
        owned = readings.join(spans.groupBy("clip_id", "track_id").agg(F.min_by(F.struct(*_CHAIN[1:]), "_from").alias("_c")).select("clip_id", "track_id", "_c.*"), ["clip_id", "track_id"])
    keyed = owned.drop("_from", "_to").join(first.select(*_CHAIN, "event_id"), _CHAIN)
    best_reads = ranking.top_plates(keyed.withColumn("score", F.col("plate_score")), ["event_id"], ["ord"], s).drop("score", "rank")
    voted = voting.consensus(best_reads, "event_id", "ord", s)
    votes = ranking.votes_list(best_reads, ["event_id"], "ord").withColumnRenamed("votes", "ocr_votes")
    best = keyed.groupBy("event_id").agg(F.max("det_conf").alias("confidence_plate"))
    merged = first.join(voted, "event_id", "left").join(best, "event_id", "left").join(votes, "event_id", "left")
    ok = plates.accepted(F.col("text"), F.col("consensus_conf"), s.min_ocr_confidence)
    read = merged.withColumns({"plate_raw": F.when(ok, F.col("text")), "confidence_ocr": F.when(ok, F.col("consensus_conf")).otherwise(0.0)})
    review = F.coalesce("needs_review", F.lit(False))
    norm = plates.normalize(F.col("plate_raw"))
    full = read.withColumns({
        "plate_normalized": norm, "plate_corrected": plates.correct(norm), "plate_status": plates.status(F.col("plate_raw"), F.col("confidence_ocr"), review),
        "plate_correction_reason": plates.reasons(F.col("plate_raw"), F.col("confidence_ocr"), review),
        "at_s": F.unix_micros(F.col("event_at").cast("timestamp")) / 1e6,
    })
    ranked = ordering.numbered(full, "at_s", F.col("clip_order"), F.col("root_id"), F.col("root_s"))
    seen = dedup.across_clips(ranked.select("event_id", "rn", F.col("at_s").alias("t_s"), "direction", F.col("plate_normalized").alias("plate"), F.col("confidence_ocr").alias("ocr_conf")), s)
    rows = ranked.join(seen.select("event_id", "duplicate_of"), "event_id").select(
        "event_id", F.lit(run_id).alias("processing_run_id"), clocks.basename(F.col("path")).alias("video_source"), F.col("event_s").alias("event_timestamp"),
        F.date_format("event_at", "yyyy-MM-dd HH:mm:ss").alias("datetime_str"), "direction", "vehicle_type", "plate_raw", "plate_normalized", "plate_corrected",
        "plate_correction_reason", "plate_status", F.coalesce("confidence_plate", F.lit(0.0)).alias("confidence_plate"), "confidence_ocr", "ocr_votes", "track_id", "line_id",
        clocks.dedup_key(F.col("plate_normalized"), F.col("direction")).alias("dedup_key"), "duplicate_of",
    )
    rejected = {
        "track_never_crossed": ended.where("not emitted").select("clip_id", F.col("root_id").alias("track_id"), F.col("last_s").alias("timestamp")),
        "plate_read_rejected": merged.where(F.col("text").isNotNull() & ~F.coalesce(ok, F.lit(False))).select("clip_id", "track_id", F.col("event_s").alias("timestamp"), "text", F.col("consensus_conf").alias("confidence")),
        "dedup_discarded": counted.where("not first").select("clip_id", "track_id", F.col("event_s").alias("timestamp")),
    }
    return rows, rejected


def events(points: DataFrame, readings: DataFrame, clips: DataFrame, run_id: str, s: Settings = DEFAULT) -> DataFrame:
    """The events of stages()."""
    return stages(points, readings, clips, run_id, s)[0]


def run(
    spark: SparkSession, points: DataFrame, readings: DataFrame, clips: DataFrame, out: str, run_id: str, sequence: int,
    s: Settings = DEFAULT, resume: bool = True, rejections: str | None = None,
) -> DataFrame:
    """Writes the events of clips that have no completed row yet, and the clips' own rows; returns the current events.

    clips may carry file_hash: then a clip is done only if the same content was, and a changed file under an old name is
    read again.  It may carry status: clips whose status is set and isn't COMPLETED, such as CORRUPTED ones, are recorded
    with it and give no events; so they come up again in the next run.  rejections: a folder of JSON lines.
    """
    work = clips if "status" in clips.columns else clips.withColumn("status", F.lit("COMPLETED"))
    work = work.withColumn("status", F.coalesce("status", F.lit("COMPLETED")))
    hashed = ["file_hash"] if "file_hash" in clips.columns else []
    if resume and store.exists(spark, f"{out}/clips"):
        done = store.read(spark, f"{out}/clips", ["clip_id"]).where("status = 'COMPLETED'")
        keys = ["clip_id", *[c for c in hashed if c in done.columns]]
        work = work.join(done.select(*keys), keys, "left_anti")
    good = work.where("status = 'COMPLETED'").drop("status")
    pick = lambda rows: rows.join(good.select("clip_id"), "clip_id", "left_semi")
    found, rejected = stages(pick(points), pick(readings), good, run_id, s)
    store.upsert(spark, f"{out}/events", found, ["event_id"], sequence)
    if rejections:
        store.write_rejections(rejections, **rejected)
    store.upsert(spark, f"{out}/clips", work.select("clip_id", *hashed, F.lit(run_id).alias("run_id"), "status"), ["clip_id"], sequence)
    return store.read(spark, f"{out}/events", ["event_id"])

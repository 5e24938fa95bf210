"""Matching events with ground truth, audit logs, clips and other runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import clocks, plates


def banded(left: DataFrame, right: DataFrame, a: str, b: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs with |a - b| <= width, by an equi-join on buckets of that width: each left row looks into three.

    Beyond the width there are no pairs, so this grows with the matches and not with the product of both sides.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    spread = left.withColumn("_k", F.explode(F.array(bucket(a) - 1, bucket(a), bucket(a) + 1)))
    keyed = right.withColumn("_k", bucket(b))
    return spread.join(keyed, ["_k", *(on or [])]).where(F.abs(F.col(a) - F.col(b)) <= width).drop("_k")


def nearest(left: DataFrame, right: DataFrame, key: str, a: str, b: str, width: float, position: str, on: list[str] | None = None, strict: bool = False) -> DataFrame:
    """left with the columns of its nearest right row within the width, null without one; of equally near rows the one
    with the least position.  strict leaves out pairs that are exactly that far apart."""
    more = [c for c in right.columns if c not in (on or [])]
    return _nearest_of(left, banded(left, right, a, b, width, on), more, key, a, b, width, position, strict)


def nearest_by_clip(left: DataFrame, right: DataFrame, key: str, a: str, b: str, width: float, position: str, clip: str = "clip", strict: bool = False) -> DataFrame:
    """As nearest() within a clip; a row whose clip is unknown, on either side, may meet rows of any clip.

    Rows that both know their clip meet on clip and time, the others on time alone, which the band bounds.
    """
    known = lambda rows: rows.where(F.col(clip).isNotNull())
    unknown = lambda rows: rows.where(F.col(clip).isNull()).drop(clip)
    rows = left.select(key, a, clip)
    pairs = (
        banded(known(rows), known(right), a, b, width, [clip]).drop(clip)
        .unionByName(banded(unknown(rows), right.drop(clip), a, b, width))
        .unionByName(banded(known(rows).drop(clip), unknown(right), a, b, width))
    )
    return _nearest_of(left, pairs, [c for c in right.columns if c != clip], key, a, b, width, position, strict)


def by_event_id(events: DataFrame, truth: DataFrame, key: str, width: float = 15.0) -> DataFrame:
    """events with the nearest record of truth(gt_idx, gt_s, video_source): an event's id names its clip and second, a
    record's source holds its clips' numbers in brackets.  Ids of another form meet nothing."""
    part = lambda k: F.nullif(F.regexp_extract(key, r"EVT_\((\d+)\)_\d+_(\d+)", k), F.lit(""))
    timed = events.withColumns({"_clip": part(1), "_at": part(2).cast("double")})
    numbers = F.array_distinct(F.regexp_extract_all("video_source", F.lit(r"\((\d+)\)"), F.lit(1)))
    return nearest(timed, truth.withColumn("_clip", F.explode(numbers)), key, "_at", "gt_s", width, "gt_idx", ["_clip"], strict=True).drop("_clip", "_at")


def labelled(manifest: DataFrame, truth: DataFrame, position: str, tolerance: float = 6.0) -> DataFrame:
    """The candidates of a manifest(event_id, timestamp, ...) with what the ground truth says of the nearest record of
    their clip: ground_truth_id, ground_truth_plate, plate_legible, province, vehicle_type.

    A missing time is 0.  Without a record the plate counts as illegible and the rest is null.  Candidates of one event
    and time are looked up once.
    """
    told = ["ground_truth_id", "ground_truth_plate", "plate_legible", "province", "vehicle_type"]
    keyed = manifest.drop(*told).withColumn("_case", F.struct(F.coalesce("event_id", F.lit("")).alias("e"), F.coalesce("timestamp", F.lit(0.0)).alias("t")))
    cases = keyed.select("_case").distinct().select("_case", F.col("_case.t").alias("_t"), clocks.clip_key(F.col("_case.e")).alias("clip"))
    records = truth.select(
        position, F.coalesce("approx_timestamp", F.lit(0.0)).alias("_gt"), clocks.clip_key(F.col("video_source")).alias("clip"), "ground_truth_id",
        F.col("plate_text").alias("ground_truth_plate"), F.coalesce("plate_legible", F.lit(True)).alias("plate_legible"), "province", "vehicle_type",
    )
    found = nearest_by_clip(cases, records, "_case", "_t", "_gt", tolerance, position).select("_case", *told)
    return keyed.join(found, "_case").drop("_case").withColumn("plate_legible", F.coalesce("plate_legible", F.lit(False)))


def _nearest_of(left: DataFrame, pairs: DataFrame, more: list[str], key: str, a: str, b: str, width: float, position: str, strict: bool) -> DataFrame:
    if strict:
        pairs = pairs.where(F.abs(F.col(a) - F.col(b)) < width)
    pick = F.min(F.struct(F.abs(F.col(a) - F.col(b)).alias("dt"), *[F.col(c) for c in [position, *[x for x in more if x != position]]])).alias("m")
    best = pairs.groupBy(key).agg(pick)
    return left.join(best, key, "left").select(*[left[c] for c in left.columns], "m.dt", *[F.col(f"m.{c}").alias(c) for c in more])


def candidate_pairs(audit: DataFrame, events: DataFrame, width: float = 75.0) -> DataFrame:
    """Pairs (audit_idx, evt_idx, tier, score, distance, dt) of entries and events close in time.

    Equal plates are best, then plates at most two edits apart, then events without a plate; an event with another plate
    makes no pair.
    """
    pairs = banded(audit, events, "audit_s", "event_s", width)
    d = F.levenshtein("audit_plate", "event_plate", 2)
    dt = F.abs(F.col("audit_s") - F.col("event_s"))
    tier = F.when(F.col("event_plate").isNull(), 2).when(d == 0, 0).when(d > 0, 1)
    return pairs.select(
        "audit_idx", "evt_idx", tier.alias("tier"), F.when(tier == 1, d * 1000 + dt).otherwise(dt).alias("score"),
        F.when(tier < 2, d).alias("distance"), dt.alias("dt"),
    ).where("tier is not null")


def one_to_one(pairs: DataFrame, left: str, right: str, rank: list[str], keep) -> DataFrame:
    """The pairs that a greedy pass in the order of rank would take, each side at most once.

    Each round takes all pairs that come first for both of their ends, then leaves out whatever touches them; under a
    total order that gives the greedy result.  keep(frame, name) writes a round's table and reads it back.
    """
    order = F.struct(*rank, left, right)
    rest, taken, k = keep(pairs.withColumn("_o", order), "pairs-0"), [], 0
    while not rest.isEmpty():
        k += 1
        first = rest.withColumns(
            {f"_{s}": F.min("_o").over(Window.partitionBy(c)) for s, c in (("l", left), ("r", right))}
        ).where("_o = _l and _o = _r").drop("_l", "_r")
        first = keep(first, f"taken-{k}")
        taken.append(first)
        if len(taken) == 8:  # one table again, so that the plan doesn't grow with the rounds
            taken = [keep(reduce(DataFrame.unionByName, taken), f"taken-to-{k}")]
        rest = keep(
            rest.join(first.select(left), left, "left_anti").join(first.select(right), right, "left_anti"), f"pairs-{k}"
        )
    return reduce(DataFrame.unionByName, taken, pairs.limit(0).withColumn("_o", order)).drop("_o")


def by_equal_plate(audit: DataFrame, events: DataFrame, left: str, right: str, a: str, b: str, order_a: str, order_b: str) -> DataFrame:
    """What is left over, matched by plate alone: the n-th entry of a plate with the n-th event of the same plate."""
    number = lambda key, *o: F.row_number().over(Window.partitionBy(key).orderBy(*o))
    x = audit.where(F.col(a).isNotNull()).select(left, F.col(a).alias("plate"), number(a, order_a, left).alias("n"))
    y = events.where(F.col(b).isNotNull()).select(right, F.col(b).alias("plate"), number(b, order_b, right).alias("n"))
    return x.join(y, ["plate", "n"]).select(left, right, "plate")


def outcomes(audit: DataFrame, events: DataFrame, taken: DataFrame) -> DataFrame:
    """One row: entries in all, with an equal plate, a near one, a vehicle only, and missed; and the events left over.

    taken(audit_idx, evt_idx, tier) comes from one_to_one(); what it leaves is matched by plate alone.
    """
    rest, free = audit.join(taken, "audit_idx", "left_anti"), events.join(taken, "evt_idx", "left_anti")
    late = by_equal_plate(rest, free, "audit_idx", "evt_idx", "audit_plate", "event_plate", "audit_s", "event_s")
    marked = taken.select("audit_idx", "evt_idx", "tier").unionByName(late.select("audit_idx", "evt_idx", F.lit(0).alias("tier")))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    tier = F.col("tier")
    sums = audit.select("audit_idx").join(marked, "audit_idx", "left").agg(
        F.count("*").alias("total"), n(tier == 0, "exact"), n(tier == 1, "near"), n(tier == 2, "vehicle_only"), n(tier.isNull(), "missed")
    )
    # Two frames of one row each, made one.  An event is taken once, so what isn't missed is an event.
    both = sums.unionByName(events.agg(F.count("*").alias("events")), allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return one.select(*sums.columns, F.greatest(F.lit(0), F.col("events") - (F.col("total") - F.col("missed"))).alias("extra"))


def audit_report(audit: DataFrame, events: DataFrame, windows: DataFrame, tolerance: float, longest: float) -> DataFrame:
    """(audit_idx, win_idx, evt_idx, match, reason): entries within the clips' windows, widened by the tolerance, are
    cross-validated; the others have a reason."""
    placed = in_windows(audit.select("audit_idx", "audit_plate", "audit_s"), windows, "audit_s", tolerance, longest)
    found = cross_validated(placed.where("win_idx is not null").drop("win_idx"), events, tolerance)
    reason = F.when(F.col("audit_s").isNull(), "Sin hora en Cam 2").when(F.col("win_idx").isNull(), "no cubierta por clips actuales")
    return placed.join(found, "audit_idx", "left").select("audit_idx", "win_idx", "evt_idx", "match", reason.alias("reason"))


def audit_recall(report: DataFrame) -> DataFrame:
    """One row: entries inside the windows, those found by their plate, the percentage, and entries outside."""
    n = lambda c: F.count(F.when(c, 1))
    inside, hit = n(F.col("win_idx").isNotNull()), n(F.col("match").contains("PLACA"))
    return report.agg(
        inside.alias("inside"), hit.alias("detected"), F.coalesce(F.try_divide(hit, inside) * 100, F.lit(0.0)).alias("recall"), n(F.col("win_idx").isNull()).alias("outside")
    )


def cross_validated(audit: DataFrame, events: DataFrame, width: float) -> DataFrame:
    """(audit_idx, evt_idx, match): plate and time if any event has both, else the last event with the plate, else the
    first near in time.  Events count in the order evt_idx; one event may serve several entries.

    Time-near pairs come from buckets; plate pairs from keys that matching plates must share: the plate itself, the last
    four characters, each deletion of one character, and each run of six characters.
    """
    near = banded(audit.select("audit_idx", "audit_plate", "audit_s"), events.select("evt_idx", "event_plate", "event_s"), "audit_s", "event_s", width)
    same = plates.same_plate(F.col("audit_plate"), F.col("event_plate"))
    near = near.groupBy("audit_idx").agg(
        F.min(F.when(same, F.col("evt_idx"))).alias("both"), F.min("evt_idx").alias("time")
    )
    # Plates repeat: each meets the others once, with the last event that bears it.
    keyed = lambda side, plate: side.where(F.col(plate).isNotNull()).withColumn("key", F.explode(_plate_keys(F.upper(F.trim(F.col(plate))))))
    last = events.groupBy("event_plate").agg(F.max("evt_idx").alias("evt_idx"))
    pairs = keyed(audit.select("audit_plate").distinct(), "audit_plate").join(keyed(last, "event_plate"), "key")
    plate = pairs.where(same).groupBy("audit_plate").agg(F.max("evt_idx").alias("plate"))
    alike = audit.select("audit_idx", "audit_plate").join(plate, "audit_plate").select("audit_idx", "plate")
    found = audit.select("audit_idx").join(near, "audit_idx", "left").join(alike, "audit_idx", "left")
    return found.select(
        "audit_idx",
        F.coalesce("both", "plate", "time").alias("evt_idx"),
        F.when(F.col("both").isNotNull(), "PLACA_Y_HORA (EXACTO)")
        .when(F.col("plate").isNotNull(), "SOLO_PLACA")
        .when(F.col("time").isNotNull(), "SOLO_HORA")
        .alias("match"),
    )


def _plate_keys(p: Column) -> Column:
    """Texts of which two plates that same_plate() accepts share at least one."""
    n = F.length(p)
    spots = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    without = F.transform(spots, lambda i: F.concat(F.substring(p, F.lit(1), i - 1), F.substring(p, i + 1, n)))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - 5, F.lit(1))), lambda i: F.substring(p, i, F.lit(6)))
    long = F.concat(F.array(p, F.concat(F.lit("~"), F.substring(p, -4, 4))), without, runs)
    return F.array_distinct(F.when(n >= 6, long).otherwise(F.array(p)))


def in_windows(points: DataFrame, windows: DataFrame, at: str, tolerance: float, longest: float) -> DataFrame:
    """points with the first window (least win_idx) whose start and end, widened by the tolerance, hold them.

    longest bounds a window's length, so windows can be bucketed by their start; longer ones are split by the caller.
    """
    size = longest + 2 * tolerance
    low, high = F.col("win_start") - tolerance, F.col("win_end") + tolerance
    placed = windows.select(
        "win_idx", low.alias("_low"), high.alias("_high"), F.explode(F.sequence(F.floor(low / size), F.floor(high / size))).alias("_k")
    )
    # Times decide, so each time is looked up once; a time's row may be null in any column.
    times = points.select(F.col(at).alias("_at")).where(F.col(at).isNotNull()).distinct()
    pairs = times.withColumn("_k", F.floor(F.col("_at") / size)).join(placed, "_k").where(F.col("_at").between(F.col("_low"), F.col("_high")))
    first = pairs.groupBy("_at").agg(F.min("win_idx").alias("win_idx"))
    return points.join(first, F.col(at) == F.col("_at"), "left").drop("_at")


def evaluated(detections: DataFrame, truth: DataFrame, width: float = 25.0) -> DataFrame:
    """(video, det_idx, gt_idx, dt): detections in the order of time each take the nearest free record of their video,
    closer than the width; the earlier record wins ties.

    The order of detections decides, not the distance, so what depends on each other is folded as one array: a video's
    detections and records up to the next pause of the width, over which no two can meet.
    """
    both = detections.select("video", F.col("det_s").alias("_s"), "det_idx", F.lit(None).cast("bigint").alias("gt_idx")).unionByName(
        truth.select("video", F.col("gt_s").alias("_s"), F.lit(None).cast("bigint").alias("det_idx"), "gt_idx")
    )
    w = Window.partitionBy("video").orderBy("_s")
    pause = F.coalesce(F.col("_s") - F.lag("_s").over(w) >= width, F.lit(True))
    placed = both.withColumn("_pause", pause.cast("int")).withColumn("_part", F.sum("_pause").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    of = lambda what, key, *c: F.sort_array(F.collect_list(F.when(F.col(what).isNotNull(), F.struct(*c)))).alias(key)
    s = F.col("_s")
    parts = placed.groupBy("video", "_part").agg(
        of("det_idx", "d", s.alias("det_s"), F.col("det_idx")), of("gt_idx", "t", F.col("gt_idx"), s.alias("gt_s"))
    ).where((F.size("d") > 0) & (F.size("t") > 0))
    best = lambda acc, x: F.array_min(
        F.transform(
            F.filter(acc["free"], lambda g: F.abs(g["gt_s"] - x["det_s"]) < width),
            lambda g: F.struct(F.abs(g["gt_s"] - x["det_s"]).alias("dt"), g["gt_idx"].alias("gt_idx")),
        )
    )
    start = F.struct(
        F.col("t").alias("free"), F.expr("cast(array() as array<struct<det_idx:bigint,gt_idx:bigint,dt:double>>)").alias("found")
    )

    def take(acc: Column, x: Column) -> Column:
        b = best(acc, x)
        hit = F.struct(x["det_idx"].cast("bigint").alias("det_idx"), b["gt_idx"].cast("bigint").alias("gt_idx"), b["dt"].alias("dt"))
        return F.struct(
            F.when(b.isNull(), acc["free"]).otherwise(F.filter(acc["free"], lambda g: g["gt_idx"] != b["gt_idx"])).alias("free"),
            F.when(b.isNull(), acc["found"]).otherwise(F.array_append(acc["found"], hit)).alias("found"),
        )

    return parts.select("video", F.explode(F.aggregate("d", start, take)["found"]).alias("m")).select("video", "m.*")


def metrics(truth: DataFrame, detections: DataFrame, matches: DataFrame) -> DataFrame:
    """One row of recall, direction and plate figures over all records of truth(video, gt_idx, direction, plate,
    legible) and detections(video, det_idx, direction, plate)."""
    strip = lambda c: F.upper(F.trim(F.replace(F.col(c), F.lit("-"), F.lit(""))))
    det = detections.select("video", "det_idx", F.col("direction").alias("det_direction"), F.nullif(strip("plate"), F.lit("")).alias("det_plate"))
    rows = truth.join(matches.select("video", "gt_idx", "det_idx"), ["video", "gt_idx"], "left").join(det, ["video", "det_idx"], "left")
    gt = strip("plate")
    legible = F.coalesce(F.col("legible") & (gt != ""), F.lit(False))
    distance = F.levenshtein(gt, F.col("det_plate"))
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    sums = rows.agg(
        F.count("*").alias("gt"),
        count(F.col("det_idx").isNotNull()).alias("matched"),
        count(F.col("det_direction") == F.col("direction")).alias("right_way"),
        count(legible).alias("legible"),
        count(legible & (distance == 0)).alias("exact"),
        count(legible & F.col("det_plate").isNull()).alias("unread"),
        count(legible & (F.substring(gt, 1, 1) == F.substring("det_plate", 1, 1))).alias("first"),
        F.coalesce(F.sum(F.when(legible, F.length(gt))), F.lit(0)).cast("bigint").alias("chars"),
        F.coalesce(F.sum(F.when(legible & F.col("det_plate").isNotNull(), F.greatest(F.lit(0), F.length(gt) - distance))), F.lit(0)).cast("bigint").alias("right_chars"),
    )
    videos = truth.select("video").distinct()
    seen = detections.join(videos, "video", "left_semi").agg(F.count("*").alias("detected"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    # Two frames of one row each, made one.
    both = sums.unionByName(seen, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        share("matched", "gt").alias("event_recall"), share("right_way", "matched").alias("direction_accuracy"),
        share("exact", "legible").alias("plate_exact_match"), share("right_chars", "chars").alias("character_accuracy"),
        F.col("unread").alias("unread_legible_plates"), share("first", "legible").alias("pos0_accuracy"),
        (F.col("detected") - F.col("matched")).alias("false_positives"), F.col("matched").alias("matched_gt_count"),
        F.col("gt").alias("total_gt_count"), F.col("chars").alias("total_real_gt_chars"), F.col("right_chars").alias("total_correct_chars"),
    )


def run_diff(a: DataFrame, b: DataFrame, order: list[str], fields: list[str], by: str = "video", tolerance: float = 1e-6) -> DataFrame:
    """(by, position, fields): what differs between the n-th events of each video in two runs; numbers within the
    tolerance are equal, and so are two nulls."""
    numbered = lambda r: r.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    x = numbered(a).select(by, "position", *[F.col(c).alias(f"a_{c}") for c in fields])
    y = numbered(b).select(by, "position", *[F.col(c).alias(f"b_{c}") for c in fields])
    kinds = dict(a.dtypes)

    def differs(c: str) -> Column:
        p, q = F.col(f"a_{c}"), F.col(f"b_{c}")
        if kinds[c] in ("double", "float"):
            return ~F.coalesce(F.abs(p - q) <= tolerance, p.isNull() & q.isNull())
        return ~p.eqNullSafe(q)

    changed = F.concat_ws(",", *[F.when(differs(c), c) for c in fields])
    return x.join(y, [by, "position"]).select(by, "position", changed.alias("fields")).where("fields <> ''")


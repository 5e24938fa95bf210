"""Consensus of several readings of one plate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import plates


def consensus(reads: DataFrame, by: str | list[str], order: str, s: Settings = DEFAULT, beta: Column | None = None) -> DataFrame:
    """One row for each group of reads(by, order, text, ocr_conf, plate_score): the winning text, its mean confidence,
    its score, and whether a person should look.

    Implausible readings count only where a group has no plausible one.  A text scores what its readings weigh, and half
    of what near texts weigh, less for each edit.  The result is always one of the readings.  beta, of a group, replaces
    the prior of the settings.  Readings of a group are few (the best crops of one event), so one shuffle gathers them
    and the rest happens inside the row.
    """
    by = [by] if isinstance(by, str) else by
    text = plates.clean(F.col("text"))
    formed = text.rlike("^[A-Z]{3}[0-9]{3,4}$") | text.rlike("^[A-Z]{2}[0-9]{3}[A-Z]$")
    bonus = F.when(formed, 0.15 + F.when(plates.province(text).isNotNull(), 0.05).otherwise(0.0)).otherwise(0.0)
    cleaned = reads.where(text.isNotNull()).select(
        *by, order, text.alias("text"), "ocr_conf", (F.coalesce("plate_score", F.lit(1.0)) + bonus).alias("plate_score"),
        (F.lit(s.prior_beta) if beta is None else beta).alias("beta"),
    )
    entry = F.struct(
        order, "text", F.col("ocr_conf").alias("conf"), plates.plausible(F.col("text")).alias("ok"),
        (F.col("ocr_conf") * F.greatest(F.lit(0.1), F.col("plate_score"))).alias("w"),
    )
    groups = cleaned.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("all"), F.first("beta").alias("beta"))
    plausible = F.filter("all", lambda r: r["ok"])
    used = groups.withColumn("doubt", F.size(plausible) == 0).withColumn("used", F.when(F.col("doubt"), F.col("all")).otherwise(plausible))
    total = lambda rows, f: F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + f(r))

    def judged(t: Column) -> Column:
        own = F.filter("used", lambda r: r["text"] == t)
        close = lambda r: 1 - F.levenshtein(t, r["text"]).cast("double") / F.greatest(F.length(t), F.length(r["text"]))
        near = F.filter("used", lambda r: (r["text"] != t) & (F.levenshtein(t, r["text"]) <= 2))
        n = F.size(own)
        prior = F.when(t.startswith("P"), F.col("beta") * n).otherwise(0.0)
        score = total(own, lambda r: r["w"]) + prior + total(near, lambda r: r["w"] * close(r) * close(r) * 0.5)
        return F.struct(score.alias("score"), t.alias("text"), n.cast("bigint").alias("reads"), (total(own, lambda r: r["conf"]) / n).alias("conf"))

    texts = F.array_distinct(F.transform("used", lambda r: r["text"]))
    ranked = used.withColumn("ranked", F.sort_array(F.transform(texts, judged), asc=False))
    best, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    limit = F.when(F.substring(best["text"], 1, 1) != F.substring(second["text"], 1, 1), s.review_threshold).otherwise(s.review_threshold / 2)
    unsure = F.lit(s.review_threshold > 0) & F.coalesce(best["score"] - second["score"] < limit, F.lit(False))
    return ranked.where(F.size("ranked") > 0).select(
        *by, best["text"].alias("text"), best["conf"].alias("consensus_conf"), best["score"].alias("score"), best["reads"].alias("reads"),
        (F.col("doubt") | unsure).alias("needs_review"),
    )


def log_odds(reads: DataFrame, by: str | list[str], order: str, beta: float | Column = 0.0) -> DataFrame:
    """(*by, text, score, consensus_conf): the text whose readings' weighted log-odds sum highest, to nine places, so
    that the order of adding decides nothing; the earlier text wins ties, then the greater one."""
    text = plates.clean(F.col("text"))
    c = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("ocr_conf")))
    by = [by] if isinstance(by, str) else by
    bonus = F.when(text.startswith("P"), 2 * beta).otherwise(0.0)
    weight = F.greatest(F.lit(0.1), F.col("plate_score")) * F.ln(c / (1 - c)) + bonus
    sums = (
        reads.where(F.length(text) >= 5).select(*by, order, text.alias("text"), weight.alias("w"))
        .groupBy(*by, "text").agg(F.round(F.sum("w"), 9).alias("score"), F.min(order).alias("at"))
    )
    best = sums.groupBy(*by).agg(F.max(F.struct("score", (-F.col("at")).alias("early"), "text")).alias("b"))
    return best.select(*by, F.col("b.text").alias("text"), F.col("b.score").alias("score"), F.lit(0.85).alias("consensus_conf"))


def two_tier(pairs: DataFrame) -> DataFrame:
    """Readings of a square plate's two rows as one: pairs(width, height, top, bottom, top_confs, bottom_confs,
    plate_score) with text, ocr_conf and plate_score; text is null where the rows don't make a plate."""
    square = (F.col("width") >= 24) & (F.col("height") >= 24) & (F.col("width") / F.col("height") <= 1.35)
    ok = square & (F.length("top") >= 2) & (F.length("bottom") >= 3)
    confs = F.concat("top_confs", "bottom_confs")
    mean = F.aggregate(confs, F.lit(0.0), lambda a, x: a + x) / F.size(confs)
    return pairs.select(
        *[c for c in pairs.columns if c not in ("plate_score",)],
        F.when(ok, F.concat("top", "bottom")).alias("text"),
        F.when(ok & (F.size(confs) > 0), mean).alias("ocr_conf"),
        F.when(ok, F.col("plate_score") * 1.1).otherwise(F.col("plate_score")).alias("plate_score"),
    )

"""Clip names, clip times and event names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The camera's start of recording, the time of clip 60, and the length of a clip.
FIRST_DAY, UNNUMBERED, DAY_START, CLIP_60, CLIP_SECONDS = "2026-09-09", "16:00:00", "10:56:51", "16:17:16", 330.0
#: What the audit takes for clip 60's start and for the pace of clips.
AUDIT_CLIP_60, AUDIT_PACE = "16:17:20", 325


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def clip_number(name: Column) -> Column:
    """The number in brackets at a file name's end, or null."""
    return F.nullif(F.regexp_extract(name, r"\((\d+)\)\.[A-Za-z0-9]+$", 1), F.lit("")).cast("int")


def natural_key(path: Column) -> list[Column]:
    """Sort columns: numbered clips by number, then the others by their text with numbers padded to one width."""
    name = basename(path)
    number = clip_number(name)
    padded = F.regexp_replace(F.regexp_replace(F.lower(name), r"(\d+)", "000000000000$1"), r"0*(\d{12})(?!\d)", "$1")
    return [F.when(number.isNotNull(), 0).otherwise(1), F.coalesce(number, F.lit(0)), padded, name]


def clip_start(path: Column) -> Column:
    """When a clip begins.  Numbered clips follow clip 60 at a fixed pace on the day in the name; others begin at the
    time in the name, at the day's usual start if there is only a day, or at a fixed time."""
    name = basename(path)
    day = F.nullif(F.regexp_extract(name, r"_(\d{8})", 1), F.lit(""))
    moment = F.nullif(F.regexp_extract(name, r"_(\d{14})", 1), F.lit(""))
    dated = lambda d, t: F.to_timestamp_ntz(F.concat(d, F.lit(f" {t}")), F.lit("yyyyMMdd HH:mm:ss"))
    first = F.lit(FIRST_DAY.replace("-", ""))
    number = F.nullif(F.regexp_extract(name, r"\((\d+)\)\.mp4$", 1), F.lit("")).cast("int")
    offset = ((number - 60) * F.lit(CLIP_SECONDS)).cast("long")
    return (
        F.when(number.isNotNull(), F.timestamp_add("SECOND", offset, dated(F.coalesce(day, first), CLIP_60)))
        .when(moment.isNotNull(), F.to_timestamp_ntz(moment, F.lit("yyyyMMddHHmmss")))
        .when(day.isNotNull(), dated(day, DAY_START))
        .otherwise(dated(first, UNNUMBERED))
    )


def clip_key(text: Column) -> Column:
    """The digits of the first number in brackets, or null."""
    return F.nullif(F.regexp_extract(text, r"\((\d+)\)", 1), F.lit(""))


def audit_clip_start(path: Column) -> Column:
    """When the audit takes a clip to begin: numbered ones at an even pace around clip 60, others at a fixed time."""
    name = basename(path)
    day = F.coalesce(F.nullif(F.regexp_extract(name, r"_(\d{8})", 1), F.lit("")), F.lit(FIRST_DAY.replace("-", "")))
    number = F.nullif(F.regexp_extract(name, r"\((\d+)\)\.mp4$", 1), F.lit("")).cast("long")
    at = lambda t: F.to_timestamp_ntz(F.concat(day, F.lit(f" {t}")), F.lit("yyyyMMdd HH:mm:ss"))
    return F.when(number.isNotNull(), F.timestamp_add("SECOND", (number - 60) * AUDIT_PACE, at(AUDIT_CLIP_60))).otherwise(at(UNNUMBERED))


def event_id(clip: Column, track: Column, seconds: Column) -> Column:
    """EVT_, the clip's last four characters, the track in four digits or more, whole seconds."""
    stem = F.regexp_replace(basename(clip), r"\.[^.]*$", "")
    return F.concat(F.lit("EVT_"), F.substring(stem, -4, 4), F.format_string("_%04d_%d", track.cast("long"), seconds.cast("long")))


def event_time(start: Column, seconds: Column) -> Column:
    """The moment of an event and its usual rendering."""
    return F.timestamp_add("MICROSECOND", (seconds * 1e6).cast("long"), start)


def dedup_key(plate: Column, direction: Column) -> Column:
    return F.concat_ws("_", F.coalesce(plate, F.lit("None")), F.coalesce(direction, F.lit("None")))


def time_of_day(cell: Column) -> Column:
    """Seconds of the day of HH:MM:SS or HH:MM, null for anything else."""
    text = F.trim(cell)
    part = lambda k: F.nullif(F.regexp_extract(text, r"^(\d{1,2}):(\d{2})(?::(\d{2}))?$", k), F.lit("")).cast("int")
    h, m, s = part(1), part(2), F.coalesce(part(3), F.lit(0))
    return F.when((h < 24) & (m < 60) & (s < 60), h * 3600 + m * 60 + s)

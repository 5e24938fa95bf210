"""python -m lanewise SOURCE --points P --readings R --out DIR: events of the clips below SOURCE from Parquet tables."""

from __future__ import annotations

import argparse
import time
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import config
from .functions import clocks
from .plans import batch
from .sources import files, workbook


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lanewise", description=__doc__)
    p.add_argument("source", help="folder of clips, searched at any depth, or one file")
    p.add_argument("--points", required=True, help="Parquet of track points")
    p.add_argument("--readings", required=True, help="Parquet of plate readings")
    p.add_argument("--out", required=True, help="folder of the event store")
    p.add_argument("--clips", type=int, nargs="*", help="only clips of these numbers")
    p.add_argument("--limit", type=int, help="only the first clips in natural order")
    p.add_argument("--config", help="YAML of settings")
    p.add_argument("--cooldown", type=float, help="seconds within which plates count as duplicates")
    p.add_argument("--again", action="store_true", help="also clips that are already done")
    p.add_argument("--report", help="workbook of this run's events to write")
    p.add_argument("--rejections", help="folder for JSON lines of what was rejected")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lanewise").getOrCreate()
    s = config.load(a.config) if a.config else config.DEFAULT
    s = replace(s, cooldown_seconds=a.cooldown) if a.cooldown is not None else s
    found = files.work_list(files.file_hashes(spark, a.source), a.clips, a.limit)
    # The list of clips is a catalogue, small beside what they hold.
    order = F.row_number().over(Window.orderBy(*clocks.natural_key(F.col("path"))))
    clips = found.select(clocks.basename(F.col("path")).alias("clip_id"), "path", "file_hash", order.alias("clip_order"))
    now = int(time.time())
    run_id = f"run-{now}-{s.key}"
    points, readings = spark.read.parquet(a.points), spark.read.parquet(a.readings)
    rows = batch.run(spark, points, readings, clips, a.out, run_id, now, s, not a.again, a.rejections)
    own = rows.where(F.col("processing_run_id") == run_id)
    ways = own.where("duplicate_of is null").groupBy("direction").count().orderBy("direction").collect()
    print(f"{rows.count()} events in {a.out}, {own.count()} of this run: " + ", ".join(f"{r[0]} {r[1]}" for r in ways))
    if a.report:
        print("sheets:", ", ".join(workbook.export(own, a.report)))


if __name__ == "__main__":
    main()

"""The event store as Parquet tables: latest-wins upserts, updates, evolution, checks, side outputs, resumption."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import DEFAULTS


class Shared:
    """Tables written to the folder that the driver and the executors share, spark.checkpoint.dir."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not found:
            if not (spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(f"file://{tempfile.gettempdir()}/lanewise-store")
            found = spark.sparkContext.getCheckpointDir()
        self.root = f"{found.rstrip('/')}/{label}"

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        """Written once and read back: later rounds neither recompute it nor carry its plan, also if executors go."""
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")


def latest(rows: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The row written last for each key; one aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*key, sequence)]
    best = rows.groupBy(*key).agg(F.max(F.struct(sequence, *rest)).alias("r"))
    return best.select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in rows.columns])


def updated(rows: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """rows with the columns of changes where their keys meet; other changes add nothing."""
    new = [c for c in changes.columns if c not in key]
    change = changes.select(*key, *[F.col(c).alias(f"_{c}") for c in new], F.lit(True).alias("_met"))
    both = rows.join(change, key, "left")
    return both.select(*[F.when(F.col("_met"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in rows.columns])


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: list[str], sequence: int) -> None:
    """Appends rows under a sequence number; read() then sees the last of each key."""
    rows.withColumn("write_seq", F.lit(sequence).cast("long")).write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, key: list[str], schema: T.StructType | None = None) -> DataFrame:
    """The table's current rows, with the columns of a schema and their defaults if one is given."""
    rows = latest(spark.read.option("mergeSchema", "true").parquet(path), key, "write_seq").drop("write_seq")
    return evolved(rows, schema) if schema else rows


def evolved(rows: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """rows with every column of the schema; what is missing or null takes its default."""
    wanted = schema or rows.schema
    have = set(rows.columns)
    out = []
    for f in wanted.fields:
        c = F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(c, F.lit(DEFAULTS[f.name]).cast(f.dataType)) if f.name in DEFAULTS else c).alias(f.name))
    return rows.select(*out)


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")


def missing_parents(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key), key, "left_anti")


def unprocessed(work: DataFrame, done: DataFrame) -> DataFrame:
    """Clips without a completed row of the same id and content."""
    return work.join(done.where("status = 'COMPLETED'").select("clip_id", "file_hash"), ["clip_id", "file_hash"], "left_anti")


REASONS = ("parked_curb_filter", "outside_gravel_polygon", "track_never_crossed", "plate_read_rejected", "dedup_discarded")


def rejections(**producers: DataFrame) -> DataFrame:
    """One frame of all rejected rows, each with its producer's reason; columns that a producer lacks are null."""
    unknown = set(producers) - set(REASONS)
    if unknown or not producers:
        raise ValueError(f"reasons are {', '.join(REASONS)}")
    found = None
    for reason, rows in producers.items():
        marked = rows.withColumn("reason", F.lit(reason))
        found = marked if found is None else found.unionByName(marked, allowMissingColumns=True)
    return found


def write_rejections(path: str, **producers: DataFrame) -> None:
    """Appends rejected rows as JSON lines."""
    rejections(**producers).write.mode("append").json(path)


def write_records(rows: DataFrame, path: str) -> None:
    """Manifests and data sets as JSON lines, one file for each partition; nulls are written, letters stay as they are."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)



def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)

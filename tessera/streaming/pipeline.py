"""Incremental counterparts: a file stream of documents, exact-duplicate removal, event-time windows, upserts by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.state import latest
from tessera.sources.extract import extracted


def file_stream(spark: SparkSession, path: str, *, archive: str | None = None, per_batch: int = 1_000) -> DataFrame:
    """Files of a folder as they arrive, extracted; processed ones are moved to ``archive`` if given. Progress is kept by the checkpoint."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return extracted(reader.load(path))


def first_arrivals(stream: DataFrame, text: str = "text", *, at: str | None = None, horizon: str | None = None) -> DataFrame:
    """The rows whose normalized text has not come before; with ``at`` and ``horizon`` state older than that is dropped."""
    hashed = stream.withColumn("text_hash", tx.sha256(tx.normalize(F.coalesce(F.col(text), F.lit("")))))
    if at and horizon:
        return hashed.withWatermark(at, horizon).dropDuplicatesWithinWatermark(["text_hash"])
    return hashed.dropDuplicates(["text_hash"])


def tone_by_week(events: DataFrame, *, at: str = "ts", key: str = "event_type", value: str = "value", lateness: str = "7 days") -> DataFrame:
    """(key, week_start, net, n): the mean of each key in tumbling weeks of event time, late rows accepted up to ``lateness``.

    The same expression runs on a batch. Weeks begin on Monday, UTC.
    """
    timed = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", lateness)
    week = F.window("_at", "7 days", startTime="4 days")
    amount = F.col(value).cast("decimal(18,4)")
    return timed.groupBy(week.alias("w"), F.col(key).alias("key")).agg(F.round(F.sum(amount).cast("double") / F.count("*"), 3).alias("net"), F.count("*").alias("n")).select("key", F.to_date("w.start").alias("week_start"), "net", "n")


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete states of a folder, oldest first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) or []
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def upsert_batches(spark: SparkSession, path: str, keys: list[str], order: list[Column]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the last row of each key, by ``order``, then by batch.

    Each batch is merged into the state before it and written as a version of its own, so a
    batch that is run again gives the same; of the older versions the one before is kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        older = [v for v in _versions(spark, path) if v < number]
        rows = batch.withColumn("_batch", F.lit(number).cast("long"))
        if older:
            rows = batch.sparkSession.read.parquet(f"{path}/version={older[-1]}").unionByName(rows)
        latest(rows, keys, [*order, F.col("_batch")]).write.mode("overwrite").parquet(f"{path}/version={number}")
        for v in older[:-1]:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version={v}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    return write


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The last row of each key, as ``upsert_batches`` left it; None before the first batch."""
    versions = _versions(spark, path)
    return spark.read.parquet(f"{path}/version={versions[-1]}").drop("_batch") if versions else None

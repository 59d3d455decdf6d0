"""Session helpers: reading the tables and cutting lineage in the shared folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers, wherever they run; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), f"{here.name}.zip")  # on the driver only; Spark hands it on
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    spark.sparkContext.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; unchanged where its scan has them, as a large table's has.

    For expressions that cost far more than a shuffle of their input, on a table of one small file.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    It is ``spark.checkpoint.dir`` of the session. Only where that is unset and the master is
    local, as in tests, a temporary folder is chosen and set on the context; a cluster without
    the setting is refused, since a folder of one machine would not be seen by the others.
    """
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(given)
        return given
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return kept.get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by an eager, reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffles, broadcasts and checkpoints of frames that are no longer used; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_file(spark: SparkSession, name: str, content: bytes) -> str | None:
    """Writes ``content`` to the shared folder; its plain path, or None where that folder is no file system path."""
    root = shared_dir(spark)
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    elif "://" in root:
        return None
    os.makedirs(root, exist_ok=True)
    path = os.path.join(root, f"{name}-{uuid.uuid4().hex}")
    with open(path, "wb") as f:
        f.write(content)
    return path

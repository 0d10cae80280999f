"""Session set-up and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cloakwork")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they may run elsewhere."""
    context = spark.sparkContext
    if getattr(context, "_cloakwork_shipped", False):
        return
    package = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="cloakwork-"), "cloakwork.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent).as_posix())
    context.addPyFile(to)
    context._cloakwork_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where the setting is missing."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="cloakwork-")
        spark.sparkContext.setCheckpointDir(given)
    return given


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """df written to the shared folder and read again.

    The written table cuts the lineage, is computed once however often it is read, and survives the
    loss of any executor. `release` deletes what was written; at exit this happens by itself.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"cloakwork-{uuid.uuid4().hex}")
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Delete every table that `stored` wrote; frames read from them can't be used afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended first
            continue


def tasks(spark: SparkSession) -> int:
    """How many tasks keep all cores busy with work that takes long for its bytes."""
    return max(spark.sparkContext.defaultParallelism * 3, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def one_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key; rows whose key is null are left out (they can't be told apart)."""
    for key in keys:
        df = df.filter(df[key].isNotNull())
    return df.dropDuplicates(list(keys))

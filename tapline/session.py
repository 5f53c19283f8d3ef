"""Session helpers: a local session for tests and the shared work folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "tapline", partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    return ship_package(spark)


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, which else import it from their own path only."""
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tapline-package-")
    archive = shutil.make_archive(f"{folder}/tapline", "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(archive)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder stands in only for a local master with the setting unset.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return tempfile.mkdtemp(prefix="tapline-")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def parquet_stage(spark: SparkSession) -> Callable[[str, DataFrame], DataFrame]:
    """A stage that writes a table below the shared folder and reads it back.

    It cuts the plan: a lost executor re-reads parquet, and the detectors do
    not recompute the stream reduction they all start from. A stage grows with
    the input and is many times larger in memory than its files, by whose size
    Spark would broadcast it through the driver, so its joins are sort-merge.
    """
    root = work_path(spark, "analysis")

    def keep(name: str, df: DataFrame) -> DataFrame:
        target = f"{root}/{name}"
        df.write.mode("overwrite").parquet(target)
        return spark.read.schema(df.schema).parquet(target).hint("merge")

    return keep

"""A local session for checks, tests and the bench."""

from __future__ import annotations

import getpass

from pyspark.sql import SparkSession

from givetide.sources.warehouse import FOLDER

LOCAL_FOLDER = f"file:///tmp/checkpoints/{getpass.getuser()}"


def with_shared_folder(spark: SparkSession) -> SparkSession:
    """Name a folder for a local session that was started without one; a cluster session must have its own."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.master.split("[")[0] == "local":
        spark.conf.set(FOLDER, LOCAL_FOLDER)
    return spark


def local_session(cpus: str | int = 8, partitions: int | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("givetide")
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", LOCAL_FOLDER)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

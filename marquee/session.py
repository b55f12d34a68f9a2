"""Session settings and the one helper that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "marquee", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings the library is tuned for.

    ``master`` and ``partitions`` are for tests and the bench; on a cluster leave
    them out so that the submitted configuration decides.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "8g")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session (tests, a
    laptop) may leave that unset; it gets a temporary folder, once per session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="marquee-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used between rounds of an iterative operator. A written table survives the loss
    of executors, and its file sizes give the next round real statistics, so Spark
    can choose to broadcast it only when it is in fact small. Hex digests and ids fill most
    of these tables; zstd halves them, where the default codec leaves them as they are.
    """
    spark = df.sparkSession
    path = os.path.join(scratch_root(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

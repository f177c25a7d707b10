"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "signalloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; any of them can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``. Only where that is
    unset and Spark runs in one process (tests, a laptop) a local one is made."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="run-")


def new_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written copy."""
    spark = df.sparkSession
    context = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from it. Unlike after :func:`cut_lineage` its size is
    known to the plans that read it, and they read only the columns they need. What was shuffled to write it leaves the
    disk when the driver finds it unused, so it is asked to look: twice, as some is held until the first look is over."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    for pause in (0.2, 0):
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(pause)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""A session with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build(app: str = "foliary", master: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    builder = builder.master(master) if master else builder
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`. Where it is unset, one of our
    own on a local master, and elsewhere an error, as executors don't see each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir has to name a folder that driver and executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="foliary-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    root = f"{shared_dir(spark)}/foliary/{label}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once: no part of it is computed twice, also
    if an executor is lost. It goes when the application ends."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

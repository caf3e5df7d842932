"""Session factory and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators expect; ``master`` only for local use."""
    builder = SparkSession.builder.appName("strandframe")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (local mode, tests) is a temporary folder made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="strandframe-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there.

    A lost executor then costs a reread, never a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandframe/{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver collect its garbage: only then Spark deletes the shuffles and broadcasts of plans that are over, and
    only then a heap that has grown by many small jobs shrinks again."""
    spark._jvm.System.gc()


def drop_cut(df: DataFrame) -> None:
    """Delete a table of ``cut`` that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

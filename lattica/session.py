"""Session set-up, table access and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lattica") -> SparkSession:
    """A session for one machine; on a cluster the caller passes its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("LATTICA_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only on a single machine (tests, benchmark) may the setting be absent: a
    temporary folder is then made and set. On a cluster that is an error, as
    a folder of one machine can't be read by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        known = context._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lattica-checkpoint-")
        atexit.register(shutil.rmtree, folder[7:], True)
        context.setCheckpointDir(folder)
    return folder


#: Tables written by this process and not yet removed.
_written: set[str] = set()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for a table that a job writes and reads again; removed by release(), at the latest when the driver ends."""
    if not _written:
        atexit.register(release)
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


def _remove(path: str) -> None:
    jvm = SparkContext._gateway.jvm if SparkContext._gateway else None
    if jvm is not None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        conf = SparkContext._active_spark_context._jsc.hadoopConfiguration() if SparkContext._active_spark_context else jvm.org.apache.hadoop.conf.Configuration()
        p.getFileSystem(conf).delete(p, True)
    _written.discard(path)


def release(*frames: DataFrame) -> None:
    """Removes the files of staged frames that nothing reads any more; without arguments all scratch tables of this process, whose results must have been read."""
    paths = [p for f in frames if (p := f.__dict__.get("_scratch"))] if frames else list(_written)
    for path in paths:
        try:
            _remove(path)
        except Exception:  # the store may be gone when the driver ends
            _written.discard(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """The frame written to the shared folder and read again.

    For iterations, whose plan starts anew without the constraints that a
    checkpointed frame inherits, and for costly columns that several jobs read.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out

"""Session helpers: builder for local use, shared working folder, stashed tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "recallspark", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("RECALLSPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) a local folder is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="recallspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_FOLDERS: dict[str, str] = {}


def run_folder(spark: SparkSession) -> str:
    """This session's own folder for intermediate tables; deleted by ``release``, at the latest when Python ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/recallspark/run-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(release, spark)
    return _FOLDERS[app]


def release(spark: SparkSession) -> None:
    """Delete this session's intermediate tables. Frames that read them are of no use afterwards."""
    try:
        folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
        if folder:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session is gone, and with it the way to its files
        return


def stash(df: DataFrame, label: str = "t") -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back.

    The files outlive any executor, are columnar (later reads prune columns) and
    give exact row counts without a pass over the data.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

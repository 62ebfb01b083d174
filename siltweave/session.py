"""Session settings and the shared folder that jobs write their working tables to."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}


def local_session(app: str = "siltweave", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below the session's ``spark.checkpoint.dir``.

    Every executor must reach it. Where the setting is absent, a temporary folder
    serves a local session only; on a cluster that is an error, as other machines
    could not read what one of them wrote. It is removed by ``clean``, or when the driver's Python
    ends while its session is still running.
    """
    app = spark.sparkContext.applicationId
    if app in _FOLDERS:
        return _FOLDERS[app]
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="siltweave-")
        atexit.register(shutil.rmtree, root, True)
        root = f"file://{root}"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"{root}/checkpoints")
    folder = f"{root.rstrip('/')}/siltweave-{os.getpid()}-{uuid.uuid4().hex[:8]}"
    _FOLDERS[app] = folder
    atexit.register(clean, spark)
    return folder


def clean(spark: SparkSession) -> None:
    """Remove the working tables of this application, once no result that reads them is needed any more."""
    if spark.sparkContext._jsc is None:
        return  # stopped
    folder = _FOLDERS.pop(spark.sparkContext.applicationId, None)
    if folder:
        delete_path(spark, folder)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a working table through Hadoop's file system, whatever the scheme."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, folder: str | None = None, codec: str | None = None) -> DataFrame:
    """Write a working table to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, which may lack it on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="siltweave-package-")  # on the driver, which serves it
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "siltweave_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for root, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(root, f), os.path.join("siltweave", os.path.relpath(os.path.join(root, f), here)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)

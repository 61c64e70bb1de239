"""Session with the settings the engine relies on, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "kinloom", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return SparkSession.builder.appName(name).config(map=settings | conf).getOrCreate()


def _path(spark: SparkSession, name: str):
    """A folder of any Hadoop file system: (file system, path)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def shared_folder(spark: SparkSession) -> str:
    """This application's part of the folder named in spark.checkpoint.dir, deleted when the application ends.

    Only a local master, where all tasks run on one machine, may go without: it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="kinloom-")
        sc.setCheckpointDir(named)
    folder = sc.getCheckpointDir()
    if getattr(sc, "_kinloom_folder", None) != folder:
        fs, path = _path(spark, folder)
        fs.deleteOnExit(path)
        sc._kinloom_folder = folder
    return folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a folder that nothing reads any more."""
    fs, path = _path(spark, folder)
    fs.delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: nothing before is computed again, even if executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint()

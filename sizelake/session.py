"""Session factory and the settings the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with AQE (skew joins, coalescing) on and UTC time."""
    b = (
        SparkSession.builder.master(master)
        .appName("sizelake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in spark.checkpoint.dir; a local run, where it is unset, gets a
    temporary folder. A cluster without the setting is refused, as a folder of one machine would be lost with it."""
    sc = spark.sparkContext
    # getCheckpointDir exists only on the JVM side of some releases, so ask there
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sizelake-")
    sc.setCheckpointDir(named)
    return named


def cut(df):
    """df with its lineage cut by a checkpoint in the shared folder; it survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df) -> None:
    """Takes away the files of a checkpoint that nothing reads any more; of any other DataFrame nothing is touched."""
    spark = df.sparkSession
    try:
        held = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    except Exception:  # noqa: BLE001  not a checkpoint
        return
    if held.isDefined():
        path = spark._jvm.org.apache.hadoop.fs.Path(held.get())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
